"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os
import re
import unicodedata

import duckdb
import pytest

from quire.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df, cols):
    values = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return sorted(map(tuple, values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    mine, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(want.columns)
    assert rows(mine, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_protection_is_reversible(spark, sf_dir):
    assert catalog.queries()["f_protect"](spark, sf_dir).filter("not coalesce(restored, false)").isEmpty()


def test_exclusive_links_are_exclusive(spark, sf_dir):
    links = catalog.queries()["join_asof_exclusive"](spark, sf_dir).filter("marker_id is not null")
    assert links.count() == links.select("marker_id").distinct().count()


def test_slug_of_whole_text(spark, sf_dir):
    """The slug holds 80 characters wherever the text has them, however many marks stand before."""

    def slugify(value):
        return re.sub(r"[^a-zA-Z0-9]+", "-", unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()).strip("-").lower()[:80] or "paper"

    want = {r.doc_id: slugify(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.slug for r in catalog.queries()["f_slug"](spark, sf_dir).collect()} == want
