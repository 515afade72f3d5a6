"""Queries against their SQL on texts and boxes that the generated tables seldom have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import folds, geometry, joins, state
from quire.plans import catalog


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def same_as_sql(spark, path, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    found = c.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in found.description]
    want = found.fetchall()
    got = [tuple(r) for r in catalog.queries()[name](spark, path).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_headings_without_title_or_with_wide_blanks(spark, tmp_path):
    same_as_sql(spark, documents(spark, tmp_path, ["", " ", "\nx", " a  b ", "a b ", "　a", " a", "a b", "a\x0bb", "3.5 x", None]), "f_heading")


def test_bodies_that_end_in_digits_or_blanks(spark, tmp_path):
    same_as_sql(spark, documents(spark, tmp_path, ["tail 5", "", " ", "a\n", "汉5", " a", "er er 7\n", "a, b. 1", None]), "f_norm_body")


def test_baselines_at_the_very_tolerance(spark):
    """268.1 - 229.6 is above 38.5 in doubles, though 229.6 + 38.5 reaches 268.1; a line at 17.1, 0.18 times its size."""
    rows = [(1, 1, "body", 0.0, 9.0, 268.1, 45.0), (1, 2, "equation", 0.0, 9.0, 229.6, 70.0), (2, 1, "body", 0.0, 9.0, 17.1, 95.0), (2, 2, "body", 0.0, 9.0, 0.0, 145.0)]
    lines = spark.createDataFrame(rows, "page long, n int, kind string, x0 double, x1 double, baseline double, size double")
    assert sorted(map(tuple, geometry.merged_lines(lines).collect())) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1)]


@pytest.mark.parametrize("value", [0.25, 8.35, 268.04999999999995, 4.449999999999999, -0.25, 0.05, 1.15])
def test_rounded_as_sql(spark, value):
    want = duckdb.connect().execute("select round(?::double, 1)", [value]).fetchall()[0][0]
    assert spark.range(1).select(geometry.rounded(F.lit(value), 1).alias("x")).first().x == want


def test_cascade_moves_blocks_not_pairs(spark, monkeypatch):
    """Pairs of common keys are made where the result is; over block ends none is lost or doubled."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    rows = [(i, "10.1/a" if i % 3 else None, "2001.1" if i % 5 == 1 else None, f"t{i % 2}", "2001", "k") for i in range(40)]
    e = spark.createDataFrame(rows[:20], "item_id long, doi string, arxiv string, title string, year string, parent_key string")
    c = spark.createDataFrame([(*r[:5], "K", None) for r in rows[20:]], "item_id long, doi string, arxiv string, title string, year string, key string, kind string")
    got = joins.cascade(e, c)
    want = set()
    for i, d, a, t, *_ in rows[:20]:
        for j, d2, a2, t2, *_ in rows[20:]:
            if d == d2 if d else a == a2 if a else t == t2:
                want.add((i, j, "doi" if d else "arxiv" if a else "title+year"))
            elif t == t2 and (not d or not d2 or d == d2) and (not a or not a2 or a == a2):
                want.add((i, j, "source-parent-key"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert "LeftAnti" not in got._jdf.queryExecution().toString()


def test_word_runs_shuffle_nothing(spark):
    u = spark.createDataFrame([("a", "ab cd  ef x yyy z"), ("b", None), ("c", ""), ("d", "q \t\t\t w")], "id string, source_text string")
    got = folds.word_runs(u)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("a", "bold", 0, 9), ("a", "italic", 10, 11), ("a", "italic", 16, 17), ("d", "italic", 0, 1), ("d", "italic", 6, 7)]


def test_review_that_inserts_an_id_twice_is_refused(spark):
    u = spark.createDataFrame([(1, 1, "a", "t"), (1, 2, "b", None)], "doc_id long, ord long, id string, source_text string")
    ops = spark.createDataFrame([(1, 1, "replace", "a", "r"), (1, 2, "insert", "a", "i"), (1, 3, "insert", "a", "j")], "doc_id long, step long, op string, id string, text string")
    once = state.replay(u, ops.filter("step < 3"))
    assert "Join" not in once._jdf.queryExecution().toString() and "FlatMapCoGroups" not in once._jdf.queryExecution().toString()
    assert [tuple(r) for r in once.orderBy("ord").collect()] == [(1, 1, "a", "r"), (1, 2, "a-review", "i"), (1, 3, "b", None)]
    assert [r.id for r in state.replay(u, ops).orderBy("ord").collect()] == ["a", "b"]


def test_list_flow_streams(spark, tmp_path):
    got = catalog.queries()["win_list_flow"](spark, documents(spark, tmp_path, ["a\nb\nc", "", None]))
    assert "InPandas" not in got._jdf.queryExecution().toString() and got.count() == 4


def test_reading_order_of_pages_over_batches(spark):
    """Pages longer than an Arrow batch keep their places; rows are sorted once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        b = spark.range(40).selectExpr("cast(sqrt(id) as long) as page", "cast(id as int) as n", "double(id * 7 % 5) as x0", "double(id * 3 % 11) as y0", "double(id * 7 % 5 + id % 6) as x1")
        frame = geometry.reading_order(b)
        assert "Window" not in frame._jdf.queryExecution().toString()
        got = {(r.page, r.n): r.place for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = {}
    for r in b.collect():
        pages.setdefault(r.page, []).append(r)
    for page, rows in pages.items():
        left, right, band, keyed = min(r.x0 for r in rows), max(r.x1 for r in rows), 0, []
        for r in sorted(rows, key=lambda r: (r.y0, r.x0, r.n)):
            wide = r.x1 - r.x0 >= 0.6 * (right - left)
            band += wide
            keyed.append((band, not wide, 0 if wide else (r.x0 + r.x1) / 2 >= (left + right) / 2, r.y0, r.x0, r.n))
        for place, k in enumerate(sorted(keyed), 1):
            assert got[page, k[-1]] == place
