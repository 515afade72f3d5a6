"""The unit table: one row for each element of a document, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units on a page of a text document.
PAGE_UNITS = 40
TRANSLATABLE = ("heading", "body", "caption")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_documents(docs: DataFrame) -> DataFrame:
    """One unit for each line of a text: id, ord from 1, page, kind, words."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "source_text"))
    kind = (
        F.when(F.col("pos") == 0, "heading")
        .when(F.contains("source_text", F.lit("|")), "table")
        .when(F.length("source_text") < 40, "caption")
        .otherwise("body")
    )
    return lines.select(
        "doc_id",
        F.format_string("d%d-u%d", "doc_id", F.col("pos") + 1).alias("id"),
        (F.col("pos") + 1).alias("ord"),
        (F.floor(F.col("pos") / PAGE_UNITS) + 1).cast("int").alias("page"),
        kind.alias("kind"),
        "source_text",
        F.regexp_count("source_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).withColumn("translatable", F.col("kind").isin(*TRANSLATABLE))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents"))


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose work is done."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on pages, made of line items: a page for each order."""
    li = table(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_quantity"), F.round(F.pmod(F.col("l_extendedprice"), F.lit(700.0)), 3)
    return li.select(
        F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").cast("int").alias("n"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("l_tax") * 1000 + 20).alias("x1"),
        (y0 + F.col("l_discount") * 500 + 5).alias("y1"),
        F.col("l_returnflag").alias("kind"),
    )


#: The same in SQL; the first word follows WITH.
UNITS_SQL = """units as (
  select *, kind in ('heading', 'body', 'caption') as translatable from (
    select doc_id, 'd' || doc_id || '-u' || ord as id, cast(ord as integer) as ord, cast((ord - 1) // 40 + 1 as integer) as page,
      case when ord = 1 then 'heading' when contains(source_text, '|') then 'table' when length(source_text) < 40 then 'caption' else 'body' end as kind,
      source_text, cast(len(regexp_extract_all(source_text, '[^\\x20\\x09-\\x0D]+')) as bigint) as words
    from (select doc_id, unnest(string_split(text, chr(10))) as source_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ord
          from documents where text is not null)))"""
BOXES_SQL = """boxes as (
  select l_orderkey as page, cast(l_linenumber as integer) as n, l_quantity as x0, y0, l_quantity + l_tax * 1000 + 20 as x1, y0 + l_discount * 500 + 5 as y1, l_returnflag as kind
  from (select *, round(l_extendedprice % 700.0, 3) as y0 from lineitem))"""
DONE_SQL = "done as (select distinct doc_id from labels where quality = 1)"
