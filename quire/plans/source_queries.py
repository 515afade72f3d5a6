"""Queries of the readers and writers: each writes a table in its format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.units import UNITS_SQL, table, units
from quire.session import cut, ship, work_path
from quire.sources import files

_UNIT = "id string, page int, kind string, source_text string"


def scan_jsonl_strict(spark, sf):
    path = files.write_jsonl(units(spark, sf).select("id", "page", "kind", "source_text"), work_path(spark, "jsonl"))
    return files.read_jsonl_strict(spark, path, _UNIT)


def scan_jsonl_lax(spark, sf):
    """Lines that are no objects are left out."""
    u = units(spark, sf)
    lines = u.select(F.when(F.col("ord") % 10 == 3, F.lit("[1, 2")).when(F.col("ord") % 10 == 4, F.lit("")).otherwise(F.to_json(F.struct("id", "page", "kind", "source_text"))).alias("value"))
    path = work_path(spark, "lines")
    lines.write.text(path)
    return files.read_jsonl(spark, path, _UNIT)


def scan_json_doc(spark, sf):
    """One object a file, over several lines, with a version."""
    ship(spark)
    b = table(spark, sf, "benchmark").withColumn("schema_version", F.lit(2))
    folder = work_path(spark, "json")
    name = F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit(".json"))
    cut(files.write_blobs(b.select(name.alias("n"), F.to_json(F.struct("schema_version", "item_id", "text"), {"pretty": "true"}).alias("c")), folder, "n", "c"))
    return files.read_json_document(spark, folder, "schema_version int, item_id long, text string", 2)


def scan_binary_hash(spark, sf):
    ship(spark)
    folder = work_path(spark, "blobs")
    cut(files.write_blobs(table(spark, sf, "benchmark").withColumn("n", F.concat(F.lit("b"), F.col("item_id").cast("string"))), folder, "n", "text"))
    return files.file_hashes(spark, folder)


def scan_zip(spark, sf):
    """Archives of the benchmark's texts, four of them, and their members."""
    ship(spark)
    import pandas as pd

    def packed(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [f"a{key[0]}.zip"], "c": [files.zip_of([f"t/{i}.txt" for i in part["item_id"]], [t.encode() for t in part["text"]])]})

    b = table(spark, sf, "benchmark").withColumn("g", F.col("item_id") % 4)
    folder = work_path(spark, "zips")
    cut(files.write_blobs(b.groupBy("g").applyInPandas(packed, "n string, c binary"), folder, "n", "c"))
    return files.zip_members(spark, folder)


def sink_jsonl(spark, sf):
    """Conversations written as JSON lines and read back."""
    path = files.write_jsonl(table(spark, sf, "conversations"), work_path(spark, "sink"))
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


def sink_atomic(spark, sf):
    path = work_path(spark, "atomic")
    for k in (1, 0):
        files.write_atomic(table(spark, sf, "nation").filter(f"n_nationkey % 2 >= {k}"), path)
    return spark.read.parquet(path)


def sink_exclusive(spark, sf):
    """A path that exists is refused and stays as it is."""
    from pyspark.errors import AnalysisException

    path = work_path(spark, "exclusive")
    files.write_jsonl(table(spark, sf, "nation").orderBy("n_nationkey"), path)
    try:
        files.write_jsonl(table(spark, sf, "nation").filter("n_nationkey < 3"), path)
        refused = False
    except AnalysisException:
        refused = True
    return files.read_jsonl(spark, path, "n_nationkey int, n_name string, n_regionkey int").withColumn("refused", F.lit(refused))


def udtf_units(spark, sf):
    """Units of texts by a table function, called for each document."""
    from quire.functions.tables import units_from_text

    return units_from_text(table(spark, sf, "documents")).select("doc_id", "ord", "kind", "words", F.md5("source_text").alias("text_md5"))


def sink_markdown(spark, sf):
    m = files.markdown(units(spark, sf), "doc_id", "ord", "kind", "source_text")
    return m.select("doc_id", F.length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("md5"))


_U = f"with {UNITS_SQL} "
SQL = {
    "scan_jsonl_strict": _U + "select id, page, kind, source_text from units",
    "scan_jsonl_lax": _U + "select id, page, kind, source_text from units where ord % 10 not in (3, 4)",
    "scan_json_doc": "select 2 as schema_version, item_id, text from benchmark",
    "scan_binary_hash": "select 'b' || item_id as name, cast(octet_length(encode(text)) as bigint) as size, sha256(text) as sha256, md5(text) as md5 from benchmark",
    "scan_zip": "select 'a' || (item_id % 4) || '.zip' as archive, 't/' || item_id || '.txt' as member, cast(octet_length(encode(text)) as bigint) as size, sha256(text) as sha256, true as safe from benchmark",
    "sink_jsonl": "select conv_id, turn, role, text from conversations",
    "sink_atomic": "select * from nation",
    "sink_exclusive": "select n_nationkey, n_name, n_regionkey, true as refused from nation",
    "udtf_units": _U + "select doc_id, ord, kind, words, md5(source_text) as text_md5 from units",
    "sink_markdown": _U + ", b as (select doc_id, ord, case kind when 'heading' then '# ' || source_text when 'table' then '```' || chr(10) || source_text || chr(10) || '```' else source_text end as b from units where trim(source_text) != ''), m as (select doc_id, string_agg(b, chr(10) || chr(10) order by ord) as m from b group by doc_id) select doc_id, length(m) as chars, md5(m) as md5 from m",
}

QUERIES = {f.__name__: f for f in (scan_jsonl_strict, scan_jsonl_lax, scan_json_doc, scan_binary_hash, scan_zip, sink_jsonl, sink_atomic, sink_exclusive, udtf_units, sink_markdown)}
