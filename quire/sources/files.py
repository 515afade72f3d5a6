"""Readers and writers of unit files: strict and lax JSON lines, JSON documents, hashes, ZIP archives, Markdown."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_jsonl(df: DataFrame, path: str, exclusive: bool = True) -> str:
    """One JSON object a line, nulls kept. exclusive: an existing path is an error and stays as it is."""
    df.write.mode("errorifexists" if exclusive else "overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that are objects of the schema; others are dropped, blank lines and a byte-order mark are skipped."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    line = F.regexp_replace("value", "^\ufeff", "")
    parsed = F.from_json(line, StructType([*schema.fields]).add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).filter(F.trim(line) != "").select(parsed.alias("r")).filter("r is not null and r._corrupt is null")
    return rows.select("r.*").drop("_corrupt")


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str, key: str = "id") -> DataFrame:
    """Lines of the schema with a key that is not empty and never repeats; anything else aborts the job that reads it."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # keys alone are counted, and one row says whether any is bad: rows don't move
    counted = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    bad = counted.filter("_k is null or _k = '' or _n > 1").agg(F.count("*").alias("_bad"), F.min("_k").alias("_first"))
    failed = F.raise_error(F.concat(F.lit(f"{key} is missing or repeats: "), F.coalesce(F.col("_first"), F.lit("null"))))
    return df.crossJoin(F.broadcast(bad)).withColumn(key, F.when(F.col("_bad") > 0, failed).otherwise(F.col(key))).drop("_bad", "_first")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """One object a file; a wrong schema_version aborts the job that reads it."""
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if version is None:
        return df
    return df.withColumn("schema_version", F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown schema_version")).cast("int")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, SHA-256 and MD5 of the files of a folder."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def write_blobs(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's text as a file of its own; returns the names."""
    from quire.sources.paths import make_dir, opened

    make_dir(folder)

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for n, data in zip(names, batch.column(1).to_pylist()):
                system, path = opened(f"{folder}/{n}")
                with system.open_output_stream(path, compression=None) as f:
                    f.write(bytes(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "name string")


def zip_of(names: list[str], contents: list[bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in sorted(zip(names, contents)):
            z.writestr(zipfile.ZipInfo(n), c)
    return out.getvalue()


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of the archives of a folder: archive, member, size, sha256, safe (relative, no parent step, unique)."""

    def run(batches):
        for batch in batches:
            out = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    seen: set[str] = set()
                    for m in z.infolist():
                        if not m.is_dir():
                            data = z.read(m)
                            parts = m.filename.split("/")
                            safe = not (m.filename.startswith("/") or ".." in parts or "\\" in m.filename or ":" in m.filename or m.filename in seen)
                            seen.add(m.filename)
                            out.append((archive.rpartition("/")[2], m.filename, len(data), hashlib.sha256(data).hexdigest(), safe))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["archive", "member", "size", "sha256", "safe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, size long, sha256 string, safe boolean")


def markdown(units: DataFrame, doc: str, order: str, kind: str, text: str) -> DataFrame:
    """One Markdown text a document: headings marked, tables fenced, paragraphs apart."""
    t = F.col(text)
    block = F.when(F.col(kind) == "heading", F.concat(F.lit("# "), t)).when(F.col(kind) == "table", F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(t)
    rows = units.filter(F.trim(t) != "").withColumn("_b", F.struct(F.col(order), block.alias("b")))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["b"]), "\n\n").alias("markdown"))


def write_atomic(df: DataFrame, path: str) -> str:
    """Write beside the path and rename, so that a failure leaves what was there; works on any Hadoop file system.

    Between the two renames the path is missing and the former files are at <path>.old; a failed second rename puts them back, and the next call does
    so after a crash there. Each rename's result is checked: file systems report failure by it.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    here, part, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.part", f"{path}.old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(here) and not fs.rename(old, here):
        raise OSError(f"the former files of {path} are at {path}.old")
    df.write.mode("overwrite").parquet(f"{path}.part")
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} can't be moved; it is as it was")
    if not fs.rename(part, here):
        if fs.exists(old) and not fs.rename(old, here):
            raise OSError(f"the former files of {path} are at {path}.old")
        raise OSError(f"{path}.part can't be moved; {path} is as it was")
    fs.delete(old, True)
    return path
