"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    from quire.llm.minhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)


def op2_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, bit-packed into files and read back."""
    from quire.llm.tokenbin import read_digests, write_tokens
    from quire.llm.tokens import public_tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(write_tokens(docs, public_tokenizer("byte_bpe_50k.json"), end_id=0))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    from quire.llm.packing import pack
    from quire.llm.tokens import public_tokenizer

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"), end_id=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; a quarter, chosen by doc_id, is held out of the training; a null doc_id is not held out."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from quire.llm.langid import identify, learn, vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held_out), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, equal payloads as revisits, and read back."""
    from quire.llm.warc import page_digests, write_warc
    from quire.session import work_path

    folder = work_path(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return page_digests(spark, folder, files)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, one row a match."""
    from quire.llm.licenses import scan

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts, parsed back into turns: roles and digests of texts and renderings."""
    from pyspark.sql import functions as F

    from quire.llm.chat import learn, parse, transcripts

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = parse(transcripts(turns), learn(turns))
    return found.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.md5("rendered").alias("rendered_md5"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents; the host is the source."""
    from quire.llm.quality import quality

    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 3, 1, 2 over the sources, 150% of all words, at most twice each."""
    from pyspark.sql import functions as F

    from quire.llm.mixing import mix

    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    from quire.llm.embed import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_token_bin, op3_packing, op4_language_id, op5_warc, op6_license_scan, op7_quality_rules, op8_chat_format, op9_mixing, op10_embedding_near_dedup)}


#: Sources above their capacities are set aside round by round, as the excess is shared again.
OP9_SQL = """
with recursive d as (
  select doc_id, source, md5(text) as digest, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, cast(2 * sum(size) as double) as most,
    cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight
  from d group by source),
budget as (select cast(sum(source_size) as double) * 150 / 100 as words from s),
rounds as (
  select 0 as k, (select words from budget) / (select sum(weight) from s) as level
  union all
  select k + 1, ((select words from budget) - coalesce(sum(most) filter (where most <= weight * level), 0)) / sum(weight) filter (where most > weight * level)
  from rounds, s where k < (select count(*) from s) group by k, level),
last_round as (select level from rounds order by k desc limit 1),
t as (select source, source_size, coalesce(least(most, weight * level), most) as target from s, last_round),
r as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    cast(cast('0x' || left(md5('11|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(digest, '')), 12) as bigint) as double) / 281474976710656.0 as draw
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from r
"""


OP8_SQL = """
select conv_id, turn, role, md5(text) as text_md5, md5('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)) as rendered_md5
from conversations
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": OP8_SQL, "op9_mixing": OP9_SQL}
