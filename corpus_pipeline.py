"""The corpus pipeline: stages that each take all that the stage before kept.

A stage is called with (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
and reads again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, minhash, mixing, packing, quality
from quire.llm.tokens import public_tokenizer
from quire.session import passing_shuffles, work_path

#: Documents whose predicted language gets a smaller share than this are rejected.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by boilerplate lines, without these lines.

    Null, empty and blank texts fail; a null source is a host of its own; rows that repeat an id or a text are judged each for itself, and copies of one text count once for its lines.
    """
    return quality.passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters and doubtful ones go.

    Null and empty texts go; null labels aren't learned from, and where no row has a label no document stays, since no language is known. Ties go to the first language by name; repeated rows fare alike.
    """
    model = langid.learn(docs, langid.vocabulary(public_tokenizer("piece_bpe_32k.model")))
    found = langid.tagged(docs, model)
    return found.filter((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that of the smallest doc_id.

    Null and empty texts are near to nothing and stay; of rows that repeat id and text one stays; rows without an id are known by their text and go before those with one.
    """
    return minhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    Null texts have no words and add nothing; a null source is the last one; rows that repeat id and text are drawn alike.
    """
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    Null and empty texts are the end id alone; rows that repeat an id are documents of their own.
    """
    return packing.pack(docs, public_tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Language models, min-max hashing and token ids aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives no rows in any stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        kept = stage(spark, docs, sf_dir)
        with passing_shuffles(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
