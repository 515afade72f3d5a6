"""Mixing sources to target weights, by DataFrame expressions only.

Targets are the water level: with budget T and capacities c(s), target(s) = min(c(s), w(s) * x) for
the one x at which they add up to T, which is what resharing the excess by weight until none is
above its capacity arrives at. Each document is then taken floor(rate) times and once more by a
hash-seeded Bernoulli draw whose probability is the fraction of rate = target / size of its source.

A draw hangs on the hash of seed, doc_id and text alone, so documents that come or go don't change
those of others, rows of documents are never shuffled or ordered, and the words taken of a source stray
from its target by chance only: of n documents of like size by about 1 / (3 * sqrt(n)) of it at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import cut

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (3, 1, 2)
#: Sources are sent to all executors only if their names and sizes take at most so many bytes.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Number of runs of bytes other than space and \\t..\\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    s = s.withColumn("most", (F.col("source_size") * most).cast("double"))
    # by ascending capacity a weight: the sources before the level are full
    up = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("full", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(percent) / 100.0)
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    # the first source that the level does not fill sets it for all after it
    fits = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and copies (times taken).

    Null text has size 0 and adds nothing; a null source is a source of its own, last in order. Rows that
    repeat a doc_id are documents of their own, which draw by their texts; equal rows draw alike. Other columns are kept. An
    empty table gives no rows; sources of size 0 have target 0. Columns of the input with these four names are replaced; names that begin with mix_ are taken.
    """
    made = ("size", "source_size", "target", "copies")
    own = [c for c in docs.columns if c not in made]
    rows = docs.select(*own).withColumn("size", words(F.col("text")))
    # summed in each task before it is dealt out; one row a source
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(sizes, percent, most, weights)).withColumnRenamed("source", "mix_name")
    held = plan.agg(F.sum(F.coalesce(F.octet_length("mix_name"), F.lit(0)) + 32)).first()[0] or 0
    if held <= BROADCAST_BYTES:  # so few sources that rows stay where they are; beyond, rows are dealt out by source
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("mix_name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    text_key = F.coalesce(F.md5(F.col("text").cast("string")), F.lit(""))
    draw = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_key, seed=seed)
    rows = rows.withColumn("mix_rate", rate)
    rows = rows.withColumn("copies", (F.floor("mix_rate") + F.when(draw < F.col("mix_rate") - F.floor("mix_rate"), 1).otherwise(0)).cast("long"))
    return rows.select(*own, *made)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    columns = docs.columns
    rows = mix(docs.select(F.struct(*columns).alias("mix_row"), *(c for c in ("doc_id", "text", "source"))), **settings)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy")
    return rows.filter("copies > 0").select("mix_row", copies).select("mix_row.*")
