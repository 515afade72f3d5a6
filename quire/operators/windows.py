"""Ordered operators over units: forward fill, islands, running budgets, intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(*by: str, order: str = "ord"):
    return Window.partitionBy(*by).orderBy(order)


def forward_fill(df: DataFrame, by: list[str], order: str, is_head: Column, value: Column, name: str) -> DataFrame:
    """Carry the value of the last head forward."""
    w = ordered(*by, order=order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(F.when(is_head, value), ignorenulls=True).over(w))


def renumber(df: DataFrame, by: list[str], page: str, order: str) -> DataFrame:
    """Dense order in a document and ordinal on a page."""
    return df.withColumn("new_order", F.row_number().over(ordered(*by, order=order))).withColumn("page_order", F.row_number().over(ordered(*by, page, order=order)))


def ranked(df: DataFrame, by: list[str], stretch: str, order: str, name: str) -> DataFrame:
    """Row number in each key by order, where stretch rises with order: rows are numbered inside their stretch, and small counts of stretches say what comes before.

    No task holds more than one stretch of a key. Null keys are a key.
    """
    keys = [*by, stretch]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(counts, same).withColumn(name, F.col("_place") + F.col("_before")).drop("_place", "_before", *[f"_k{i}" for i in range(len(keys))])


def islands(df: DataFrame, by: list[str], order: str, continues: Column) -> DataFrame:
    """Number the runs of rows that continue the row before. continues may use lag over the same order."""
    w = ordered(*by, order=order)
    return df.withColumn("_new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def budget_prefix(df: DataFrame, by: list[str], order: str, words: str, done: str, budget: int) -> DataFrame:
    """The contiguous run from the first open row whose words stay within budget; the first row is always in.

    df is narrowed to rows from the first open one on, before the next done one.
    """
    w = Window.partitionBy(*by)
    first = F.min(F.when(~F.col(done), F.col(order))).over(w)
    open_rows = df.withColumn("_first", first).filter(F.col(order) >= F.col("_first"))
    stop = F.min(F.when(F.col(done), F.col(order))).over(w)
    open_rows = open_rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    run = ordered(*by, order=order)
    open_rows = open_rows.withColumn("cum_words", F.sum(words).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keep = (F.col(order) == F.col("_first")) | (F.col("cum_words") <= budget)
    return open_rows.filter(keep).drop("_first", "_stop")


def fold_sorted(df: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], name: str, kind: str) -> DataFrame:
    """df with a column that a fold over the ordered rows of each key gives, row by row.

    step(state, values of order) changes the state, which start() makes for each key, and returns the row's value. Rows are dealt out by key, sorted and streamed, so a key of any
    number of rows needs the memory of its state alone.
    """
    n = len(by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, *order).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[:n] != key:
                    key, state = row[:n], start()
                found.append(step(state, row[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, {"int": pa.int32(), "boolean": pa.bool_()}[kind])], [*batch.schema.names, name])

    rows = df.select(*by, *order).repartition(*by).sortWithinPartitions(*by, *order)
    return rows.mapInArrow(run, f"{schema}, {name} {kind}")


def pack_all(df: DataFrame, by: list[str], order: str, words: str, budget: int) -> DataFrame:
    """Packet number of every row when the budget rule is applied again and again: by..., order, packet."""

    def step(state, row):
        if not state[0] or state[1] + row[1] > budget:
            state[0], state[1] = state[0] + 1, 0
        state[1] += row[1]
        return state[0]

    return fold_sorted(df, by, [order, words], lambda: [0, 0], step, "packet", "int").drop(words)


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of intervals for each key, by a running maximum of ends."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(end).over(w)
    fresh = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(seen, F.col(start))))
    return df.withColumn("_fresh", fresh).groupBy(*by).agg(F.sum("_fresh").alias("covered"))


def clusters(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Number values so that a gap above tolerance begins a new cluster."""
    gap = F.col(value) - F.lag(value).over(ordered(*by, order=value))
    return islands(df, by, value, gap <= tolerance).withColumnRenamed("island", "cluster")


def nonoverlapping(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Of intervals by (start, -end), those that begin at or after the end of the last one kept."""

    def step(state, row):
        keep = not state or row[0] >= state[0]
        if keep:
            state[:] = [-row[1]]
        return keep

    rows = df.select(*by, F.col(start).alias("_s"), (-F.col(end)).alias("_e"))
    kept = fold_sorted(rows, by, ["_s", "_e"], list, step, "_keep", "boolean").filter("_keep")
    return kept.select(*by, F.col("_s").alias(start), (-F.col("_e")).alias(end))
