"""Batch-incremental state: keyed merges, derived stages, reconciliation, carried reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.folds import by_group
from quire.session import cut


TOKEN = r"(\[\[[A-Za-z0-9_]+\]\])"
REJECTED = ("unknown", "duplicate", "extra_fields", "tokens", "language", "empty", "frozen")


def merge(base: DataFrame, batch: DataFrame, key: str, value: str, replace: bool = False, protected: str | None = None, language: Column | None = None) -> DataFrame:
    """Keyed upsert of batch values into base, with a verdict for each row of either; other columns of base are kept.

    merged: an open row gets its value; replayed: the same value again; kept: no batch row; rejected rows leave the base
    value: unknown (no such key), duplicate (the key comes twice), extra_fields (batch has an array `extra` that is not empty), tokens (not the
    token sequence of the base column `protected`), language (`language`, a condition on the text `_words` without tokens, is
    false), empty, or frozen (other text for a completed row without replace).
    """
    extra = F.max(F.size(F.coalesce("extra", F.array()))) if "extra" in batch.columns else F.lit(0)
    b = batch.groupBy(key).agg(F.count("*").alias("_n"), F.max(value).alias("_v"), extra.alias("_extra")).withColumnRenamed(key, "_k")
    j = base.join(b, F.col(key) == F.col("_k"), "full_outer")
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))
    blank = F.coalesce(F.trim("_v"), F.lit("")) == ""
    wrong = F.lit(False) if protected is None else ~blank & (tokens(F.col("_v")) != tokens(F.col(protected)))
    j = j.withColumn("_words", F.regexp_replace("_v", TOKEN, ""))
    foreign = F.lit(False) if language is None else ~blank & ~F.coalesce(language, F.lit(False))
    verdict = (
        F.when(F.col(key).isNull(), "unknown").when(F.col("_k").isNull(), "kept").when(F.col("_n") > 1, "duplicate").when(F.col("_extra") > 0, "extra_fields")
        .when(wrong, "tokens").when(foreign, "language").when(blank, "empty")
        .when(F.col(value) == F.col("_v"), "replayed").when((F.coalesce(F.col(value), F.lit("")) != "") & F.lit(not replace), "frozen").otherwise("merged")
    )
    others = [c for c in base.columns if c not in (key, value)]
    return j.select(F.coalesce(key, "_k").alias(key), F.when(verdict == "merged", F.col("_v")).otherwise(F.col(value)).alias(value), *others, verdict.alias("verdict"))


def all_or_nothing(merged: DataFrame, base: DataFrame, key: str, value: str, by: Column) -> DataFrame:
    """merge() rows of the batches by, each applied whole or not at all: where a row of it is rejected, all keep the base value and the verdict refused."""
    m = cut(merged.withColumn("_by", by))
    bad = m.groupBy("_by").agg(F.bool_or(F.col("verdict").isin(*REJECTED)).alias("_bad"))
    old = base.select(F.col(key).alias("_key"), F.col(value).alias("_old"))
    m = m.join(bad, "_by").join(old, F.col(key) == F.col("_key"), "left")
    undone = F.col("_bad") & F.col("verdict").isin("merged", "replayed")
    return m.withColumn(value, F.when(undone, F.col("_old")).otherwise(F.col(value))).withColumn("verdict", F.when(undone, "refused").otherwise(F.col("verdict"))).drop("_by", "_bad", "_key", "_old")


def reconcile(old: DataFrame, new: DataFrame, key: str, value: str, fields: list[str]) -> DataFrame:
    """States of a checkpoint's rows after units were extracted anew: key, value, state.

    kept: completed and unchanged; open: to be done, new or not completed before; dropped: open before and gone. A completed row that is gone, or of which one of fields
    differs, must not be lost or changed: its state is refused:orphan or refused:<first field that differs>.
    """
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    j = new.join(o, F.col(key) == F.col("_k"), "full_outer")
    done = F.coalesce(F.trim("_v"), F.lit("")) != ""
    changed = F.coalesce(*[F.when(~F.col(f).eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields])
    state = F.when(F.col(key).isNull() & done, "refused:orphan").when(F.col(key).isNull(), "dropped").when(done & changed.isNotNull(), F.concat(F.lit("refused:"), changed)).when(done, "kept").otherwise("open")
    return j.select(F.coalesce(key, "_k").alias(key), F.coalesce("_v", F.lit("")).alias(value), state.alias("state"))


def stage(source_changed: Column, prepared: Column, translated: Column, validated: Column, packaged: Column, delivered: Column) -> Column:
    """The stage that the evidence supports; a changed source starts over, and packaged stands without the chain before it."""
    return (
        F.when(source_changed, "queued").when(packaged & delivered, "delivered").when(packaged, "packaged")
        .when(prepared & translated & validated, "strict_validated").when(prepared & translated, "translated").when(prepared, "prepared").otherwise("queued")
    )


def progress(df: DataFrame, by: list[str], order: str, id_: str, done: Column) -> DataFrame:
    """total, completed, remaining, next id and whether all is complete."""
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.min_by(F.when(~done, F.col(id_)), F.when(~done, F.col(order))).alias("next_id"))
    return out.withColumn("remaining", F.col("total") - F.col("completed")).withColumn("complete", F.col("remaining") == 0)


def carry_reviews(new: DataFrame, old: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Reviews of entries with the same fingerprint stay, generated ones are made anew, others become unresolved."""
    o = old.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_f"), F.col("status").alias("_s"))
    status = F.when(F.col("_k").isNull(), "unresolved").when(F.col("_f") == F.col(fingerprint), F.col("_s")).when(F.col("_s") == "auto_validated", "auto_validated").otherwise("unresolved")
    return new.join(o, F.col(key) == F.col("_k"), "left").select(key, status.alias("status"))


def replay(units: DataFrame, operations: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Apply ordered operations (doc_id, step, op, id, text) to the units of each document (doc_id, ord, id, source_text).

    suppress drops a unit, replace gives it other text, insert puts a new unit (<id>-review) behind one; operations on units that were put in
    count too. An operation on an id that isn't there, or an insert whose id is there, leaves the document as it was, since a review is applied whole or not
    at all. One fold over the streamed rows of each document, in time linear in its rows; rows are dealt out once, with their texts.
    """

    def fold(key, rows):
        # next unit of each: units and what is put in behind them are a chain
        had = {i: t for _, side, _, _, i, t in rows if side == 0}
        text, after, before = dict(had), dict(zip([None, *had], [*had, None])), dict(zip([*had, None], [None, *had]))
        del before[None]
        for _, side, _, op, i, t in rows:
            if side == 0:
                continue
            new = f"{i}-review"
            if i not in before or (op == "insert" and new in before):
                text, after = had, dict(zip([None, *had], [*had, None]))
                break
            if op == "suppress":
                a, b = before.pop(i), after.pop(i)
                after[a] = b
                if b is not None:
                    before[b] = a
            elif op == "replace":
                text[i] = t
            elif op == "insert":
                b = after[i]
                after[i], after[new], before[new], text[new] = new, b, i, t
                if b is not None:
                    before[b] = new
        out, at = [], after[None]
        while at is not None:
            out.append((key, len(out) + 1, at, text[at]))
            at = after[at]
        return out

    rows = units.select(F.col(doc).alias("doc_id"), F.lit(0).alias("side"), F.col("ord").cast("long").alias("at"), F.lit(None).cast("string").alias("op"), "id", F.col("source_text").alias("text"))
    rows = rows.unionByName(operations.select(F.col(doc).alias("doc_id"), F.lit(1).alias("side"), F.col("step").cast("long").alias("at"), "op", "id", "text"))
    return by_group(rows, "doc_id", ["side", "at"], fold, "doc_id long, ord long, id string, source_text string")
