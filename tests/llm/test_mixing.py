import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import mix, mixed, targets, words

WORD_COUNT = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, percent=150, most=2, weights=(3, 1, 2)):
    """Share the budget by weight; what stands above a capacity is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = sum(sizes.values()) * percent / 100, set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add, left = {s: left * w[s] / total for s in open_}, 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 5}, {"a": 7}, {"a": 0, "b": 0}, {"é": 100, "z": 100, "Z": 1, "zz": 900}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_words(spark):
    texts = {None: 0, "": 0, " \t\n\x0b\x0c\r": 0, "a": 1, " a\nb\t\tc ": 3, "é b": 2, "é\u00a0b": 1, "x" * 100_000 + " y": 2}
    df = spark.createDataFrame([(t, n) for t, n in texts.items()], "text string, n long")
    assert all(r.n == r.size for r in df.withColumn("size", words(F.col("text"))).collect())


def test_taken_words_are_near_the_targets(spark):
    rows = [(i, "w " * (1 + int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 97), "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df)
    rate = F.col("target") / F.col("source_size")
    part = rate - F.floor(rate)
    by = got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"), F.sqrt(F.sum(F.col("size") ** 2 * part * (1 - part))).alias("sd")).collect()
    assert all(abs(r.k - r.t) <= 4 * r.sd + 1e-6 and r.sd < 0.03 * r.t for r in by)
    assert got.filter("copies > 2 or copies < 0").isEmpty()
    again = mix(df.repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_a_document_draws_for_itself(spark):
    rows = [(i % 400, f"text {i} " + "w " * 20, "abc"[i % 3]) for i in range(801)]  # repeated ids, texts of one size
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {(r.doc_id, r.text): (r.copies, r.target / r.source_size) for r in mix(df).collect()}
    assert len(copies) == 801
    for (d, t), (n, rate) in copies.items():
        draw = int(hashlib.md5(f"11|{d}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 2**48
        assert n == int(rate) + (draw < rate - int(rate))
    more = df.union(spark.createDataFrame([(9000 + i, "more " * 22, "abc"[i % 3]) for i in range(801)], df.schema))
    assert {(r.doc_id, r.text): r.copies for r in mix(more).filter("doc_id < 9000").collect()} == {k: n for k, (n, _) in copies.items()}


def test_edges(spark):
    rows = [(1, None, None, "k"), (2, "", "a", "k"), (3, "one two", "a", "k"), (3, "one two", "a", "k"), (None, "x", "b", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(df)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"] and got.count() == 5
    assert mixed(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0
    total = defaultdict(int)
    for r in mixed(df).collect():
        total[r.source] += 1
    assert total["b"] <= 2


def test_plan_is_native(spark, sf_dir):
    plan = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
