import random

import pytest

from quire.llm.minhash import near_duplicates

SPACES = b" \t\n\v\f\r"


def brute(rows, k, percent):
    """Components over all pairs; rows: (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split() if (t or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs, shingle=4)) == brute(rows, 4, 80)


def test_chain_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):  # each edits the one before: the ends are far apart, the chain links them
        rows.append((1000 + i, " ".join(words)))
        words[rng.randrange(120)] = f"x{i}"
    for i in range(40):  # one passage that many texts share is no link
        rows.append((2000 + i, " ".join(words[:30] + [f"y{i}_{j}" for j in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, block=16)) == brute(rows, 5, 80)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one\ttwo "), (10, "one"), (None, "one two"), (11, "É é"), (12, "é é")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[7] == (0, 7, True)
    assert got[8] == (1, 8, True) and got[9] == (1, 8, False) and got[10] == (1, 10, True)
    assert got[None] == (1, 8, False) and got[11] == (1, 11, True) and got[12] == (1, 12, True)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [300_000])
def test_very_long_text(spark, size):
    long = " ".join(str(i) for i in range(size // 6)) + " " + "z" * 100_000
    df = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df).collect()} == {1}
