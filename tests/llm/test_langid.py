import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import langid
from quire.llm.langid import Lattice, Model, fit, identify, learn, vocabulary


def brute(word, pieces, p):
    """Log of the sum over all segmentations, by fractions of the text's end."""
    sums = [[Fraction(1)] * p.shape[1]]
    for i in range(1, len(word) + 1):
        here = [Fraction(0)] * p.shape[1]
        for j in range(i):
            if word[j:i] in pieces:
                here = [x + Fraction(float(q)) * y for x, q, y in zip(here, p[pieces[word[j:i]]], sums[j])]
        sums.append(here)
    return np.array([math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]])


def uses(word, pieces, p):
    """Expected uses of the pieces, by listing all segmentations."""
    found = []

    def go(at, path, chance):
        if at == len(word):
            found.append((path, chance))
        for to in range(at + 1, len(word) + 1):
            if word[at:to] in pieces:
                k = pieces[word[at:to]]
                go(to, [*path, k], chance * p[k])

    go(0, [], 1.0)
    out, total = np.zeros(len(p)), sum(c for _, c in found)
    for path, chance in found:
        for k in path:
            out[k] += chance / total
    return out


def stacked(words):
    lengths = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def test_forward_sums_all_segmentations(monkeypatch):
    rng = random.Random(1)
    names = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randrange(2, 25))) for _ in range(60)} | {b"ab" * 12, b"abc"})
    pieces = {x: i for i, x in enumerate(names)}
    p = np.random.default_rng(2).random((len(names), 3)) * 1e-3
    words = [bytes(rng.choices(b"abcd", k=n)) for n in (1, 2, 5, 8, 9, 12, 33, 100, 100, 250)] + ["éa".encode(), b"a\0b\0", b"ab" * 60]
    want = np.array([brute(w, pieces, p) for w in words])
    assert Lattice(names).forward(*stacked(words), p) == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(langid, "_CELLS", 1)  # many segments
    assert Lattice(names).forward(*stacked(words), p) == pytest.approx(want, rel=1e-9)


def test_expected_uses_are_those_of_all_segmentations():
    rng = random.Random(4)
    names = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choices(b"ab", k=rng.randrange(2, 6))) for _ in range(12)})
    pieces = {x: i for i, x in enumerate(names)}
    p = np.random.default_rng(5).random(len(names)) * 1e-30  # sums far below what a double holds
    words = [bytes(rng.choices(b"abc", k=n)) for n in (1, 3, 7, 12, 13)]
    times = np.array([1.0, 2.0, 5.0, 1.0, 3.0])
    want = sum(t * uses(w, pieces, p * 1e30 * 1e-3) for w, t in zip(words, times))
    assert Lattice(names).expected(*stacked(words), times, p * 1e30 * 1e-3) == pytest.approx(want)
    long = b"abc" * 300
    got = Lattice(names).expected(*stacked([long]), np.array([1.0]), p)
    assert (got * np.array([len(x) for x in names])).sum() == pytest.approx(len(long))  # every byte lies in one piece


def test_text_is_the_product_of_its_words():
    names = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    m = Model(["x", "y"], names, np.random.default_rng(3).random((len(names), 2)))
    text = "Abc  ab\n" + "z" * 5000
    pieces = {x: i for i, x in enumerate(names)}
    want = sum(brute(w, pieces, m.p) for w in (b"abc", b"ab")) + 5000 * np.log(m.p[ord("z")])
    got, n = m.log_likelihood(pa.array([text, None, "", "abc"]))
    assert got[0] == pytest.approx(want) and list(n) == [3, 0, 0, 1] and (got[1] == 0).all()


def test_fitting_raises_the_likelihood():
    names = [bytes([b]) for b in range(256)] + [b"ab", b"cd"]
    counts = {"x": {b"abab": 9, b"cdab": 3}}
    like = []
    for rounds in (1, 2, 5):
        m = fit(counts, names, rounds, least=1e-6)
        got, _ = m.log_likelihood(pa.array(["abab " * 9 + "cdab " * 3]))
        like.append(got[0, 0])
    assert like == sorted(like) and m.p[names.index(b"ab"), 0] > 0.5


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = learn(docs.filter(~held), pieces)
    rows = {r.doc_id: r for r in identify(docs, model).collect()}
    out = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert out and sum(rows[r.doc_id].lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())
    odd = [(1, None), (2, ""), (3, "12 .. 5"), (4, "the and of " * 30_000), (5, "²½"), (5, "la le des une"), (None, "日本")]
    got = identify(spark.createDataFrame([(i, t, "k") for i, t in odd], "doc_id long, text string, score string"), model).collect()
    by = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in got)
    assert [x[1:] for x in by if x[0] in "123"] == [("und", False)] * 3
    assert ("4", "en", True) in by and ("5", "und", False) in by and ("5", "fr", True) in by and len(by) == 7
    assert identify(docs.limit(0), model).count() == 0
    none = learn(docs.filter("lang = 'zz'"), pieces)
    assert {r.lang_pred for r in identify(docs.limit(3), none).collect()} == {"und"}
