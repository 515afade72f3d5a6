import itertools
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.packing import best_cuts, pack
from quire.llm.tokens import Encoder, public_tokenizer


def test_cuts_cost_least():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, cap = 9, 20
        places = [0, *np.cumsum(rng.integers(1, 12, n)).tolist()]
        pen = [0, *rng.integers(0, 6, n).tolist()]
        pen[-1] = 0

        def price(cuts):
            at, total = 0, 0
            for c in cuts:
                if c - at > cap:
                    return None
                total += cap - (c - at) + pen[places.index(c)]
                at = c
            return total

        inner = places[1:-1]
        all_prices = [price([*c, places[-1]]) for k in range(len(inner) + 1) for c in itertools.combinations(inner, k)]
        assert price(best_cuts(places, pen, cap, True)) == min(p for p in all_prices if p is not None)


def check(rows, pieces, capacity, end=2, limit=0.02):
    tok = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    want = sorted((d, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes())) for d, t in rows)
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids))
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    got = []
    for (d, n), parts in docs.items():
        parts.sort()
        assert sum(x[1] for x in parts) == n
        got.append((d, zlib.crc32(b"".join(x[2] for x in parts))))
    assert sorted(got) == want
    lengths = [sum(n for _, n in s) for s in seqs.values()]
    padding = sum(capacity - n for n in lengths if n & (n - 1))
    assert padding <= limit * sum(lengths)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    check(rows, pack(docs, public_tokenizer("word_bpe_49k.json"), 2, keep_ids=True).collect(), 4096)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))  # no sentence end
    rows = [(1, None), (2, ""), (3, "One. Two! Three?"), (4, long), (5, "x " * 200 + "."), (6, "one <|endoftext|> two")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, offset string")
    check(rows, pack(df, public_tokenizer("word_bpe_49k.json"), 2, capacity=1024, keep_ids=True).collect(), 1024, limit=0.1)
    assert pack(df.limit(0), public_tokenizer("word_bpe_49k.json"), 2).count() == 0
    again = spark.createDataFrame([(7, "same"), (7, "same"), (None, "x")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in pack(again, public_tokenizer("word_bpe_49k.json"), 2).collect()) == [0, 7, 7]


def test_a_word_is_tokenized_once_for_all_texts():
    enc, seen = Encoder(public_tokenizer("word_bpe_49k.json")), []
    for cache in (enc.words, enc.rest.pre):
        cache.tokenize = lambda letters, f=cache.tokenize: seen.append(letters) or f(letters)
    texts = [f"{a}nother wÖrd{a} wÖrd{mark}" for a in "abc" for mark in ("", ",", ".", "$$$", "!?")]
    assert list(enc.many(pa.array(texts))) == [enc.whole(t) for t in texts]
    words = [x for x in seen if x[0].isalpha()]
    assert len(words) == len(set(words)) == 7


def test_workers_get_few_bytes_at_once(spark, monkeypatch):
    limit, most, cut = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.cut
    texts = spark.range(1000).selectExpr("id doc_id", "repeat('Word. ', 2000 + 100000 * int(id = 7)) text")  # 12 kB each, one of 600 kB

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["m"])

    def spied(df):
        most.append(max(r.m for r in texts.coalesce(1).mapInArrow(sizes, "m long").collect()))
        return cut(df)

    monkeypatch.setattr(packing, "cut", spied)
    before = spark.conf.get(limit, None)
    pieces = pack(texts, public_tokenizer("word_bpe_49k.json"), 2).collect()
    assert most and max(most) < 6 << 20  # all 13 MB before
    assert spark.conf.get(limit, None) == before
    held = {}
    for p in pieces:
        held[p.doc_id] = held.get(p.doc_id, 0) + p.length
    assert held == {i: 204001 if i == 7 else 4001 for i in range(1000)}
