import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.tokenbin import Reader, pack, read_digests, unpack, width, write_tokens
from quire.llm import tokens
from quire.llm.tokens import Encoder, encoder, public_tokenizer

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [None, "", " ", "\n\n", "  two  spaces ", "it's 12,345 o'clock.\n\nNew line \t tab", "Été ÉTÉ ß İ ΣΑΣ", "a\x1cb \x85 c", "日本語 テキスト", "<|endoftext|> x <|startoftext|>", "a <|endoftext|> b", "A<|EndOfText|>", "<|endoftext|", "x" * 5000, "   nb", "🙂 ok"]


def plain(name, text):
    return Tokenizer.from_file(public_tokenizer(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name):
    enc = encoder(public_tokenizer(name))
    assert enc.kind
    for text in TEXTS:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == plain(name, text), repr(text)


@pytest.mark.parametrize("name", FILES)
def test_ids_of_any_text(name):
    enc, tok = encoder(public_tokenizer(name)), Tokenizer.from_file(public_tokenizer(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(" \n\t'sabcÉ.9́　\r"), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
    def same(text):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("name", FILES)
def test_ids_of_a_whole_table(spark, sf_dir, name):
    enc, tok = encoder(public_tokenizer(name)), Tokenizer.from_file(public_tokenizer(name))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    for text in texts:
        assert enc.ids(text) == np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_ids_of_texts_together(name):
    enc, tok = Encoder(public_tokenizer(name)), Tokenizer.from_file(public_tokenizer(name))

    def same(texts, offset=0):
        got = list(enc.many(pa.array(texts, pa.string()).slice(offset)))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[offset:]]

    letters = [chr(c) for c in range(0x250)]
    shapes = ["{0}", "a {0}", "a b{0}b c", "a {0}$$$ b{0},\nC{0} d", "A{0}{0}.'s x", "a  {0}", "{0} a "]
    for texts in (TEXTS, [None], [""], [" "], ["a"], [], [s.format(c) for s in shapes for c in letters]):
        same(texts)
        same(texts, len(texts) // 2)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.one_of(st.sampled_from(" \n\t'sabcÉ.9\u0301\u3000\r$_İ"), st.sampled_from(["<|endoftext|>", "<|", " w"]), st.characters(exclude_categories=["Cs"])), max_size=20).map("".join), max_size=8))
    def any_texts(texts):
        same(texts)

    any_texts()


@pytest.mark.parametrize("name", FILES)
def test_ids_together_hold_few_words(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 300)
    monkeypatch.setattr(tokens, "RUN_BYTES", 5000)
    enc = Encoder(public_tokenizer(name))
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{mark}" for i in range(k, k + 200) for mark in ("", ",", "$$$", ".\nThe")) for k in range(0, 4000, 150)]
    assert list(enc.many(pa.array(texts))) == [enc.whole(t) for t in texts]
    caches = [x for x in vars(enc).values() if isinstance(x, dict)]
    caches += [x.pre for x in caches if hasattr(x, "pre")]
    assert all(len(x) <= 300 and len(x.old) <= 300 for x in caches)
    assert not any("," in x or "$" in x for c in (enc.words, enc.rest) for x in {**c, **c.old})  # a word is kept once, whatever mark follows

    monkeypatch.setattr(tokens, "LONGEST", 10)
    assert list(enc.many(pa.array(texts[:3]))) == [enc.whole(t) for t in texts[:3]]


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
        data = pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits and (unpack(data, n, bits) == ids).all()
    assert [width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_files_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    manifest = write_tokens(df, public_tokenizer(FILES[0]), 0, f"file://{tmp_path}/bin")
    got = sorted(tuple(r) for r in read_digests(manifest).collect() if r.doc_id is not None)
    ids = [np.array(plain(FILES[0], t) + [0], "<u4") for _, t in sorted(rows[:-1], key=lambda r: (r[0], r[1] or ""))]
    order = sorted(r[0] for r in rows[:-1])
    at = len(plain(FILES[0], "no id")) + 1
    want = []
    for d, x in zip(order, ids):
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == sorted(want)
    shard = manifest.orderBy("shard").first()
    reader = Reader(shard.path)
    whole = reader.ids(0, reader.n_tokens)
    assert (reader.ids(3, 10) == whole[3:13]).all() and reader.n_tokens == shard.tokens
    assert write_tokens(df.limit(0), public_tokenizer(FILES[0]), 0).count() == 0
