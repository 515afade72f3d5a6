"""The opN_ queries as their contracts state them: columns, types, and rows against brute force or DuckDB."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm.queries import oracle_sql, queries
from quire.llm.tokens import public_tokenizer
from tests.llm import test_embed, test_minhash, test_quality, test_warc
from tests.llm.test_mixing import WORD_COUNT, shares

COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_token_bin": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_license_scan": "doc_id bigint, license string, first_word bigint, last_word bigint, containment double",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_chat_format": "conv_id bigint, turn bigint, role string, text_md5 string, rendered_md5 string",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    out = {}

    def get(name):
        if name not in out:
            df = queries()[name](spark, sf_dir)
            out[name] = (df.dtypes, df.collect())
        return out[name]

    return get


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(found, name):
    types = dict(found(name)[0])
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert types[column] == kind, c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(found, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    names = sorted(n for n, _ in found(name)[0])
    want = c.execute(f"select {', '.join(names)} from ({oracle_sql()[name]})").fetchall()
    assert sorted(want, key=str) == sorted((tuple(r[n] for n in names) for r in found(name)[1]), key=str)


def test_op1(found, docs):
    assert test_minhash.brute([(r.doc_id, r.text) for r in docs], 4, 80) == {r.doc_id: tuple(r)[1:4] for r in found("op1_minhash_near_dedup")[1]}


def test_op2(found, docs):
    tok, at, want = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json")), 0, []
    for r in docs:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert want == sorted(tuple(r)[:4] for r in found("op2_token_bin")[1])


def test_op3(found, docs):
    tok = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for p in found("op3_packing")[1]:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        pieces[p.doc_id].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == set(ids)
    for rows, size in [(pieces[d], len(x)) for d, x in ids.items()] + [(s, None) for s in seqs.values()]:
        at = 0
        for start, n in sorted(rows):
            assert start == at and n > 0
            at += n
        assert at == size if size is not None else at <= 4096


def test_op4(found, docs):
    rows = {r.doc_id: r for r in found("op4_language_id")[1]}
    assert len(rows) == len(docs)
    for r in docs:
        assert rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= rows[r.doc_id].score <= 1
    held = [r for r in docs if rows[r.doc_id].held_out and r.lang]
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_op5(found, spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert sorted((tuple(r)[:5] for r in found("op5_warc")[1]), key=str) == test_warc.brute([(r.page_id, r.html) for r in pages])


def test_op7(found, docs):
    got = {r.doc_id: r for r in found("op7_quality_rules")[1]}
    assert {d: tuple(r)[1:7] for d, r in got.items()} == {r.doc_id: test_quality.counts(r.text) for r in docs}
    assert not any(r.kept and r.base_failed for r in got.values())


def test_op9(found, docs):
    rows = {r.doc_id: r for r in found("op9_mixing")[1]}
    sizes = defaultdict(int)
    for r in docs:
        assert rows[r.doc_id].size == len(WORD_COUNT.findall(r.text or ""))
        sizes[r.source] += rows[r.doc_id].size
    target = shares(sizes)
    for r in docs:
        x = rows[r.doc_id]
        assert x.source_size == sizes[r.source] and x.target == pytest.approx(target[r.source])
        rate = x.target / x.source_size if x.source_size else 0
        assert x.taken in (x.size * int(rate), x.size * (int(rate) + 1)) and x.taken <= 2 * x.size


def test_op10(found, spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r)[:4] for r in found("op10_embedding_near_dedup")[1]) == test_embed.brute(rows, 0.95)
