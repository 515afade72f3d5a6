"""Each stage of the pipeline against brute force, on its own input."""

import os
import time
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quire.llm.mixing import mix
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import shares
from tests.llm.test_quality import WORD, counts


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """[documents, then what each stage kept]"""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "source_mix", "sequence_packing"]


def test_quality(stages):
    # so few texts a host that no line is above the limit
    want = [tuple(r) for r in stages[0].collect() if not counts(r.text)[5]]
    assert sorted(map(tuple, stages[1].collect())) == sorted(want)


def test_language_keeps_clean_documents(stages):
    assert sorted(map(tuple, stages[2].collect())) == sorted(map(tuple, stages[1].collect()))


def test_one_of_each_group_stays(stages):
    rows = stages[2].collect()
    parts = brute([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sorted(map(tuple, stages[3].collect())) == sorted(tuple(r) for r in rows if parts[r.doc_id][2])


def test_mix(stages):
    rows, taken = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
    target = shares(sizes)
    planned = {r.doc_id: r for r in mix(stages[3]).collect()}
    for r in rows:
        assert taken[r.doc_id] == planned[r.doc_id].copies <= 2
        assert planned[r.doc_id].target == pytest.approx(target[r.source])
        assert target[r.source] / sizes[r.source] - 1 < taken[r.doc_id] < target[r.source] / sizes[r.source] + 1


def test_packing(stages):
    times = Counter(r.doc_id for r in stages[4].collect())
    tokens, size, seqs = Counter(), {}, defaultdict(list)
    for p in stages[5].collect():
        tokens[p.doc_id] += p.length
        assert size.setdefault(p.doc_id, p.doc_tokens) == p.doc_tokens
        seqs[p.sequence_id].append((p.offset, p.length))
    assert tokens == {d: n * size[d] for d, n in times.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    padding = sum(4096 - n for n in (sum(x for _, x in s) for s in seqs.values()) if n & (n - 1))
    assert padding <= 0.02 * sum(tokens.values())


def test_defects_go(spark, sf_dir):
    text = " ".join(f"the hereof{i} andthat{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "12 34 " * 40, None, "s", 1), (4, None, None, None, None), (None, text + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    kept = corpus_pipeline.near_dedup(spark, docs.filter("doc_id != 3"), sf_dir)
    assert [r.doc_id for r in kept.filter("text is not null").collect()] == [1]


def test_lines_above_the_limit_leave_the_texts(spark, sf_dir):
    def word(i, k):  # no digits: they fold to 0
        return "".join("abcdefghij"[int(d)] for d in f"{i:02d}{k:02d}")

    nav = "home and about and contact us"
    own = {i: "\n".join(" ".join(f"own{word(i, 9 * j + k)}" for k in range(9)) for j in range(8)) for i in range(60)}
    rows = [(i, f"{nav}\n{text}\n{nav.upper()}", "en", "s", 7) for i, text in own.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (text, len(text)) for i, text in own.items()}


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {os.path.join(at, x) for top in folders for at, _, names in os.walk(str(top)) for x in names if x.startswith("shuffle_")}


def left_after(spark, before):
    """Shuffle files that stay; they go in the background."""
    for _ in range(20):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_near_dedup_leaves_no_shuffle_files(spark, stages, sf_dir):
    before = shuffle_files(spark)
    kept = corpus_pipeline.near_dedup(spark, stages[2], sf_dir)
    assert not left_after(spark, before)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, stages[3].collect()))


def test_run_leaves_no_shuffle_files(spark, stages, sf_dir):
    before = shuffle_files(spark)
    ids = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).filter("start = 0").collect())
    assert ids == Counter(r.doc_id for r in stages[5].filter("start = 0").collect())
    left = left_after(spark, before)
    assert sum(os.path.getsize(x) for x in left if x.endswith(".data")) < 1000  # a sum that the driver asks for


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
