"""Behaviour of single operators on small inputs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.functions import protect, text
from quire.operators import folds, joins, state, windows
from quire.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("opened, budget, ids, words", [((), 5, [1], 4), ((1,), 5, [2], 4), ((1,), 1, [2], 4), ((), 8, [1, 2], 8), ((2,), 100, [1], 4)])
def test_budget_prefix(spark, opened, budget, ids, words):
    df = spark.createDataFrame([("d", i, 4, i in opened) for i in (1, 2, 3)], "doc string, ord int, words int, done boolean")
    got = windows.budget_prefix(df, ["doc"], "ord", "words", "done", budget).orderBy("ord").collect()
    assert [r.ord for r in got] == ids and got[-1].cum_words == words


def test_pack_all_keeps_an_oversized_unit_whole(spark):
    df = spark.createDataFrame([("d", i, w) for i, w in enumerate([3, 0, 9, 2, 3, 1])], "doc string, ord int, words int")
    got = {r.ord: r.packet for r in windows.pack_all(df, ["doc"], "ord", "words", 5).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}


def test_merge_verdicts_and_idempotent_replay(spark):
    base = spark.createDataFrame([("a", ""), ("b", "old"), ("c", "same"), ("d", "")], "id string, t string")
    batch = spark.createDataFrame([("a", "new"), ("b", "other"), ("c", "same"), ("x", "?")], "id string, t string")
    merged = state.merge(base, batch, "id", "t")
    assert {r.id: (r.t, r.verdict) for r in merged.collect()} == {"a": ("new", "merged"), "b": ("old", "frozen"), "c": ("same", "replayed"), "d": ("", "kept"), "x": (None, "unknown")}
    whole = state.all_or_nothing(merged, base, "id", "t", F.lit(1))
    assert {r.id: (r.t, r.verdict) for r in whole.collect()} == {"a": ("", "refused"), "b": ("old", "frozen"), "c": ("same", "refused"), "d": ("", "kept"), "x": (None, "unknown")}
    good = state.merge(base, batch.filter("id = 'a'"), "id", "t")
    once = state.all_or_nothing(good, base, "id", "t", F.lit(1))
    again = state.merge(once.select("id", "t"), batch.filter("id = 'a'"), "id", "t")
    assert sorted((r.id, r.t) for r in once.collect()) == sorted((r.id, r.t) for r in again.collect())


def test_merge_guards(spark):
    base = spark.createDataFrame([("a", "", "[[P1]] x [[P2]]"), ("b", "", "y"), ("c", "", "[[P1]]")], "id string, t string, p string")
    batch = spark.createDataFrame([("a", "[[P2]] [[P1]]", []), ("b", "new", ["note"]), ("c", "z [[P1]]", [])], "id string, t string, extra array<string>")
    got = state.merge(base, batch, "id", "t", protected="p", language=F.col("_words").contains("z"))
    assert {r.id: r.verdict for r in got.collect()} == {"a": "tokens", "b": "extra_fields", "c": "merged"}


def test_strong_key_blocks_the_title(spark):
    schema = "item_id long, doi string, arxiv string, title string, year string"
    e = spark.createDataFrame(
        [(1, "10.1/a", None, "t", "2001", None), (2, None, None, "t", "2001", None), (3, None, "2001.00001", "t", "2001", "k9"), (4, None, "2001.00001", "t", "2001", "K7"), (5, None, None, "t", None, "K9")], schema + ", parent_key string"
    )
    c = spark.createDataFrame([(7, "10.1/b", None, "t", "2001", "K7", None), (8, "10.1/a", None, "u", "1999", "K8", None), (9, None, None, "t", None, "K9", "book"), (10, None, None, "t", None, "K9", "note")], schema + ", key string, kind string")
    assert {tuple(r) for r in joins.cascade(e, c).collect()} == {(1, 8, "doi"), (2, 7, "title+year"), (3, 9, "source-parent-key"), (4, 7, "source-parent-key")}


def test_identifiers(spark):
    lit = F.lit
    assert one(spark, text.doi(lit("https://doi.org/10.1234/AbC."))) == "10.1234/abc"
    assert one(spark, text.arxiv(lit("arXiv: 2001.00012v3"))) == "2001.00012"
    assert one(spark, text.arxiv(lit("nothing"))) is None
    assert one(spark, text.year(lit("May 1999"))) == "1999"
    assert [one(spark, c) for c in text.label(lit("see Fig. a2.1"))] == ["figure", "figure-A2.1"]
    assert [one(spark, c) for c in text.label(lit("算法 3"))] == ["figure", "algorithm-3"]
    assert one(spark, text.heading_level(lit("2.3.1 Methods"))) == 3
    assert one(spark, text.clean_lines(lit("An exam-\nple of\n\n text.\nNext"))) == "An example of text.\nNext"
    assert one(spark, text.balanced(lit("}{"), "{", "}")) is False


def test_protect_round_trip():
    for s in ("see https://a.b/c, 10.1234/x.y and arXiv:2001.00012v2", "took 5 ms [1, 2] (Smith 1999) $x+1$", "a [longer bracket with many plain prose words inside of it 7] b", "no literal"):
        out, found = protect.protect(s)
        for token, value in found.items():
            assert out.count(token) == 1
            out = out.replace(token, value)
        assert out == s
    assert protect.protect("5 meters")[0] == "[[P0001]] meters"
    assert protect.protect("(see 1999) [two words 5] (Smith 1999)")[0] == "(see [[P0001]]) [two words [[P0002]]] [[P0003]]"


def test_restore_refuses_repeats(spark):
    m = F.create_map(F.lit("[[P0001]]"), F.lit("v"))
    assert one(spark, text.restored(F.lit("x [[P0001]]"), m)) == "x v"
    assert one(spark, text.restored(F.lit("[[P0001]] [[P0001]]"), m)) is None
    assert one(spark, text.restored(F.lit("[[P0001]] [[P0002]]"), m)) is None


def test_strict_lines_and_exclusive_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "id string, n int")
    path = files.write_jsonl(df, str(tmp_path / "x"))
    with pytest.raises(PySparkException):
        files.read_jsonl_strict(spark, path, "id string, n int").collect()
    with pytest.raises(PySparkException):
        files.write_jsonl(df, path)
    assert files.read_jsonl(spark, path, "id string, n int").count() == 2


def test_review_is_applied_whole_or_not_at_all(spark):
    u = spark.createDataFrame([(d, i, f"{d}{i}", "t") for d in (1, 2) for i in (1, 2)], "doc_id long, ord long, id string, source_text string")
    ops = spark.createDataFrame([(1, 1, "replace", "11", "r"), (1, 2, "suppress", "12", None), (2, 1, "suppress", "21", None), (2, 2, "replace", "zz", "r")], "doc_id long, step long, op string, id string, text string")
    got = {(r.doc_id, r.id): r.source_text for r in state.replay(u, ops).collect()}
    assert got == {(1, "11"): "r", (2, "21"): "t", (2, "22"): "t"}
    ops = spark.createDataFrame([(1, 1, "insert", "11", "i"), (1, 2, "insert", "11-review", "j"), (1, 3, "suppress", "11", None), (1, 4, "replace", "11-review", "k")], "doc_id long, step long, op string, id string, text string")
    got = [(r.ord, r.id, r.source_text) for r in state.replay(u.filter("doc_id = 1"), ops).orderBy("ord").collect()]
    assert got == [(1, "11-review", "k"), (2, "11-review-review", "j"), (3, "12", "t")]


def test_list_flow(spark):
    rows = [("p", "Intro text", 10.0), ("a", "- first", 10.0), ("b", "goes on", 18.0), ("c", "- nested", 25.0), ("d", "- second", 10.0), ("e", "After", 10.0), ("f", "(12)", 10.0)]
    rows += [("g", "- one 2. two", 10.0), ("h", "text\n- late", 10.0), ("i", "(see\n- no item)", 10.0), ("j", "- last", 10.0)]
    data = [(1, i, k, 1, "body", t, False, x, 12.0 * k, 12.0 * k + 10, 10.0) for k, (i, t, x) in enumerate(rows)]
    data.append((1, "k", 90, 2, "body", "over the page", False, 18.0, 0.0, 10.0, 10.0))
    df = spark.createDataFrame(data, "doc_id long, id string, ord int, page int, kind string, source_text string, suppressed boolean, x0 double, y0 double, y1 double, size double")
    flow = folds.list_flow(df).collect()
    assert {r.id: r.review for r in flow if r.review} == {"g": "marks", "h": "marks", "k": "page"}
    got = {r.id: (r.flow_role, r.list_id, r.list_level) for r in flow if r.id in "pabcdef"}
    assert got == {
        "p": ("paragraph", None, 0), "a": ("list_item", "list-a", 0), "b": ("list_continuation", "list-a", 0), "c": ("list_item", "list-a", 1),
        "d": ("list_item", "list-a", 0), "e": ("paragraph", None, 0), "f": ("paragraph", None, 0),
    }


def test_spans_are_located_ambiguous_or_unmatched():
    assert folds.align("one two\n three one", ["one two", "three", "none"]) == [(0, 7, "located"), (9, 14, "located"), (None, None, "unmatched")]
    assert folds.align("x and x", ["x"]) == [(0, 1, "ambiguous")]
    assert folds.align("x and x", ["x", "and", "x"]) == [(0, 1, "located"), (2, 5, "located"), (6, 7, "located")]
    assert folds.align("an example", ["an exam-\nple"]) == [(0, 10, "located")]
    assert folds.align("an example", ["an exam-", "ple"], [0, 1]) == [(0, 7, "located"), (7, 10, "located")]
    assert folds.align("an example", ["an exam-", "ple"], [0, 0]) == [(None, None, "unmatched"), (7, 10, "located")]


def test_rich_protection():
    def run(text, style="text", size=10.0, flags=0, line=0):
        return {"text": text, "style": style, "size": size, "flags": flags, "font": "", "line": line}

    got = protect.protect_rich("u-1", "Bold and it is 5 km [3]", [run("Bold", "bold"), run(" and "), run("it is", "italic"), run(" 5 km [3]")])
    assert got["text"] == "[[Bu1_0001_OPEN]]Bold[[Bu1_0001_CLOSE]] and [[Iu1_0002_OPEN]]it is[[Iu1_0002_CLOSE]] [[P0001]] [[Fu1_0001]]"
    assert got["literals"] == {"[[P0001]]": "5 km"} and got["fragments"] == {"[[Fu1_0001]]": "[3]"} and got["block"] == "normal"
    assert protect.protect_rich("u", "", []) == {"text": "", "literals": {}, "fragments": {}, "kinds": {}, "styles": {}, "block": "normal"}


def test_visuals_are_used_once(spark):
    schema = "page long, n long, kind string, x0 double, y0 double, x1 double, y1 double"
    c = spark.createDataFrame([(1, 1, "figure", 0.0, 50.0, 10.0, 55.0), (1, 2, "figure", 0.0, 52.0, 10.0, 57.0), (1, 3, "table", 0.0, 0.0, 9.0, 1.0)], schema)
    v = spark.createDataFrame([(1, 1, "figure", 0.0, 30.0, 10.0, 49.0), (1, 2, "figure", 40.0, 30.0, 50.0, 50.0)], schema)
    assert {(r.caption, r.visual) for r in folds.nearest_exclusive(c, v).collect()} == {(1, 1), (2, 2), (3, None)}
