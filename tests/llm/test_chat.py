import itertools
import random

import numpy as np
import pytest

from quire.llm import chat
from quire.llm.chat import _STATES, STYLES, Hmm, between, features, learn, parse, rendered, role_of, symbols, transcript, transcripts


def test_whole_table_comes_back(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.role, r.text, r.rendered) for r in parse(transcripts(turns), learn(turns)).collect())
    assert got == sorted((r.conv_id, r.turn, r.role, r.text, rendered(r.role, r.text)) for r in turns.collect())


def test_viterbi_against_all_paths(spark, sf_dir):
    m = learn(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    from quire.llm.chat import _MARKS, _SHAPES

    text = "Human: is it so?\nyes or no\nBot: no.\nNote: maybe"
    seen = [features(x)[:2] for x in text.split("\n")]

    def score(path):
        s = m.start[path[0]]
        for k, p in enumerate(path):
            s += m.mark[p][_MARKS.index(seen[k][0])] + m.shape[p][_SHAPES.index(seen[k][1])] + (m.move[path[k - 1]][p] if k else 0)
        return s

    best = max(itertools.product(range(len(_STATES)), repeat=len(seen)), key=score)
    assert m.viterbi(seen) == [_STATES[p] for p in best]
    assert m.parse(text) == [("user", "is it so?\nyes or no"), ("assistant", "no.\nNote: maybe")]


def test_styles_and_edges(spark, sf_dir):
    m = learn(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = [("system", "Be brief."), ("user", "One line\nand another?"), ("assistant", "Here:\n- a\n\n- b"), ("user", "x" * 100_000)]
    for style in range(len(STYLES)):
        assert m.parse(transcript(turns, style)) == turns
    assert m.parse("") == [] and Hmm().fixed().parse("no marker\nat all")
    rows = [(1, 0, None, None), (1, 2, "assistant", "a"), (1, 7, "Human", "b"), (2, 5, "robot", ""), (None, None, "user", "x")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(700)] + [(4, 0, "user", f"same {i}") for i in range(1600)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    lines = transcripts(df).collect()
    assert max(len(r.numbers) for r in lines) <= 1024 and {r.conv_id for r in lines if r.many} == {3, 4}
    got = parse(transcripts(df), m).collect()
    assert [(r.turn, r.role, r.text) for r in got if r.conv_id == 1] == [(0, "user", ""), (2, "assistant", "a"), (7, "user", "b")]
    assert sorted((r.turn, r.role, r.text) for r in got if r.conv_id == 3) == [r[1:] for r in rows if r[0] == 3]
    assert sorted(r.text for r in got if r.conv_id == 4) == sorted(f"same {i}" for i in range(1600))
    assert parse(transcripts(df.limit(0)), m).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "User: hi\nBot: yes"), (3, "User: hi")], "conv_id long, transcript string")
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in parse(odd, m).collect()) == [(3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes")]


def noisy(turns, rng, kind):
    """A transcript in which one marker in four is missing or misspelt, or lines quote a speaker."""
    out = []
    for role, text in turns:
        name = {"system": "System", "user": "User", "assistant": "Assistant"}[role]
        if kind == "quoted" and rng.random() < 0.25:
            text += f"\n> {rng.choice(('User', 'Assistant'))}: as was said"
        if kind == "missing" and rng.random() < 0.25 and out:
            out.append(text)
            continue
        if kind == "misspelt" and rng.random() < 0.25:
            at = rng.randrange(1, len(name) - 1)
            name = name[:at] + name[at + 1 :]
        out.append(f"{name}: {text}")
    return out


def accuracy(spark, sf_dir, kind):
    """Share of the lines of held-out transcripts that get their role."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m = learn(turns.filter("conv_id % 3 != 0"))
    rng, by, right, total = random.Random(5), {}, 0, 0
    for r in turns.filter("conv_id % 3 = 0").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in by.values():
        parts = noisy(conv, rng, kind)
        lines = [(role, line) for (role, _), part in zip(conv, parts) for line in part.split("\n")]
        states = m.viterbi([features(x)[:2] for _, x in lines])
        right += sum(role == s[0] for (role, _), s in zip(lines, states))
        total += len(lines)
    return right / total


@pytest.mark.parametrize("kind, least", [("plain", 1.0), ("quoted", 0.97), ("misspelt", 0.95), ("missing", 0.85)])
def test_imperfect_markers(spark, sf_dir, kind, least):
    got = accuracy(spark, sf_dir.replace("0.001", "0.01"), kind)
    print(kind, got)
    assert got >= least


def test_misspelt_names():
    assert [role_of(x) for x in ("Asistant", "usre", "Users", "humam", "a", "bo", "note", "sytem", "AI")] == ["assistant", "user", "user", "user", "assistant", None, None, "system", "assistant"]


def test_parts_are_decoded_as_one_pass(spark, sf_dir, monkeypatch):
    m = learn(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rng = random.Random(8)
    lines = [rng.choice(["User: so?", "Assistant: yes", "no marker here", "and on", " ", "what?", "System: x"]) for _ in range(1000)]
    seen = symbols([features(x)[:2] for x in lines])
    whole = m.paths([seen])[0]
    cuts = sorted(rng.sample(range(1, 1000), 40))
    parts = [seen[a:b] for a, b in zip([0, *cuts], [*cuts, 1000])]
    last = between([m.matrix(p, i == 0) for i, p in enumerate(parts)])
    got = m.paths(parts, [-1, *last[:-1]], last)
    assert (np.concatenate(got) == whole).all()
    monkeypatch.setattr(chat, "PARTS_TOGETHER", 4)  # groups of groups
    rows = [(1, [i], True, None, "\n".join(lines[a:b])) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 1000]))]
    df = spark.createDataFrame(rows, "conv_id long, part array<long>, many boolean, numbers array<long>, transcript string")
    found = sorted((r.part[0], r.turn, r.role, r.text) for r in parse(df, m).collect())
    want = [(i, k, role, text) for (_, (i,), _, _, t), states in zip(rows, got) for k, (role, text, _) in enumerate(m.turns(t, states))]
    assert found == want


def test_learns_from_whole_conversations(spark, monkeypatch):
    rows = [(c, i, ("user", "assistant")[i % 2], f"turn {i} of {c}") for c in range(10) for i in range(200)]
    rows += [(None, i, "user", f"t{i}") for i in range(5)] + [(99, i % 7, "user", f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = []
    monkeypatch.setattr(Hmm, "learn", lambda self, turns, style: seen.append(sorted(t for _, t in turns)))

    def conversations(df, **bounds):
        seen.clear()
        learn(df, 12, **bounds)
        assert len(seen) % len(STYLES) == 0
        return seen[:: len(STYLES)]

    whole = {c: sorted(r[3] for r in rows if r[0] == c) for c in [*range(10), None, 99]}
    assert sorted(conversations(df)) == sorted(whole.values())
    some = conversations(df, most_rows=700).copy()
    assert all(x in whole.values() for x in some) and 600 <= sum(map(len, some)) <= 700
    assert conversations(df.repartition(5, "text"), most_rows=700) == some
    assert conversations(df, most_rows=4) == []
