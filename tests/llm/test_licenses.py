import random
import re

from quire.llm.licenses import PERCENT, TEMPLATES, scan


def fold(text):
    return re.sub("[0-9]", "0", "".join((c.lower() if c.isalnum() else " ") if c.isascii() else c for c in text)).split()


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text):
    """Licenses of whichever template has enough shingles in some stretch."""
    s, found = shingles(fold(text or "")), []
    for name, template in TEMPLATES:
        t = set(shingles(fold(template)))
        reach = len(t) + -(-len(t) // 4)
        best = max((len(t & set(s[i : i + reach])) for i in range(len(s)) if s[i] in t), default=0)
        if 100 * best >= PERCENT * len(t):
            found.append((best, name))
    return found


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert got and set(got) == {d for d, x in want.items() if x}
    assert all(names <= {n for _, n in want[d]} for d, names in got.items())
    assert all(max(want[d])[1] in names for d, names in got.items())


def test_edited_templates_and_edges(spark):
    filler = " ".join(f"w{i}" for i in range(400))
    rows, want = [], {}
    for i, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 35:
            words[20] = "changed"
        rows.append((i, f"{filler} x{i} {' '.join(words).upper()} {filler}", name))
        want[i] = {name}
    rows += [(105, "Licensed under the Apache License, Version 1.1", ""), (106, "Licensed under the Apache License, Version 2.0", "")]
    want |= {105: {"Apache"}, 106: {"Apache-2.0"}}
    rows += [(100, None, ""), (101, "", ""), (102, "MIT License", ""), (103, "Released under the MIT License.", ""), (104, "a " * 200_000 + "Licensed under CC BY-NC 3.0.", "")]
    want |= {103: {"MIT"}, 104: {"CC-BY-NC"}}
    got = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == want
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_end_with_their_text(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(300):  # edited notices between other texts of all lengths; only their own words decide
        name, text = TEMPLATES[i % len(TEMPLATES)]
        words = text.split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        rows.append((2 * i, " ".join(f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60)))))
        rows.append((2 * i + 1, " ".join(words)))
        want[2 * i + 1] = {n for _, n in brute(rows[-1][1])}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {}
    for r in scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert set(got) == {d for d, x in want.items() if x} and all(x <= want[d] for d, x in got.items())


def test_full_texts(spark):
    full = [t for t in TEMPLATES if len(t[1].split()) > 100]
    rows = [(i, "Copyright 2020 Someone\n\n" + text.replace(". ", ".\n\n")) for i, (_, text) in enumerate(full)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, name) for i, (name, _) in enumerate(full)] and len(full) >= 5
    assert all(r.containment == 100 for r in got)
