import re
from collections import Counter, defaultdict

from quire.llm.quality import passing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def fold(word):
    return re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in word))


def lines(text):
    return [tuple(map(fold, WORD.findall(x))) for x in (text or "").split("\n") if WORD.search(x)]


def test_counts_of_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality(docs).collect()}
    assert got == {r.doc_id: counts(r.text) for r in docs.collect()}
    assert all(r.kept == (not r.base_failed) for r in quality(docs, least=10**9).collect())


def test_lines_above_the_limit(spark):
    nav = "Home 12 about us contact terms of use privacy and more links here please"
    rows = []
    for i in range(60):
        own = "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(9)) for j in range(8))
        rows.append((i, own + "\n" + nav.replace("12", str(i)).upper(), "h1"))
    for i in range(60, 90):  # little else but the line
        rows.append((i, "\n".join([nav, *(f"{nav} {j} of" for j in range(4)), f"own{i}"]), "h1"))
    body = "\n".join(" ".join(f"c{j}d{k}" for k in range(9)) for j in range(9))
    rows += [(100 + i, body, "h1") for i in range(40)]  # exact copies count once
    rows += [(200 + i, rows[i][1], "h2") for i in range(3)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # brute force: texts by the set of lines; only lines of more than 20 texts and 5 percent
    texts = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(tuple(lines(t)))
    for i, t, s in rows:
        n = Counter(x for u in texts[s] for x in set(u))
        common = {x for x, c in n.items() if c > 20 and 100 * c > 5 * len(texts[s])}
        lost = sum(len(x) for x in lines(t) if x in common)
        assert got[i].boilerplate_words == lost, i
        assert got[i].kept == (not got[i].base_failed and 100 * (got[i].n_words - lost) >= 30 * got[i].n_words)
    assert not any(got[i].kept for i in range(60, 90)) and all(got[i].kept for i in [*range(60), *range(100, 140)])


def test_every_distinct_text_counts(spark):
    def name(i):  # no digits: they fold to 0
        return "".join("abcdefghij"[int(d)] for d in f"{i:03d}")

    shared = [" ".join(f"{w}shared{name(j)}" for w in "pqrstuvwx") for j in range(10)]
    own = [[" ".join(f"{w}own{name(i)}" for w in "abcdefghijklmnopqr"[9 * k : 9 * k + 9]) for k in range(2)] for i in range(200)]
    rows = [(i, "\n".join(shared + own[i]), "h") for i in range(200)]
    rows += [(1000 + i, "\n".join(shared[:3] + ["copied " + " ".join(shared)]), "h") for i in range(50)]  # one text
    few = [(2000 + i, "\n".join(shared + own[i]), "few") for i in range(20)]  # not above 20
    rows += few
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i].boilerplate_words for i in range(200)} == {90}
    assert {got[1000 + i].boilerplate_words for i in range(50)} == {27}
    assert {got[i].boilerplate_words for i, _, _ in few} == {0}
    assert not any(got[i].kept for i in range(200)) and all(got[i].kept for i, _, _ in few)


def test_boilerplate_lines_go(spark):
    def name(i):
        return "".join("abcdefghij"[int(d)] for d in f"{i:03d}")

    nav, legal = "Home 12 \t about us  and MORE links", "\r\u00a9 all rights reserved here"
    rows = []
    for i in range(60):
        own = [" ".join(f"{w}\u00e9own{name(i)}{name(k)}" for w in "abcdefg") + "  " for k in range(9)]
        rows.append((i, "\n".join([nav.replace("12", str(i + 10)), own[0], "", nav.upper(), *own[1:], " ", legal] + [""] * (i % 3)), "h", 7))
    rows += [(100 + i, "\n".join([nav, legal, *(f"r{name(i)} {w} end" for w in "abcdefghijklmnopqrst")]), "other", 7) for i in range(5)]
    rows += [(200, "\n".join([nav, legal] * 20 + ["x"]), "h", 7), (None, rows[3][1], "h", 7), (3, rows[4][1], "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    want = []
    for i, t, s, n in rows:
        gone = {tuple(map(fold, WORD.findall(x))) for x in (nav, legal)} if s == "h" else set()
        left = "\n".join(x for x in t.split("\n") if tuple(map(fold, WORD.findall(x))) not in gone)
        if i != 200:  # nothing but such lines
            want.append((i, left, s, len(left) if left != t else n))
    got = passing(docs)
    assert got.schema == docs.schema
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(x[1] == y[1] for x, y in zip(want, rows)) == 5


def test_edges(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "é ü # $", "x\n x\nx\nx", "z" * 100_000 + " " + "long " * 60_000]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)] + [(0, "a b", "s", 2)], "doc_id long, text string, source string, n_words int")
    got = sorted(tuple(r)[:7] for r in quality(df).collect())
    assert got == sorted((i, *counts(t)) for i, t in [*enumerate(texts), (0, "a b")])
    assert quality(df.limit(0)).count() == 0
