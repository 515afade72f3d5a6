import numpy as np

from quire.llm.embed import _codes, hyperplanes, near_vectors, tables_for


def brute(rows, cosine):
    ids = [i for i, _ in rows]
    ok, x = [], []
    for _, v in rows:
        good = v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        ok.append(good)
        x.append(np.array(v, float) / np.linalg.norm(v) if good else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= cosine:
                links[a] += 1
                links[b] += 1
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    part = {}
    for a in range(n):
        part.setdefault(find(a), []).append(ids[a])
    return sorted((ids[a], links[a], min(part[find(a)]), ids[a] == min(part[find(a)])) for a in range(n))


def got(df, **settings):
    return sorted(tuple(r) for r in near_vectors(df, **settings).collect())


def test_whole_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()], 0.95)


def test_large_groups_and_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(1000 + i, (base + 0.09 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(i, base.tolist()) for i in range(40, 60)]  # exact copies
    rows += [(10, None), (11, []), (12, [0.0] * 16), (13, [float("nan")] + [1.0] * 15), (14, [None] + [1.0] * 15), (15, [float("inf")] * 16)]
    rows += [(16, [1e200] * 16), (17, [1e-200] * 16), (18, [1.0, 0.0]), (19, [1.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    mine = got(df, block=32)
    want = brute([(i, None if v is None else [c / 1e200 if c == 1e200 else c * 1e200 if c == 1e-200 else c for c in v] if v and None not in v else v) for i, v in rows], 0.95)
    assert mine == want
    assert near_vectors(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.01]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in rows) == [("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", False), ("None", 2, "3", False)]


def test_tables_keep_the_recall():
    for n in (10, 10**4, 10**6, 10**9):
        tables, signs = tables_for(n, 0.95)
        share = (1 - np.arccos(0.95) / np.pi) ** signs
        assert (1 - share) ** tables <= 1e-4 and (signs >= np.log2(n) or n > 2**30)
    assert tables_for(10**6, 0.5)[0] <= 1024


def test_codes_hang_on_the_vector_alone():
    x = np.random.default_rng(1).standard_normal((300, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planes = hyperplanes(40, 7, 9, 3)
    whole = _codes(x, planes, 7, 9)
    assert all((_codes(x[i : i + 1], planes, 7, 9)[0] == whole[i]).all() for i in range(300))
    assert (np.concatenate([_codes(x[a : a + 37], planes, 7, 9) for a in range(0, 300, 37)]) == whole).all()
