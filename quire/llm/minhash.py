"""MinHash near-duplicate detection by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum,
so `bands * rows` values need half as many hash evaluations. A band joins the minima and maxima of
rows/2 permutations. With 32 bands of 6 values, texts of similarity 0.8 share a band with
probability 1 - (1 - 0.8^6)^32 > 0.9999.

Of small sets minimum and maximum are far from independent, so sets of at most PREFIX_SIZE shingles
have more keys: their smallest shingle hashes, as many as any set of the similarity must share one of.
Pairs of which the smaller has up to 20 shingles are met for certain.

No group is ever expanded into pairs of rows: texts with equal shingle sets are one node; each node
is compared with the leads of its buckets, a lead being the member that shares most buckets with
others; and only where a bucket still holds several components are the rest compared, by signature
and then by full sets inside blocks of bounded size. Every link is decided on full sets of 64-bit
shingle hashes before it may stand for others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import connected_components
from quire.llm.text import frugal, mix64, shingle_sets, slices
from quire.session import cut, ship

#: Sets of at most so many shingles are also met by their smallest hashes: at similarity 0.8, a set of 20 has partners of 25.
PREFIX_SIZE = 25
#: Shingles that a block of sets holds at most, unless single sets are larger; bounds the memory of a comparison.
BLOCK_SHINGLES = 1 << 20
#: Members of a star, or of one of its parts, that one group compares with the lead.
STAR_ROWS = 256

_SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


class MinMax:
    """The permutations: x -> (x ^ b) * a over 32-bit hashes, a odd."""

    def __init__(self, bands: int = 32, rows: int = 6, seed: int = 7):
        if rows % 2:
            raise ValueError("a band holds minimum and maximum of each permutation: rows must be even")
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minimum and maximum under each permutation."""
        h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = high = None
        for at in range(0, len(h), 4096):
            v = (h[None, at : at + 4096] ^ self.b[:, None]) * self.a[:, None]
            lo, hi = v.min(1), v.max(1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return low, high

    def prefix_keys(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The smallest hashes of a small set: a set of the similarity with as many or more shingles shares one with it."""
        n = len(shingles)
        if n > PREFIX_SIZE:
            return shingles[:0].view(np.int64)
        return mix64(shingles[: n - -(-percent * n // 100) + 1] + np.uint64(0x51ED2701)).view(np.int64)

    def band_keys(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One 64-bit key a band for signatures stacked by row; the band's number is part of it."""
        n = len(low)
        half = self.rows // 2
        lo = low.reshape(n, self.bands, half).astype(np.uint64)
        hi = high.reshape(n, self.bands, half).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (n, self.bands)).copy()
        for i in range(half):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + lo[:, :, i])
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hi[:, :, i])
        return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int, hashing: MinMax, percent: int = 80) -> DataFrame:
    """doc_id, set size, digest of the set, band keys and a sketch of one byte a signature value."""

    @frugal
    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for at, part in slices(text):
                sets = shingle_sets(part, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = [hashing.signature(sets[i]) for i in full]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    low, high = np.stack([x[0] for x in sig]), np.stack([x[1] for x in sig])
                    for i, k, s in zip(full, hashing.band_keys(low, high), np.concatenate([low, high], 1).astype(np.uint8)):
                        keys[i], sketch[i] = np.concatenate([k, hashing.prefix_keys(sets[i], percent)]), s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sketch, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNATURE)


def _similar(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int, share: float) -> np.ndarray:
    """Sizes allow the similarity, and the sketches agree in a share that a pair at the threshold reaches but by a chance below 1e-6."""
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    at = np.flatnonzero(ok)
    ok[at] = (left[at] == right[at]).sum(1) >= share * left.shape[1]
    return ok


def _stack(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()]) if len(column) else np.zeros((0, 1), np.uint8)


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Sorted distinct shingle hashes of two texts reach the similarity."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    small, large = (x, y) if n <= m else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both > 0 and 100 * both >= percent * (n + m - both)


def _shingles(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node, n, shingles (sorted 64-bit hashes as bytes) of the texts of ids (node)."""

    @frugal
    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                sets = shingle_sets(part, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(ids, "node", "left_semi")
    return rows.mapInArrow(run, "node long, n long, shingles binary").filter("n > 0")


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that reach the similarity. Each set moves once a pair, the set of a lead a once a part of its star."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).alias("parts"))
    placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    leads = placed.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("node"))
    rows = leads.union(placed.select("a", "part", F.lit(1), "b")).join(sets.select("node", "shingles"), "node")

    @frugal
    def run(batches):
        star, lead, hit = None, [], []
        for batch in batches:
            a, part, role, node = (batch.column(i).to_pylist() for i in range(4))
            hit = []
            for i in range(batch.num_rows):
                if (a[i], part[i]) != star:
                    star, lead = (a[i], part[i]), []
                x = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if role[i] == 0:
                    lead.append(x.copy())
                elif any(_reaches(x, y, percent) for y in lead):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([node[i] for i in hit], pa.int64())], ["a", "b"])

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").select("a", "part", "role", "node", "shingles")
    return rows.mapInArrow(run, "a long, b long").distinct()


_GROUP = ["key", "class", "i", "j"]


def _grouped(work):
    """Call work on the rows of one or more whole groups of a sorted partition; a group is at most two blocks."""

    @frugal
    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            group = np.stack([table.column(x).to_numpy() for x in _GROUP], 1)
            last = int(np.flatnonzero((group == group[-1]).all(1))[0])  # the last group may go on
            if last:
                yield from work(table.slice(0, last))
            kept = table.slice(last)
        if kept is not None and kept.num_rows:
            yield from work(kept)

    return run


def _with_partner(table: pa.Table, percent: int, share: float):
    """Rows that have a partner in another component whose sketch and size allow a link."""
    col = {x: table.column(x).to_numpy() for x in (*_GROUP, "side", "node", "part", "lead", "n")}
    sketch = _stack(table.column("sketch").combine_chunks())
    hit = np.zeros(table.num_rows, bool)
    for d in range(1, table.num_rows):
        same = np.ones(table.num_rows - d, bool)
        for x in _GROUP:
            same &= col[x][d:] == col[x][:-d]
        if not same.any():
            break
        same &= (col["part"][d:] != col["part"][:-d]) & ((col["side"][d:] == 0) | (col["side"][d:] != col["side"][:-d]))
        same &= (col["node"][d:] != col["lead"][d:]) & (col["node"][:-d] != col["lead"][:-d])  # those are compared already
        at = np.flatnonzero(same)
        at = at[_similar(sketch[at], sketch[at + d], col["n"][at], col["n"][at + d], percent, share)]
        hit[at] = hit[at + d] = True
    if hit.any():
        yield from table.filter(pa.array(hit)).select([*_GROUP, "side", "node", "part"]).to_batches()


def _joining_pairs(table: pa.Table, percent: int):
    """Of each group the linked pairs that join components: a forest, not all pairs.

    Common shingles are counted by products of the 0/1 matrix of the group's shared shingles, some
    columns at a time; the counts are exact, so a pair that joins two components is a link for certain.
    """
    col = {x: table.column(x).to_numpy() for x in (*_GROUP, "side", "node", "part")}
    group = np.stack([col[x] for x in _GROUP], 1)
    edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1), [True]]))
    stored = table.column("shingles")
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        m = hi - lo
        if m < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in stored.slice(lo, m)]
        n = np.array([len(x) for x in sets])
        _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(m, dtype=np.int32), n)
        shared = times[where] > 1
        place = np.cumsum(times > 1, dtype=np.int64)[where[shared]] - 1
        who, width = who[shared], int((times > 1).sum())
        both = np.zeros((m, m), np.float32)
        order = np.argsort(place, kind="stable")
        place, who = place[order], who[order]
        for at in range(0, width, 2048):
            x, y = np.searchsorted(place, [at, at + 2048])
            part = np.zeros((m, min(2048, width - at)), np.float32)
            part[who[x:y], place[x:y] - at] = 1
            both += part @ part.T
        ok = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
        side, comp, node = (col[x][lo:hi] for x in ("side", "part", "node"))
        ok &= comp[:, None] != comp[None, :]
        if side.any():
            ok &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(ok, 1))
        root: dict = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _blocks(rest: DataFrame, percent: int, block: int) -> DataFrame:
    """Members of mixed buckets (key, node, part, lead, size, n, sketch) dealt out to groups (key, class, i, j).

    A bucket of more than `block` members is cut by classes of set size: sets of the similarity stand in the
    same class or in neighbouring ones. A class is cut into blocks of at most `block` members and about BLOCK_SHINGLES
    shingles, and each pair of blocks of one class or of neighbours is a group: i and j are the blocks, side is 0 in groups
    of one block, else 1 or 2.
    """
    step = float(np.log(100 / percent * 1.01))
    of = F.when(F.col("size") > block, F.floor(F.log(F.col("n").cast("double")) / step)).otherwise(-1).cast("int")
    rest = rest.withColumn("class", of)
    most = F.greatest(F.lit(16), F.least(F.lit(block), F.floor(BLOCK_SHINGLES / F.greatest(F.max("n"), F.lit(1)))))
    cut_in = rest.groupBy("key", "class").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    after = cut_in.select("key", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    before = cut_in.select("key", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    place = cut_in.join(after, ["key", "class"], "left").join(before, ["key", "class"], "left")
    rest = rest.join(place, ["key", "class"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # groups of its own class: with itself, and with each other block; then blocks of the class above and below
    count = lambda c: F.when(F.col("class") >= 0, F.coalesce(c, F.lit(0))).otherwise(0)
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(
        many(F.col("blocks")),
        lambda x: F.struct(F.col("class").alias("class"), F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), F.when(x == F.col("own"), 0).when(x > F.col("own"), 1).otherwise(2).alias("side")),
    )
    # a group of two classes is named by the lower one, and its i is told from own groups by a negative sign
    up = F.transform(many(count(F.col("above"))), lambda x: F.struct(F.col("class").alias("class"), (-1 - F.col("own")).alias("i"), x.alias("j"), F.lit(1).alias("side")))
    down = F.transform(many(count(F.col("below"))), lambda x: F.struct((F.col("class") - 1).alias("class"), (-1 - x).alias("i"), F.col("own").alias("j"), F.lit(2).alias("side")))
    rest = rest.withColumn("g", F.explode(F.concat(own, up, down)))
    return rest.select("key", "g.class", "g.i", "g.j", "g.side", "node", "part", "lead", "n", "sketch")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 6,
    block: int = 512,
    slack: float = 0.15,
) -> DataFrame:
    """Components of documents whose shingle sets reach `percent` similarity.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_shingles, component_id, kept.
    Defined results: null, empty or blank text has an empty set and is linked with nothing; rows that
    repeat a doc_id are one document, linked by any of its texts; a row whose doc_id is null takes the
    smallest doc_id of its component (null if none) and is never kept; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    hashing, share = MinMax(bands, rows), percent / 100 - slack
    sig = cut(signatures(docs, shingle, hashing, percent))
    groups = sig.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = (
        sig.filter("digest is not null")
        .join(groups.filter("node is not null").withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node")))
        .dropDuplicates(["node", "digest"])
        .select("node", F.col("n_shingles").alias("n"), "bands", "sketch")
    )
    nodes = cut(nodes)
    members = nodes.select("node", F.explode(F.array_distinct("bands")).alias("key")).distinct()
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = cut(members.join(shared, "key"))
    # of a bucket the node with most company leads: the text that many copies were made from rather than one of them
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    leads = buckets.select("key", "node").join(company, "node").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("lead"), "company"), F.struct("company", -F.col("node"))).alias("l"))
    buckets = cut(buckets.join(leads.select("key", "l.*"), "key"))
    sets = cut(_shingles(docs, buckets.select("node").distinct(), shingle))

    # first one lead for each node, then its other leads where these links don't join them already
    stars = cut(buckets.filter("node != lead").groupBy(F.col("node").alias("b"), F.col("lead").alias("a")).agg(F.max("company").alias("company")))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("company", -F.col("a"))).alias("a"))
    links = cut(_star_links(best.select("a", "b"), sets, percent))
    known = links.select("b", F.col("a").alias("hub"))
    left = stars.join(best.withColumnRenamed("a", "tried"), "b").filter("a != tried").select("a", "b").join(known, "b", "left")
    left = left.join(known.select(F.col("b").alias("a"), F.col("hub").alias("hub_a")), "a", "left")
    left = left.filter("coalesce(hub, b) != coalesce(hub_a, a)").select("a", "b")
    facts = nodes.select("node", F.struct("n", "sketch").alias("f"))

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                c = [batch.column(i) for i in range(6)]
                ok = _similar(_stack(c[4]), _stack(c[5]), c[2].to_numpy(), c[3].to_numpy(), percent, share)
                yield batch.select([0, 1]).filter(pa.array(ok))

    both = left.join(facts.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").join(facts.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
    both = both.select("a", "b", "fa.n", F.col("fb.n").alias("m"), F.col("fa.sketch"), F.col("fb.sketch").alias("t"))
    left = cut(both.mapInArrow(likely, "a long, b long").distinct())
    links = links.union(cut(_star_links(left, sets, percent)))
    part = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # buckets in which several components are left
    known = buckets.join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component_id", "node"))
    mixed = known.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("key")
    rest = known.join(mixed, "key").join(nodes.select("node", "n", "sketch"), "node").select("key", "node", "part", "lead", "size", "n", "sketch")
    rest = _blocks(rest, percent, block).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    # members with a likely partner in another component; then, for those alone, full sets
    whole = "key long, class int, i int, j int, side int, node long, part long"
    near = cut(rest.mapInArrow(_grouped(lambda t: _with_partner(t, percent, share)), whole))
    near = near.join(sets.select("node", "shingles"), "node").select(*_GROUP, "side", "node", "part", "shingles").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    more = cut(near.mapInArrow(_grouped(lambda t: _joining_pairs(t, percent)), "a long, b long"))
    if not more.isEmpty():
        part = connected_components(links.union(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    part = groups.join(part, groups["node"] == part["id"], "left").select("digest", F.coalesce("component_id", "node").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "digest").join(part, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near-copies: of each component the document of the smallest doc_id.

    Rows without doc_id are known by a hash of their text; of rows that repeat both id and text one stays.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), -(F.shiftrightunsigned(F.xxhash64("text"), 2)) - 1)
    keyed = docs.withColumn("md_key", key)
    kept = near_duplicates(keyed.select(F.col("md_key").alias("doc_id"), "text"), **settings).filter("kept").select(F.col("doc_id").alias("md_key")).distinct()
    rows = keyed.join(kept, "md_key", "left_semi").withColumn("md_text", F.xxhash64("text"))
    return rows.dropDuplicates(["md_key", "md_text"]).select(*docs.columns)
