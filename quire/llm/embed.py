"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, connected components.

Each of several tables takes some signs of projections on random directions. Vectors that share a
code in a table are compared by exact cosine in double precision, in blocks of bounded size. The
signs of a table are about log2 of the number of vectors, so a bucket holds few vectors by mere chance
however many there are, and there are as many tables as a pair at the threshold needs to
share one with probability 1 - MISS: with s signs, log(MISS) / log(1 - (1 - acos(cosine) / pi)^s).

What the tables deal out is ids and codes. Buckets of the same members are compared once, and a
vector moves once for each bucket that is left. A pair counts in the first table in which its
codes agree and nowhere else, so links are counted without listing them: what leaves a block is one
row a vector, its number of new links and a link into its component of the block. Projections
are of whole numbers, hence the same in every task, and codes are computed anew where they are needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quire.llm.graph import connected_components
from quire.llm.text import frugal
from quire.session import cut, ship

#: Probability that a pair at the threshold shares no bucket.
MISS = 1e-4
#: Rows of a block that are compared with all at a time.
_TILE = 512


def tables_for(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, signs of a table) for n vectors; fewer signs where a low cosine would need more than 1024 tables."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    signs = min(30, max(8, math.ceil(math.log2(max(2, n)))))
    while True:
        share = agree**signs
        tables = 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share)) if share > 1e-9 else 1 << 30
        if tables <= 1024 or signs == 1:
            return tables, signs
        signs -= 1


def hyperplanes(width: int, tables: int, signs: int, seed: int) -> np.ndarray:
    """Directions of all tables, one a row, as whole numbers of two digits."""
    return np.rint(np.random.default_rng(seed).standard_normal((tables * signs, width)) * 32)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = np.array(column.flatten(), np.float64).reshape(len(column), width)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(unit: np.ndarray, planes: np.ndarray, tables: int, signs: int) -> np.ndarray:
    """Codes of unit vectors by table. Sums of whole numbers below 2^53 are exact in any order."""
    out = np.empty((len(unit), tables), np.int32)
    for at in range(0, len(unit), 4096):
        side = (np.rint(unit[at : at + 4096] * (1 << 20)) @ planes.T >= 0).reshape(-1, tables, signs)
        out[at : at + 4096] = (side * (1 << np.arange(signs, dtype=np.int32))).sum(2, dtype=np.int32)
    return out


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the least of each component) with the components of a and b joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _block(table: pa.Table, cosine: float, tables: int, signs: int, planes: dict, seed: int) -> pa.Table | None:
    """Links of one block that no earlier table has: (node, links, other)."""
    width, at = table.column("width")[0].as_py(), table.column("at")[0].as_py()
    x = _unit(table.column("v").combine_chunks(), width)
    node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    count, root, codes = np.zeros(len(x), np.int64), np.arange(len(x)), None
    for lo in range(0, len(x), _TILE):
        linked = x[lo : lo + _TILE] @ x.T >= cosine
        linked[np.arange(len(linked)), lo + np.arange(len(linked))] = False
        if i[0] != j[0]:
            linked &= own[lo : lo + _TILE, None] != own[None, :]
        a, b = np.nonzero(linked)
        a = a + lo
        if len(a) and at and codes is None:
            if width not in planes:
                planes[width] = hyperplanes(width, tables, signs, seed)
            codes = _codes(x, planes[width], tables, signs)
        for t in range(at):
            if not len(a):
                break
            new = codes[a, t] != codes[b, t]
            a, b = a[new], b[new]
        if len(a):
            count += np.bincount(a, weights=weight[b], minlength=len(x)).astype(np.int64)
            root = _joined(root, a, b)
    some = np.flatnonzero(count)
    return pa.table({"node": node[some], "links": count[some], "other": node[root[some]]}) if len(some) else None


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = 2048, seed: int = 5, miss: float = MISS) -> DataFrame:
    """Links and components of vectors (vec_id, embedding) whose cosine is at least `cosine`.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.
    Equal vectors are one node that counts as often as it occurs. Null, empty and zero vectors and those with a null or
    non-finite component have no links and stand alone; vectors of different lengths are not linked; rows that repeat a vec_id count as rows
    of their own; a null vec_id is linked like others, is never kept, and its component_id is the smallest id reachable (null if none); an
    empty table gives no rows. Buckets of more than `block` vectors are split into blocks whose pairs are
    compared in separate groups; no partner is left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["embedding"].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"  # vectors move as they are
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{number}>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 is 0.0; the digest stands for the vector
    rows = rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform("v", lambda x: (x + F.lit(0.0)).cast(number))))
    rows = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256)))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    group = cut(rows.filter("v is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.min("row").alias("node"), F.count("*").alias("weight")))
    nodes = rows.select(F.col("row").alias("node"), "v").join(group.select("node", "weight"), "node").select("node", F.size("v").alias("width"), "v", "weight")
    tables, signs = tables_for(group.count(), cosine, miss)

    @frugal
    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for n in pc.unique(batch.column(1)).to_pylist():
                same = pa.table(batch).filter(pc.equal(batch.column(1), n)).combine_chunks()
                if n not in planes:
                    planes[n] = hyperplanes(n, tables, signs, seed)
                codes = _codes(_unit(same.column(2).combine_chunks(), n), planes[n], tables, signs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([same.column(0).combine_chunks(), same.column(1).combine_chunks(), lists], ["node", "width", "codes"])

    member = nodes.select("node", "width", "v").mapInArrow(coded, "node long, width int, codes array<int>")
    member = cut(member.select("node", F.posexplode("codes").alias("at", "code"), "width"))
    # a bucket is known by its members: size and exclusive or of the hashes of their ids; of equal buckets that of the first table stays
    bucket = member.groupBy("width", "at", "code").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("ids")).filter("size > 1")
    bucket = bucket.groupBy("ids", "size").agg(F.min(F.struct("at", "width", "code")).alias("b")).select("b.*", "size")
    place = member.join(bucket, ["width", "at", "code"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    place = place.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = place.select("node", "at", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    keys = ["width", "at", "code", "i", "j"]
    place = place.join(nodes, "node").select(*keys, "own", "node", "v", "weight").repartition(*keys).sortWithinPartitions(*keys)

    @frugal
    def compare(batches):
        kept, planes = None, {}

        def out(table):
            if table.num_rows > 1:
                found = _block(table, cosine, tables, signs, planes, seed)
                if found is not None:
                    yield from found.to_batches()

        for batch in batches:
            table = pa.table(batch) if kept is None else pa.concat_tables([kept, pa.table(batch)])
            if not table.num_rows:
                continue
            key = np.stack([table.column(k).to_numpy() for k in keys], 1)
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield from out(table.slice(lo, hi - lo))
            kept = table.slice(int(edges[-1]))  # the last group may go on
        if kept is not None and kept.num_rows:
            yield from out(kept)

    found = cut(place.mapInArrow(compare, "node long, links long, other long"))
    part = connected_components(found.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = group.join(links, "node", "left").join(part, group["node"] == part["id"], "left")
    group = group.select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("part"))
    least = group.groupBy("part").agg(F.min("least").alias("component_id"))
    out = rows.select("vec_id", "digest").join(group.join(least, "part").select("digest", "n_links", "component_id"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
