"""Rectangles on pages. Every pair is met through an equal page, so joins stay equi joins with a residual."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.folds import by_group

#: Share of the page's width from which a box is full width.
WIDE = 0.6


def overlap_area(a: str, b: str) -> Column:
    """Common area of the boxes whose columns begin with prefix a and b."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def rounded(c: str | Column, digits: int) -> Column:
    """A double rounded as SQL and C do, half away from zero after it is multiplied; F.round goes by its shortest decimal digits instead."""
    scaled = F.abs(c) * F.lit(10.0**digits)
    return F.signum(c) * (F.floor(scaled) + (scaled - F.floor(scaled) >= 0.5).cast("int")) / F.lit(10.0**digits)


def prefixed(df: DataFrame, p: str, keep: tuple[str, ...] = ("page",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{p}{c}") for c in df.columns])


def page_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes on one page, as a_* and b_*."""
    return prefixed(left, "a_").join(prefixed(right, "b_"), "page")


#: Height of the bands by which boxes of a page meet.
BAND = 64.0


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes of one page whose vertical extents touch, as a_* and b_*: they meet in the first band that both reach."""

    def banded(df, p):
        return prefixed(df, p).withColumn("band", F.explode(F.sequence(*[F.floor(F.col(f"{p}{y}") / BAND) for y in ("y0", "y1")])))

    both = banded(left, "a_").join(banded(right, "b_"), ["page", "band"])
    return both.filter(F.col("band") == F.greatest(F.floor(F.col("a_y0") / BAND), F.floor(F.col("b_y0") / BAND))).filter("a_y0 <= b_y1 and b_y0 <= a_y1").drop("band")


def covered_area(targets: DataFrame, regions: DataFrame) -> DataFrame:
    """For each box of targets (page, n, x0 .. y1) its area and how much of it the regions of its page cover, none counted twice.

    The regions' parts inside the box are cut into slabs at all their left and right edges, and in each slab the union of their vertical intervals is summed.
    """
    p = overlapping_pairs(targets, regions)
    key = ["page", "a_n"]
    cut = p.select(*key, *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in ("x0", "y0")], *[F.least(f"a_{c}", f"b_{c}").alias(c) for c in ("x1", "y1")]).filter("x0 < x1 and y0 < y1")
    edges = cut.select(*key, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*key).orderBy("left"))).filter("right is not null")
    rows = slabs.join(cut, key).filter("x0 <= left and x1 >= right")
    seen = F.max("y1").over(Window.partitionBy(*key, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(seen, F.col("y0"))))
    got = rows.withColumn("fresh", (F.col("right") - F.col("left")) * fresh).groupBy(*key).agg(F.sum("fresh").alias("covered"))
    return targets.select("page", F.col("n").alias("a_n"), area().alias("area")).join(got, key, "left").select("page", F.col("a_n").alias("n"), "area", F.coalesce("covered", F.lit(0.0)).alias("covered"))


#: Baselines of one line differ by a share of the size, at least so many points; those of formulas beside it by another (fixed values).
SAME_LINE, FORMULA_LINE = (1.0, 0.18), (2.0, 0.55)


def merged_lines(lines: DataFrame) -> DataFrame:
    """Visual lines of a page: line (the smallest n in it) of each of lines (page, n, kind, x0, x1, baseline, size).

    Body lines are one where their baselines differ by at most the tolerance of the first of them by n, and so on from line to line. A line of another kind joins the body
    line that it overlaps in x with the nearest baseline within its own tolerance, the first of equals. One fold a page over lines sorted by baseline, which looks no further than the largest tolerance.
    """

    def fold(page, rows):
        rows = [(b, n, kind, x0, x1, size) for _, b, n, kind, x0, x1, size in rows]
        body = [r for r in rows if r[2] == "body"]
        root = {r[1]: r[1] for r in rows}

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def join(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a

        tolerance = lambda r, rule: max(rule[0], round(rule[1] * r[5], 9))
        widest = max((tolerance(r, SAME_LINE) for r in body), default=0.0)
        for i, a in enumerate(body):
            for b in body[i + 1 :]:
                if b[0] - a[0] > widest:
                    break
                if b[0] - a[0] <= tolerance(min(a, b, key=lambda r: r[1]), SAME_LINE):
                    join(a[1], b[1])
        places = [r[0] for r in body]
        for r in rows:
            if r[2] != "body":
                t = tolerance(r, FORMULA_LINE)
                # a sum may be rounded to the other side of a place; the difference decides
                near = body[bisect_left(places, r[0] - t - 1e-6) : bisect_right(places, r[0] + t + 1e-6)]
                near = [b for b in near if abs(r[0] - b[0]) <= t and min(r[4], b[4]) > max(r[3], b[3])]
                if near:
                    join(r[1], min(near, key=lambda b: (abs(b[0] - r[0]), b[1]))[1])
        return [(page, r[1], find(r[1])) for r in rows]

    return by_group(lines.select("page", "baseline", "n", "kind", "x0", "x1", "size"), "page", ["baseline", "n"], fold, "page long, n int, line int")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Place of each of boxes (page, n, x0, y0, x1) on its page: wide boxes split it into bands; inside a band the left lane comes before the right one.

    Rows are dealt out by page and sorted once, by y0, x0 and n. In that order a band is a stretch that begins with its wide box, so a stable sort by stretch and lane gives the places; pages are held while they last.
    """

    def pages(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("page").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, x0, x1 = pages(batch), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1"))
        begins = np.append(True, page[1:] != page[:-1])
        first, which = np.flatnonzero(begins), np.cumsum(begins) - 1
        left, right = np.fmin.reduceat(x0, first)[which], np.fmax.reduceat(x1, first)[which]
        wide = x1 - x0 >= WIDE * (right - left)
        lane = np.where(wide, 0, np.where((x0 + x1) / 2 < (left + right) / 2, 1, 2))
        order = np.argsort(np.cumsum(begins | wide) * 4 + lane, kind="stable")
        place = np.empty(len(page), np.int32)
        place[order] = np.arange(len(page)) - first[which] + 1
        return pa.RecordBatch.from_arrays([batch.column("page"), batch.column("n"), pa.array(place)], ["page", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            page = pages(batch)
            # rows before the last page that the batch reaches, which may go on in the next one
            whole = int(np.searchsorted(page, page[-1]))
            if held and page[0] != pages(held[-1])[-1]:
                yield places(pa.concat_batches(held))
                held = []
            if whole:
                yield places(pa.concat_batches([*held, batch.slice(0, whole)]))
                held, batch = [], batch.slice(whole)
            held.append(batch)
        if held:
            yield places(pa.concat_batches(held))

    rows = boxes.select("page", "n", "x0", "y0", "x1").repartition("page").sortWithinPartitions("page", "y0", "x0", "n")
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    return rows.mapInArrow(run, f"page {kinds['page']}, n {kinds['n']}, place int")


def column_vote(df: DataFrame, by: list[str]) -> DataFrame:
    """Two columns where at least two boxes lie left and two right of the page's middle part and overlap vertically."""
    w = Window.partitionBy(*by)
    left, right = F.min("x0").over(w), F.max("x1").over(w)
    df = df.withColumn("side", F.when(F.col("x1") <= left + 0.61 * (right - left), "L").when(F.col("x0") >= left + 0.39 * (right - left), "R"))
    return df.groupBy(*by).agg(F.when((F.count_if(F.col("side") == "L") >= 2) & (F.count_if(F.col("side") == "R") >= 2), 2).otherwise(1).alias("columns"))
