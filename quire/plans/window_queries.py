"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import windows as W
from quire.operators.units import BOXES_SQL, DONE_SQL, UNITS_SQL, boxes, completed, table, units

BUDGET = 120


def win_runsum_budget(spark, sf):
    """The next work packet of each unfinished document: within the word budget, with its neighbours' ids."""
    u = units(spark, sf).join(completed(spark, sf), "doc_id", "left_anti").filter("translatable")
    near = W.ordered("doc_id")
    u = u.withColumn("before", F.lag("id").over(near)).withColumn("after", F.lead("id").over(near)).withColumn("done", F.col("words") == 0)
    p = W.budget_prefix(u, ["doc_id"], "ord", "words", "done", BUDGET)
    return p.groupBy("doc_id").agg(
        F.min_by("id", "ord").alias("first_id"), F.max_by("id", "ord").alias("last_id"), F.min_by("before", "ord").alias("context_before"),
        F.max_by("after", "ord").alias("context_after"), F.count("*").alias("n_units"), F.sum("words").alias("source_words"),
    ).withColumn("oversized", F.col("source_words") > BUDGET)


def win_pack_all(spark, sf):
    return W.pack_all(units(spark, sf).filter("translatable"), ["doc_id"], "ord", "words", BUDGET)


def win_ffill_section(spark, sf):
    u = W.forward_fill(units(spark, sf), ["doc_id"], "ord", F.col("kind").isin("heading", "caption"), F.col("source_text"), "section")
    return u.select("id", "section")


def win_renumber(spark, sf):
    return W.renumber(units(spark, sf).filter("translatable"), ["doc_id"], "page", "ord").select("id", "new_order", "page_order")


def win_pairwise(spark, sf):
    w = W.ordered("doc_id", "page")
    u = units(spark, sf).withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_text", F.lead("source_text").over(w))
    hit = (F.col("kind") == "caption") & (F.col("next_kind") == "body") & (F.length("next_text") < 200)
    return u.filter(hit).select("id", "next_text")


def win_islands_cont(spark, sf):
    """Paragraph groups: a body unit goes on where the one before has no terminal punctuation and the same kind."""
    w = W.ordered("doc_id")
    u = units(spark, sf).withColumn("p_text", F.lag("source_text").over(w)).withColumn("p_kind", F.lag("kind").over(w))
    u = W.islands(u, ["doc_id"], "ord", (F.col("kind") == "body") & (F.col("p_kind") == "body") & ~F.col("p_text").rlike(r"[.!?:;]$"))
    g = u.groupBy("doc_id", "island").agg(F.min_by("id", "ord").alias("first_id"), F.count("*").alias("n_units"), F.sum("words").alias("words"))
    return g.select("doc_id", F.col("island").cast("long").alias("island"), "first_id", "n_units", "words")


def win_after_caption(spark, sf):
    """After a caption, short body units are figure text until a heading, table or longer unit."""
    u = units(spark, sf)
    w = W.ordered("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long_body = (F.col("kind") == "body") & (F.length("source_text") >= 120)
    mark = F.when(F.col("kind") == "caption", 1).when(F.col("kind").isin("heading", "table") | long_body, 0)
    u = u.withColumn("state", F.last(mark, ignorenulls=True).over(w))
    return u.select("id", F.when((F.col("kind") == "body") & (F.col("state") == 1), "figure-text").otherwise(F.col("kind")).alias("kind"))


def win_interval_union(spark, sf):
    return W.interval_union(boxes(spark, sf), ["page"], "y0", "y1").select("page", F.round("covered", 3).alias("covered"))


def win_line_cluster(spark, sf):
    c = W.clusters(boxes(spark, sf).select("page", "y0").distinct(), ["page"], "y0", 25.0)
    return c.select("page", "y0", F.col("cluster").cast("long").alias("cluster"))


def win_nonoverlap(spark, sf):
    return W.nonoverlapping(boxes(spark, sf), ["page"], "y0", "y1").select("page", F.round("y0", 3).alias("y0"), F.round("y1", 3).alias("y1"))


def win_list_state(spark, sf):
    """Nesting level of list items by a stack of indents, reset by other lines; html lists of the pages."""
    from quire.operators.folds import list_levels

    return list_levels(table(spark, sf, "pages"))


def sort_stable(spark, sf):
    """Rank by (start, -end) with an explicit tiebreak."""
    w = Window.partitionBy("page").orderBy("y0", F.desc("y1"), "n")
    return boxes(spark, sf).select("page", "n", F.row_number().over(w).alias("place"))


def sort_reading(spark, sf):
    """Reading order: wide boxes split a page into bands; in a band the left lane, then the right."""
    from quire.operators.geometry import reading_order

    return reading_order(boxes(spark, sf))


def limit_next(spark, sf):
    """First order of each customer that is not in a terminal state."""
    o = table(spark, sf, "orders").filter("o_orderstatus != 'F'")
    return o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("next_order"), F.min_by("o_orderstatus", "o_orderkey").alias("stage"))


def topk_neighbours(spark, sf):
    w = W.ordered("doc_id")
    u = units(spark, sf).withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    return u.filter("kind = 'table'").select("id", "before", "after")


def topk_sample(spark, sf):
    """For each document the first unit of each kind with one neighbour on each side, once, in order."""
    u = units(spark, sf)
    first = u.groupBy("doc_id", "kind").agg(F.min("ord").alias("at"))
    near = first.select("doc_id", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("ord")).distinct()
    return u.join(near, ["doc_id", "ord"]).select("id", "kind")


def limit_report(spark, sf):
    """The first ten ids of table units of each document."""
    u = units(spark, sf).filter("kind = 'table'").groupBy("doc_id").agg(F.sort_array(F.collect_list("ord")).alias("o"))
    return u.select("doc_id", F.size("o").cast("long").alias("n"), F.array_join(F.slice("o", 1, 10), ",").alias("first_ten"))


def limit_chunk(spark, sf):
    """Batches of 50 documents in a source."""
    d = table(spark, sf, "documents").withColumn("stretch", F.floor(F.col("doc_id") / 4096))
    return W.ranked(d, ["source"], "stretch", "doc_id", "place").select("doc_id", F.floor((F.col("place") - 1) / 50).cast("long").alias("batch"))


_RUN = f"""with {UNITS_SQL}, {DONE_SQL},
o as (select *, lag(id) over w as before, lead(id) over w as after, words = 0 as done from units where translatable and doc_id not in (select doc_id from done) window w as (partition by doc_id order by ord)),
f as (select *, min(case when not done then ord end) over (partition by doc_id) as first_ord from o),
g as (select *, min(case when done then ord end) over (partition by doc_id) as stop_ord from f where ord >= first_ord),
h as (select *, sum(words) over (partition by doc_id order by ord) as cum from g where stop_ord is null or ord < stop_ord)
select doc_id, arg_min(id, ord) as first_id, arg_max(id, ord) as last_id, max(case when ord = first_ord then before end) as context_before,
  max(case when ord = (select max(ord) from h h2 where h2.doc_id = h.doc_id and (h2.ord = h2.first_ord or h2.cum <= {BUDGET})) then after end) as context_after,
  count(*) as n_units, cast(sum(words) as bigint) as source_words, sum(words) > {BUDGET} as oversized
from h where ord = first_ord or cum <= {BUDGET} group by doc_id"""

SQL = {
    "win_runsum_budget": _RUN,
    "win_pack_all": f"""with recursive {UNITS_SQL},
u as (select doc_id, ord, words, row_number() over (partition by doc_id order by ord) as k from units where translatable),
p as (select doc_id, ord, words as used, 1 as packet, k from u where k = 1
  union all select u.doc_id, u.ord, case when p.used + u.words > {BUDGET} then u.words else p.used + u.words end, case when p.used + u.words > {BUDGET} then p.packet + 1 else p.packet end, u.k
  from p join u on u.doc_id = p.doc_id and u.k = p.k + 1)
select doc_id, ord, packet from p""",
    "win_ffill_section": f"""with {UNITS_SQL} select id, last_value(case when kind in ('heading', 'caption') then source_text end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row) as section from units""",
    "win_renumber": f"""with {UNITS_SQL} select id, cast(row_number() over (partition by doc_id order by ord) as integer) as new_order, cast(row_number() over (partition by doc_id, page order by ord) as integer) as page_order from units where translatable""",
    "win_pairwise": f"""with {UNITS_SQL}, n as (select *, lead(kind) over w as nk, lead(source_text) over w as next_text from units window w as (partition by doc_id, page order by ord))
select id, next_text from n where kind = 'caption' and nk = 'body' and length(next_text) < 200""",
    "win_islands_cont": f"""with {UNITS_SQL}, l as (select *, lag(source_text) over w as pt, lag(kind) over w as pk from units window w as (partition by doc_id order by ord)),
i as (select *, sum(case when kind = 'body' and pk = 'body' and not regexp_matches(pt, '[.!?:;]$') then 0 else 1 end) over (partition by doc_id order by ord) as island from l)
select doc_id, cast(island as bigint) as island, arg_min(id, ord) as first_id, count(*) as n_units, cast(sum(words) as bigint) as words from i group by doc_id, island""",
    "win_after_caption": f"""with {UNITS_SQL}, s as (select *, last_value(case when kind = 'caption' then 1 when kind in ('heading', 'table') or (kind = 'body' and length(source_text) >= 120) then 0 end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row) as st from units)
select id, case when kind = 'body' and st = 1 then 'figure-text' else kind end as kind from s""",
    "win_interval_union": f"""with {BOXES_SQL}, m as (select *, max(y1) over (partition by page order by y0, y1 rows between unbounded preceding and 1 preceding) as seen from boxes)
select page, round(sum(greatest(0.0, y1 - greatest(y0, coalesce(seen, y0)))), 3) as covered from m group by page""",
    "win_line_cluster": f"""with {BOXES_SQL}, d as (select distinct page, y0 from boxes), g as (select *, y0 - lag(y0) over (partition by page order by y0) as gap from d)
select page, y0, cast(sum(case when gap <= 25.0 then 0 else 1 end) over (partition by page order by y0) as bigint) as cluster from g""",
    "win_nonoverlap": f"""with recursive {BOXES_SQL}, b as (select page, y0, y1, row_number() over (partition by page order by y0, y1 desc) as k from boxes),
r as (select page, k, y0, y1, true as kept, y1 as edge from b where k = 1
  union all select b.page, b.k, b.y0, b.y1, b.y0 >= r.edge, case when b.y0 >= r.edge then b.y1 else r.edge end from r join b on b.page = r.page and b.k = r.k + 1)
select page, round(y0, 3) as y0, round(y1, 3) as y1 from r where kept""",
    "sort_stable": f"""with {BOXES_SQL} select page, n, cast(row_number() over (partition by page order by y0, y1 desc, n) as integer) as place from boxes""",
    "sort_reading": f"""with {BOXES_SQL}, e as (select *, min(x0) over (partition by page) as l, max(x1) over (partition by page) as r from boxes),
w as (select *, x1 - x0 >= 0.6 * (r - l) as wide, case when (x0 + x1) / 2 < (l + r) / 2 then 0 else 1 end as lane from e),
b as (select *, coalesce(sum(case when wide then 1 else 0 end) over (partition by page order by y0, x0, n rows between unbounded preceding and 1 preceding), 0) + case when wide then 1 else 0 end as band from w)
select page, n, cast(row_number() over (partition by page order by band, case when wide then 0 else 1 end, case when wide then 0 else lane end, y0, x0, n) as integer) as place from b""",
    "limit_next": """select o_custkey, min(o_orderkey) as next_order, arg_min(o_orderstatus, o_orderkey) as stage from orders where o_orderstatus != 'F' group by o_custkey""",
    "topk_neighbours": f"""with {UNITS_SQL}, n as (select *, lag(id) over w as before, lead(id) over w as after from units window w as (partition by doc_id order by ord)) select id, before, after from n where kind = 'table'""",
    "topk_sample": f"""with {UNITS_SQL}, f as (select doc_id, kind, min(ord) as a from units group by doc_id, kind), n as (select distinct doc_id, unnest([a - 1, a, a + 1]) as ord from f) select u.id, u.kind from units u join n on u.doc_id = n.doc_id and u.ord = n.ord""",
    "limit_report": f"""with {UNITS_SQL}, o as (select doc_id, list(ord order by ord) as o from units where kind = 'table' group by doc_id) select doc_id, cast(len(o) as bigint) as n, array_to_string(o[1:10], ',') as first_ten from o""",
    "limit_chunk": """select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 50 as batch from documents""",
}

QUERIES = {f.__name__: f for f in (win_runsum_budget, win_pack_all, win_ffill_section, win_renumber, win_pairwise, win_islands_cont, win_after_caption, win_interval_union, win_line_cluster, win_nonoverlap, win_list_state, sort_stable, sort_reading, limit_next, topk_neighbours, topk_sample, limit_report, limit_chunk)}
