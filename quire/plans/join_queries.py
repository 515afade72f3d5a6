"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import geometry as G
from quire.operators import joins as J
from quire.operators.units import BOXES_SQL, DONE_SQL, UNITS_SQL, boxes, completed, table, units


def _checkpoint(spark, sf):
    """A later state of the units: some are gone, some have other text, some are new."""
    u = units(spark, sf).filter("ord % 17 != 3")
    u = u.withColumn("source_text", F.when(F.col("ord") % 11 == 5, F.concat("source_text", F.lit(" (rev)"))).otherwise(F.col("source_text")))
    extra = units(spark, sf).filter("ord % 19 = 7").withColumn("id", F.concat("id", F.lit("-new")))
    return u.unionByName(extra)


_CHECKPOINT = """cp as (select doc_id, id, ord, page, kind, case when ord % 11 = 5 then source_text || ' (rev)' else source_text end as source_text, words, translatable from units where ord % 17 != 3
  union all select doc_id, id || '-new' as id, ord, page, kind, source_text, words, translatable from units where ord % 19 = 7)"""


def join_id_strict(spark, sf):
    return J.strict_join(units(spark, sf), _checkpoint(spark, sf), "id", ["source_text", "kind", "page"])


def join_anti_both(spark, sf):
    return J.anti_both(units(spark, sf), _checkpoint(spark, sf), "id")


def join_semi(spark, sf):
    return units(spark, sf).join(completed(spark, sf), "doc_id", "left_semi").select("id", "words")


def join_snapshot_diff(spark, sf):
    done = completed(spark, sf).withColumn("done", F.lit(True))
    old = units(spark, sf).join(done, "doc_id", "left").withColumn("contract", F.sha2("source_text", 256))
    return J.snapshot_diff(old, _checkpoint(spark, sf).withColumn("contract", F.sha2("source_text", 256)), "id", "contract", "done")


def join_asof_anchor(spark, sf):
    """For each event of value over 50 the last earlier event of the user, by time and id."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return J.asof_before(e.filter("value > 50"), e, ["user_id"], "at", "at", "event_id").select("event_id", "user_id", F.col("marker").alias("anchor_id"))


def join_nearest_visual(spark, sf):
    """For each box of flag R the box of its page with the smallest vertical gap; ties to the smallest number."""
    b = boxes(spark, sf)
    p = G.page_pairs(b.filter("kind = 'R'"), b.filter("kind != 'R'"))
    gap = F.greatest(F.lit(0.0), F.col("b_y0") - F.col("a_y1"), F.col("a_y0") - F.col("b_y1"))
    return p.groupBy("page", F.col("a_n").alias("caption"), F.col("a_y0").alias("y0")).agg(F.min_by("b_n", F.struct(F.round(gap, 3), "b_n")).alias("visual"), F.round(F.min(gap), 3).alias("gap"))


def join_consumption(spark, sf):
    """Line items by (order, flag) against (order, status): rows that one side has more often."""
    li = table(spark, sf, "lineitem")
    return J.multiset_difference(li.select("l_orderkey", F.col("l_returnflag").alias("f")), li.select("l_orderkey", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("f")))


def join_child_role(spark, sf):
    return J.role_inventory(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, sf, "orders"), "o_orderkey", "l_returnflag", ["A", "N", "R"])


def join_chain(spark, sf):
    """Paragraph root of every unit: runs of body units without terminal punctuation share their first unit."""
    from quire.operators.windows import islands, ordered

    w = ordered("doc_id")
    u = units(spark, sf).withColumn("p", F.lag("source_text").over(w)).withColumn("k", F.lag("kind").over(w))
    u = islands(u, ["doc_id"], "ord", (F.col("kind") == "body") & (F.col("k") == "body") & ~F.col("p").rlike(r"[.!?]$"))
    return u.select("id", F.first("id").over(Window.partitionBy("doc_id", "island").orderBy("ord")).alias("root"))


def _items(spark, sf):
    """Bibliographic items made of parts: some have a doi, some an arxiv id, all a title and year."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("item_id"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), (k % 200).cast("string"))).alias("doi"),
        F.when(k % 5 == 0, F.concat(F.lit("2001."), F.lpad((k % 150).cast("string"), 5, "0"))).alias("arxiv"),
        F.lower("p_name").alias("title"),
        (F.lit(1990) + F.col("p_size")).cast("string").alias("year"),
    )


_ITEMS = """items as (select p_partkey as item_id, case when p_partkey % 3 = 0 then '10.1000/' || (p_partkey % 200) end as doi,
  case when p_partkey % 5 = 0 then '2001.' || lpad(cast(p_partkey % 150 as varchar), 5, '0') end as arxiv, lower(p_name) as title, cast(1990 + p_size as varchar) as year from part)"""


def set_difference(spark, sf):
    return J.anti_both(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


def set_equality(spark, sf):
    """Whether each nation's customers and suppliers use the same segments of account balance."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.sort_array(F.collect_set(F.floor(F.col("c_acctbal") / 5000))).alias("a"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.sort_array(F.collect_set(F.floor(F.col("s_acctbal") / 5000))).alias("b"))
    return c.join(s, "n", "full_outer").select("n", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def multiset_equality(spark, sf):
    """Lines that a text repeats: those left when one of each is taken away."""
    u = units(spark, sf).select("doc_id", "source_text")
    return u.exceptAll(u.distinct())


def set_overlap(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


def union_dedupe(spark, sf):
    """Items matched by title or by doi, once each."""
    i = _items(spark, sf)
    return i.filter("doi is not null").select("item_id").unionByName(i.filter("year < '2010'").select("item_id")).dropDuplicates(["item_id"])


_PAIR = f"with {BOXES_SQL}, p as (select a.page, a.n as a_n, b.n as b_n, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, a.kind as ak, b.kind as bk from boxes a join boxes b on a.page = b.page), o as (select *, greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0)) as ov from p) "
_UC = f"with {UNITS_SQL}, {_CHECKPOINT} "
SQL = {
    "join_id_strict": _UC + """select coalesce(u.id, c.id) as id, case when c.id is null then 'missing' when u.id is null then 'extra' when u.source_text is distinct from c.source_text or u.kind is distinct from c.kind or u.page is distinct from c.page then 'stale' else 'ok' end as verdict from units u full join cp c on u.id = c.id""",
    "join_anti_both": _UC + """select id, 'missing' as side from units where id not in (select id from cp) union all select id, 'extra' from cp where id not in (select id from units)""",
    "join_semi": f"with {UNITS_SQL}, {DONE_SQL} select id, words from units where doc_id in (select doc_id from done)",
    "join_snapshot_diff": f"""with {UNITS_SQL}, {DONE_SQL}, {_CHECKPOINT} select coalesce(u.id, c.id) as id, case when u.id is null then 'new' when c.id is null then 'removed' when u.source_text != c.source_text and u.doc_id in (select doc_id from done) then 'reopened' when u.source_text != c.source_text then 'changed' else 'preserved' end as label from units u full join cp c on u.id = c.id""",
    "join_asof_anchor": """with l as (select *, lag(event_id) over (partition by user_id order by ts, event_id) as anchor_id from events) select event_id, user_id, anchor_id from l where value > 50""",
    "join_nearest_visual": _PAIR + """, g as (select *, greatest(0.0, by0 - ay1, ay0 - by1) as gap from o where ak = 'R' and bk != 'R') select page, a_n as caption, ay0 as y0, arg_min(b_n, round(gap, 3) * 1000000 + b_n) as visual, round(min(gap), 3) as gap from g group by page, a_n, ay0""",
    "join_consumption": """with a as (select l_orderkey, l_returnflag as f from lineitem), b as (select l_orderkey, case when l_linestatus = 'O' then 'N' else 'R' end as f from lineitem)
select l_orderkey, f, 'left' as side from (select * from a except all select * from b) union all select l_orderkey, f, 'right' from (select * from b except all select * from a)""",
    "join_child_role": """with c as (select l_orderkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by l_orderkey)
select o_orderkey, coalesce(a, 0) as "n_A", coalesce(n, 0) as "n_N", coalesce(r, 0) as "n_R", coalesce(a = 1 and n = 1 and r = 1, false) as complete from orders left join c on o_orderkey = l_orderkey""",
    "join_chain": f"""with {UNITS_SQL}, l as (select *, lag(source_text) over w as p, lag(kind) over w as k from units window w as (partition by doc_id order by ord)),
i as (select *, sum(case when kind = 'body' and k = 'body' and not regexp_matches(p, '[.!?]$') then 0 else 1 end) over (partition by doc_id order by ord) as isl from l) select id, first_value(id) over (partition by doc_id, isl order by ord) as root from i""",
    "set_difference": """select c_custkey as k, 'missing' as side from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'extra' from orders where o_custkey not in (select c_custkey from customer)""",
    "set_equality": """with c as (select c_nationkey as n, list_sort(list(distinct floor(c_acctbal / 5000))) as a from customer group by 1), s as (select s_nationkey as n, list_sort(list(distinct floor(s_acctbal / 5000))) as b from supplier group by 1) select coalesce(c.n, s.n) as n, coalesce(a = b, false) as equal from c full join s on c.n = s.n""",
    "multiset_equality": f"with {UNITS_SQL}, r as (select doc_id, source_text, row_number() over (partition by doc_id, source_text order by ord) as k from units) select doc_id, source_text from r where k > 1",
    "set_overlap": "select distinct o_custkey as k from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)",
    "union_dedupe": f"with {_ITEMS} select item_id from items where doi is not null or year < '2010'",
}

QUERIES = {f.__name__: f for f in (join_id_strict, join_anti_both, join_semi, join_snapshot_diff, join_asof_anchor, join_nearest_visual, join_consumption, join_child_role, join_chain, set_difference, set_equality, multiset_equality, set_overlap, union_dedupe)}
