"""Queries of aggregates, incremental state and rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import state as S
from quire.operators.units import BOXES_SQL, DONE_SQL, UNITS_SQL, boxes, completed, table, units


def agg_counter(spark, sf):
    return units(spark, sf).groupBy("kind", "page").agg(F.count("*").alias("n"))


def agg_median(spark, sf):
    return boxes(spark, sf).groupBy("page").agg(F.round(F.median("y0"), 3).alias("median"))


def agg_weighted_mode(spark, sf):
    """The size with most area on a page; ties go to the larger size."""
    b = boxes(spark, sf).withColumn("size", F.floor(F.col("x0") / 10)).groupBy("page", "size").agg(F.round(F.sum(F.col("x1") - F.col("x0")), 3).alias("weight"))
    return b.groupBy("page").agg(F.max_by("size", F.struct("weight", "size")).cast("long").alias("size"))


def agg_vote(spark, sf):
    from quire.operators.geometry import column_vote

    return column_vote(boxes(spark, sf), ["page"]).groupBy("columns").agg(F.count("*").alias("pages"))


def agg_bbox_union(spark, sf):
    return boxes(spark, sf).groupBy("page", "kind").agg(*[F.round(f(c), 3).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def agg_mean_conf(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)), 4).alias("confidence"))


def agg_progress(spark, sf):
    done = completed(spark, sf).withColumn("done", F.lit(True))
    u = units(spark, sf).join(done, "doc_id", "left")
    return S.progress(u, ["doc_id"], "ord", "id", F.coalesce("done", F.lit(False)) | (F.col("kind") == "caption"))


def agg_rule_status(spark, sf):
    """Report of each document: pass if no rule is broken, and the broken ones."""
    d = table(spark, sf, "documents")
    rules = F.array_compact(F.array(F.when(F.length("text") < 200, "short"), F.when(F.contains("text", F.lit("|")), "table"), F.when(F.regexp_count("text", F.lit("[#$%&*]")) > 5, "symbols")))
    return d.select("doc_id", F.when(F.size(rules) == 0, "pass").otherwise("fail").alias("status"), F.array_join(rules, ",").alias("errors"))


def agg_distinct_order(spark, sf):
    """Kinds of a document's units in order of first sight."""
    k = units(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"]).alias("k"))
    return k.select("doc_id", F.array_join(F.array_distinct("k"), ",").alias("kinds"))


def agg_ratio(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.lit(1), F.length(t)), 6).alias("ratio"))


def agg_fingerprint(spark, sf):
    """Hash of the ordered hashes of a document's units."""
    h = units(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.sha2("source_text", 256).alias("h")))), lambda x: x["h"]).alias("h"))
    return h.select("doc_id", F.sha2(F.array_join("h", ","), 256).alias("fingerprint"))


def state_stage(spark, sf):
    """Stages of documents from evidence in the other tables."""
    d = table(spark, sf, "documents")
    l = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    k = F.col("doc_id")
    q, t = F.coalesce(F.col("q"), F.lit(0)), F.coalesce(F.col("t"), F.lit(0))
    return d.join(l, "doc_id", "left").select("doc_id", S.stage(k % 13 == 0, F.col("n_chars") > 300, q == 1, t == 0, (q == 1) & (k % 5 == 0), k % 10 == 0).alias("stage"))


def state_review_carry(spark, sf):
    p = table(spark, sf, "part")
    new = p.select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("f"))
    status = F.when(F.col("p_size") % 3 == 0, "manually_reviewed").when(F.col("p_size") % 3 == 1, "auto_validated").otherwise("unresolved")
    old = p.filter("p_partkey % 7 != 0").select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("x")).alias("f"), status.alias("status"))
    return S.carry_reviews(new, old, "k", "f")


def state_replay(spark, sf):
    """Units after a review that drops, rewrites and inserts some."""
    u = units(spark, sf).filter("kind != 'table'").select("doc_id", F.col("ord").cast("long").alias("ord"), "id", "source_text")
    op = F.when(F.col("ord") % 5 == 1, "suppress").when(F.col("ord") % 5 == 2, "replace").when(F.col("ord") % 5 == 3, "insert")
    ops = u.select("doc_id", F.col("ord").alias("step"), op.alias("op"), "id", F.concat(F.lit("reviewed "), "id").alias("text")).filter("op is not null")
    return S.replay(u, ops).select("doc_id", "ord", "id", F.md5("source_text").alias("text_md5"))



def val_coverage(spark, sf):
    """Line numbers that an order lacks between 1 and its number of lines."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"), F.count("*").cast("int").alias("n"))
    lacks = F.array_except(F.sequence(F.lit(1), F.col("n")), "have")
    return l.select("l_orderkey", F.explode(lacks).alias("lacks"))


def val_quick(spark, sf):
    """Blank texts, marks beyond an allowance and searchable words of pages."""
    h = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", (F.trim(h) == "").alias("blank"), F.regexp_count(h, F.lit("[#%$&*]")).cast("long").alias("marks"), (F.regexp_count(h, F.lit("[a-z]+")) > 50).alias("searchable"))


def val_reviewed_flow(spark, sf):
    """Orders whose first line is placed other than exactly once."""
    l = table(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return o.filter("n != 1").select("o_orderkey", F.when(F.col("n") == 0, "unplaced").otherwise("repeated").alias("code"))


def val_boundary(spark, sf):
    """Boxes beyond their page's frame of 60 by 700 points, and those wider than tall by over four times."""
    b = boxes(spark, sf)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    code = F.when(F.col("x1") > 140, "beyond_right").when(F.col("y1") > 700, "beyond_bottom").when(w > 4 * h, "aspect")
    return b.select("page", "n", code.alias("code")).filter("code is not null")


_U = f"with {UNITS_SQL} "
_B = f"with {BOXES_SQL} "
SQL = {
    "agg_counter": _U + "select kind, page, count(*) as n from units group by kind, page",
    "agg_median": _B + "select page, round(median(y0), 3) as median from boxes group by page",
    "agg_weighted_mode": _B + ", w as (select page, cast(floor(x0 / 10) as bigint) as size, round(sum(x1 - x0), 3) as weight from boxes group by 1, 2), r as (select *, row_number() over (partition by page order by weight desc, size desc) as k from w) select page, size from r where k = 1",
    "agg_vote": _B + ", e as (select *, min(x0) over (partition by page) as l, max(x1) over (partition by page) as r from boxes), s as (select page, case when count(*) filter (x1 <= l + 0.61 * (r - l)) >= 2 and count(*) filter (not (x1 <= l + 0.61 * (r - l)) and x0 >= l + 0.39 * (r - l)) >= 2 then 2 else 1 end as columns from e group by page) select columns, count(*) as pages from s group by columns",
    "agg_bbox_union": _B + "select page, kind, round(min(x0), 3) as x0, round(min(y0), 3) as y0, round(max(x1), 3) as x1, round(max(y1), 3) as y1 from boxes group by page, kind",
    "agg_mean_conf": "select user_id, round(coalesce(avg(case when event_type = 'view' then value end), 0.0), 4) as confidence from events group by user_id",
    "agg_progress": f"with {UNITS_SQL}, {DONE_SQL}, u as (select *, doc_id in (select doc_id from done) or kind = 'caption' as ok from units) select doc_id, count(*) as total, count(*) filter (ok) as completed, arg_min(case when not ok then id end, case when not ok then ord end) as next_id, count(*) filter (not ok) as remaining, bool_and(ok) as complete from u group by doc_id",
    "agg_rule_status": "with r as (select doc_id, length(text) < 200 as a, contains(text, '|') as b, len(regexp_extract_all(text, '[#$%&*]')) > 5 as c from documents) select doc_id, case when a or b or c then 'fail' else 'pass' end as status, array_to_string(list_filter([case when a then 'short' end, case when b then 'table' end, case when c then 'symbols' end], lambda x: x is not null), ',') as errors from r",
    "agg_distinct_order": _U + ", f as (select doc_id, kind, min(ord) as o from units group by doc_id, kind) select doc_id, string_agg(kind, ',' order by o) as kinds from f group by doc_id",
    "agg_ratio": "select doc_id, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(1, length(text)), 6) as ratio from documents",
    "agg_fingerprint": _U + "select doc_id, sha256(string_agg(sha256(source_text), ',' order by ord)) as fingerprint from units group by doc_id",
    "state_stage": "with l as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id), d as (select d.doc_id, n_chars > 300 as p, coalesce(q, 0) = 1 as q, coalesce(t, 0) = 0 as v from documents d left join l using (doc_id)) select doc_id, case when doc_id % 13 = 0 then 'queued' when q and doc_id % 5 = 0 and doc_id % 10 = 0 then 'delivered' when q and doc_id % 5 = 0 then 'packaged' when p and q and v then 'strict_validated' when p and q then 'translated' when p then 'prepared' else 'queued' end as stage from d",
    "state_review_carry": "select p_partkey as k, case when p_partkey % 7 = 0 then 'unresolved' when p_partkey % 2 = 0 then case p_size % 3 when 0 then 'manually_reviewed' when 1 then 'auto_validated' else 'unresolved' end when p_size % 3 = 1 then 'auto_validated' else 'unresolved' end as status from part",
    "state_replay": _U + """, u as (select * from units where kind != 'table'), r as (select doc_id, ord * 2 as o, id, case when ord % 5 = 2 then 'reviewed ' || id else source_text end as t from u where ord % 5 != 1 union all select doc_id, ord * 2 + 1, id || '-review', 'reviewed ' || id from u where ord % 5 = 3)
select doc_id, row_number() over (partition by doc_id order by o) as ord, id, md5(t) as text_md5 from r""",
    "val_coverage": "with n as (select l_orderkey, cast(count(*) as integer) as n from lineitem group by l_orderkey), s as (select l_orderkey, cast(unnest(range(1, n + 1)) as integer) as lacks from n) select * from s where not exists (select 1 from lineitem l where l.l_orderkey = s.l_orderkey and l.l_linenumber = s.lacks)",
    "val_reviewed_flow": "with l as (select l_orderkey, count(*) as n from lineitem where l_linenumber = 1 group by l_orderkey), o as (select o_orderkey, coalesce(n, 0) as n from orders left join l on o_orderkey = l_orderkey) select o_orderkey, case when n = 0 then 'unplaced' else 'repeated' end as code from o where n != 1",
    "val_boundary": _B + ", c as (select page, n, case when x1 > 140 then 'beyond_right' when y1 > 700 then 'beyond_bottom' when x1 - x0 > 4 * (y1 - y0) then 'aspect' end as code from boxes) select * from c where code is not null",
    "val_quick": "with h as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as h from pages) select page_id, trim(h) = '' as blank, cast(len(regexp_extract_all(h, '[#%$&*]')) as bigint) as marks, len(regexp_extract_all(h, '[a-z]+')) > 50 as searchable from h",
}

QUERIES = {f.__name__: f for f in (agg_counter, agg_median, agg_weighted_mode, agg_vote, agg_bbox_union, agg_mean_conf, agg_progress, agg_rule_status, agg_distinct_order, agg_ratio, agg_fingerprint, state_stage, state_review_carry, state_replay, val_coverage, val_reviewed_flow, val_boundary, val_quick)}
