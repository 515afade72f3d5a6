"""Queries of papers: range of the body, running headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import paper as P
from quire.operators.units import UNITS_SQL, table, units


def filter_boundary_auto(spark, sf):
    """Range of the body by its headings."""
    return P.body_by_headings(P.paper(spark, sf)).select("id", "section", "introduction_id", "conclusion_id", "stop_id", "translatable")


def _reviews(u):
    """A review of each paper of three units or more; some are wrong in one way or another."""
    d = F.col("doc_id")
    last = u.groupBy("doc_id").agg(F.max("ord").alias("n")).filter("n >= 3")
    unit = lambda n: F.concat(F.lit("d"), d.cast("string"), F.lit("-u"), n.cast("string"))
    none = F.array().cast("array<string>")
    included = F.when(d % 10 == 8, F.array(F.lit("nowhere"))).when(d % 10 == 9, F.array(unit(F.lit(2)))).when(d % 4 == 1, F.array(unit(F.lit(1)))).otherwise(none)
    excluded = F.when(d % 10 == 9, F.array(unit(F.lit(2)))).when(d % 4 == 2, F.array(unit(F.lit(3)))).otherwise(none)
    stop = F.when(d % 10 == 7, F.lit(1)).otherwise(F.greatest(F.lit(3), F.col("n") - d % 3)).cast("int")
    return last.select("doc_id", unit(F.lit(2)).alias("start_id"), unit(stop).alias("stop_before_id"), included.alias("include_ids"), excluded.alias("exclude_ids"), (d % 2 == 0).alias("allow_missing_conclusion"))


def filter_boundary_reviewed(spark, sf):
    """Range of the body by a review, or the reason why the review is rejected."""
    u = P.paper(spark, sf)
    return P.body_by_review(u, _reviews(u)).select("id", "section", "conclusion_id", "translatable", "error")


def filter_range(spark, sf):
    """The body with what is translatable or included outside of it."""
    u = P.body_by_headings(P.paper(spark, sf))
    u = u.withColumn("include_ids", F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-u1")))).otherwise(F.array().cast("array<string>")))
    return P.body_range(u).select("id")


def agg_repeated_running(spark, sf):
    """Running headers of sources: their documents are the pages."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    n = F.col("ord") % 5
    said = F.when(n == 1, F.concat(F.lit("Report No. "), F.substring("source", 1, 3), F.lit("!"))).when(n == 2, F.concat(F.lit("page "), F.col("doc_id").cast("string"))).otherwise(F.col("source_text"))
    u = units(spark, sf).join(d, "doc_id")
    kind = F.when(F.col("doc_id") % 9 == 0, "caption").otherwise(F.col("kind"))
    u = u.select(F.col("source").alias("doc_id"), "id", (F.col("doc_id") + 1).alias("page"), kind.alias("kind"), said.alias("source_text"), (F.col("ord") * 40.0).alias("y1"))
    pages = d.select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page"), F.when(F.col("doc_id") % 8 == 5, 0.0).otherwise(800.0).alias("height"))
    return P.repeated_running(u, pages).select("id", "kind")


_P = f"with {P.PAPER_SQL} "
_INTRO, _CON, _AFTER = (x.replace("'", "''") for x in (P.INTRODUCTION, P.CONCLUSION, P.AFTER_BODY))
#: The scan of a paper unit by unit, as states of a recursion.
_SCAN = f"""with recursive {P.PAPER_SQL}, h as materialized (
  select *, kind = 'heading' as is_h, trim(regexp_replace(source_text, '\\s+', ' ', 'g')) as t from paper),
g as materialized (select *, regexp_matches(t, '{_INTRO}') as i, regexp_matches(t, '{_CON}') as c, regexp_matches(t, '{_AFTER}') as a,
  case when regexp_matches(t, '^\\d') then len(string_split(regexp_extract(t, '^\\d+(?:\\.\\d+)*'), '.')) end as lv from h),
scan as (
  select distinct doc_id, 0 as ord, false as active, cast(null as varchar) as intro, cast(null as varchar) as con, cast(null as bigint) as clv, cast(null as varchar) as stop, '' as section, cast(null as varchar) as id, '' as kind, '' as render_mode from paper
  union all
  select doc_id, ord, case b when 'intro' then true when 'stop' then false else active end, case when b = 'intro' then id else intro end, case when b = 'con' then id else con end,
    case when b = 'con' then coalesce(lv, 1) else clv end, case when b = 'stop' then id else stop end, case when b <> '' then t else section end, id, kind, render_mode
  from (select g.doc_id, g.ord, g.id, g.kind, g.render_mode, g.t, g.lv, s.active, s.intro, s.con, s.clv, s.stop, s.section,
    case when not g.is_h then '' when g.i and s.intro is null then 'intro' when s.active and g.c then 'con' when s.active and g.lv <= s.clv then 'stop' when s.active and g.a then 'stop' when g.t <> '' then 'head' else '' end as b
    from scan s join g on g.doc_id = s.doc_id and g.ord = s.ord + 1)),
ends as (select doc_id, arg_max(intro, ord) as introduction_id, arg_max(con, ord) as conclusion_id, arg_max(stop, ord) as stop_id from scan group by doc_id),
auto as (select scan.doc_id, ord, id, section, introduction_id, conclusion_id, stop_id, active and render_mode = 'text' and kind in ('heading', 'body', 'footnote') as translatable
  from scan join ends using (doc_id) where ord > 0)"""
SQL = {
    "filter_boundary_auto": _SCAN + " select id, section, introduction_id, conclusion_id, stop_id, translatable from auto",
    "filter_boundary_reviewed": _P + f""", n as (select doc_id, max(ord) as n from paper group by doc_id having max(ord) >= 3),
r as (select doc_id, 2 as lo, case when doc_id % 10 = 7 then 1 else greatest(3, n - doc_id % 3) end as hi, case when doc_id % 10 = 8 then -1 when doc_id % 10 = 9 then 2 when doc_id % 4 = 1 then 1 end as inc,
  case when doc_id % 10 = 9 then 2 when doc_id % 4 = 2 then 3 end as exc from n),
c as (select p.doc_id, min(p.ord) as con from paper p join r using (doc_id) where p.ord >= lo and p.ord < hi and not suppressed and regexp_matches(trim(regexp_replace(source_text, '\\s+', ' ', 'g')), '{_CON}') group by p.doc_id),
e as (select r.*, con, case when lo >= hi then 'order' when inc = -1 then 'unknown_ids' when inc = exc then 'overlap' when con is null and doc_id % 2 = 1 then 'no_conclusion' end as error from r left join c using (doc_id))
select id, coalesce((select arg_max(trim(regexp_replace(q.source_text, '\\s+', ' ', 'g')), q.ord) from paper q where q.doc_id = p.doc_id and q.ord <= p.ord and q.ord >= lo and q.ord < hi and not q.suppressed and (q.kind = 'heading' or q.ord = lo) and trim(q.source_text) <> ''), '') as section,
  case when con is not null then 'd' || p.doc_id || '-u' || con end as conclusion_id,
  error is null and not suppressed and ord is distinct from exc and (ord is not distinct from inc or (ord >= lo and ord < hi and render_mode = 'text' and kind in ('heading', 'body', 'footnote', 'front-matter'))) as translatable, error
from paper p join e using (doc_id)""",
    "filter_range": _SCAN + """, v as (select a.*, p.suppressed, ((a.translatable or (a.doc_id % 3 = 0 and a.ord = 1)) and not p.suppressed) as needed from auto a join paper p using (id)),
b as (select doc_id, least(coalesce(min(case when id = introduction_id then ord end), min(ord)), min(case when needed then ord end)) as lo, greatest(coalesce(max(case when id = stop_id then ord end), max(ord) + 1), max(case when needed then ord end) + 1) as hi from v group by doc_id)
select id from v join b using (doc_id) where ord >= lo and ord < hi""",
    "agg_repeated_running": f"""with {UNITS_SQL}, u as (select id, coalesce(source, '') as paper, doc_id + 1 as page, case when doc_id % 9 = 0 then 'caption' else kind end as kind, ord * 40.0 as y1, case when doc_id % 8 = 5 then 0 else 800 end as height,
  case ord % 5 when 1 then 'Report No. ' || substr(coalesce(source, ''), 1, 3) || '!' when 2 then 'page ' || doc_id else source_text end as t from units join documents using (doc_id)),
k as (select *, trim(regexp_replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')) as key from u where page > 1 and height > 0 and y1 <= height * 0.2 and length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) between 5 and 120),
r as (select paper, key from k where key <> '' group by paper, key having count(distinct page) >= 3)
select id, case when kind in ('body', 'heading') and id in (select id from k join r using (paper, key)) then 'header' else kind end as kind from u""",
}

QUERIES = {f.__name__: f for f in (filter_boundary_auto, filter_boundary_reviewed, filter_range, agg_repeated_running)}
