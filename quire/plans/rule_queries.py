"""Queries of merges, reconciliation and rules with the full set of conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import rules as R
from quire.operators import state as S
from quire.operators.paper import PAPER_SQL, paper
from quire.operators.units import UNITS_SQL, table, units



def _has_han():
    return F.col("_words").rlike("[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]")


def _base(spark, sf):
    """A checkpoint: protected text with tokens, and completed texts in every third unit."""
    u = units(spark, sf)
    return u.select("doc_id", "ord", "id", F.concat(F.lit("[[P0001]] "), "id", F.lit(" [[F1_0001]]")).alias("protected_text"), F.when(F.col("ord") % 3 == 2, F.concat(F.lit("[[P0001]]旧[[F1_0001]]"), "id")).otherwise("").alias("translated_text"))


def _batch(spark, sf):
    """New texts: some replay, some are empty, foreign, without tokens, with other fields, unknown or given twice."""
    u = units(spark, sf).filter("ord % 4 < 2 and doc_id % 5 != 4")
    n = F.col("ord") % 28
    new = (
        F.when(n == 4, " ").when(n == 5, F.concat(F.lit("[[P0001]]旧[[F1_0001]]"), "id")).when(n == 8, F.concat(F.lit("[[F1_0001]]新[[P0001]]"), "id")).when(n == 12, F.concat(F.lit("[[P0001]]new[[F1_0001]]"), "id"))
        .otherwise(F.concat(F.lit("[[P0001]]新[[F1_0001]]"), "id"))
    )
    extra = F.when(F.col("ord") % 24 == 16, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    b = u.select(F.when(F.col("ord") % 20 == 9, F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("id"), new.alias("translated_text"), extra.alias("extra"))
    return b.union(u.filter("ord % 16 = 8").select("id", F.lit("[[P0001]]again[[F1_0001]]"), F.array().cast("array<string>")))


def state_merge(spark, sf):
    """Verdicts of a batch against a checkpoint."""
    return S.merge(_base(spark, sf), _batch(spark, sf), "id", "translated_text", protected="protected_text", language=_has_han()).select("id", "ord", "translated_text", "verdict")


def state_merge_whole(spark, sf):
    """The same, where the rows of one document are a batch that is applied whole or not at all."""
    base = _base(spark, sf)
    m = S.merge(base, _batch(spark, sf), "id", "translated_text", protected="protected_text", language=_has_han())
    return S.all_or_nothing(m, base, "id", "translated_text", F.regexp_extract("id", r"^d(\d+)-", 1)).select("id", "translated_text", "verdict")


def state_reconcile(spark, sf):
    """A checkpoint after the units were extracted anew."""
    u = units(spark, sf)
    old = u.filter("ord % 5 != 4").select("id", F.when(F.col("ord") % 3 == 0, "done").otherwise(" ").alias("translated_text"), "source_text", "kind", F.lit(None).cast("string").alias("list_id"))
    new = u.filter("ord % 7 != 0").select(
        "id", F.when(F.col("ord") % 18 == 3, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")).alias("source_text"), "kind", F.when(F.col("ord") % 18 == 15, "list").alias("list_id"))
    return S.reconcile(old, new, "id", "translated_text", ["source_text", "kind", "list_id"])


def val_flow(spark, sf):
    """The first broken flow rule of each unit."""
    n = F.col("ord") % 13
    none = F.lit(None).cast("string")
    u = paper(spark, sf).select(
        "id", "kind", F.concat(F.when(n == 7, " -  ").otherwise(""), "source_text").alias("source_text"),
        F.when(n == 0, "quote").when(n.isin(5, 6, 7, 8, 11), "list_item").when(n.isin(9, 10), "list_continuation").otherwise("paragraph").alias("flow_role"),
        F.when(n == 5, " ").when(n.isin(4, 6, 7, 8, 9, 10), "list-1").otherwise(none).alias("list_id"),
        F.when(n == 3, -1).when(n == 7, 2).otherwise(0).alias("list_level"),
        F.when(n == 7, "-").when(n.isin(8, 10), "~").when(n == 12, none).when(n == 6, " ").otherwise("").alias("source_marker"),
        ((F.col("ord") % 2) == 0).alias("flow_reviewed"), F.when(n == 1, "u").when(n == 2, " ").otherwise(none).alias("continuation_of"), (F.col("render_mode") == "text").alias("translatable"),
    )
    return u.select("id", R.flow_error().alias("error"))


def val_strict(spark, sf):
    """Violations of a checkpoint: ids, tokens, emphasis, language and texts left as they were."""
    u = units(spark, sf)
    toks = u.select("id", "kind", "source_text", "translatable", F.array(F.lit("[[P0001]]")).alias("literals"), F.when(F.col("ord") % 2 == 0, F.array(F.lit("[[F1_0001]]"))).otherwise(F.array().cast("array<string>")).alias("fragments"), F.array(F.lit("B1")).alias("styles"))
    n = F.col("ord") % 10
    t = (
        F.when(n == 0, " ").when(n == 1, F.col("source_text")).when(n == 2, "[[P0001]][[P0001]][[F1_0001]][[B1_OPEN]]汉[[B1_CLOSE]]").when(n == 3, "[[P0001]][[B1_CLOSE]]汉[[B1_OPEN]]")
        .when(n == 4, "[[P0001]][[B1_OPEN]]汉[[B1_CLOSE]]").when(n == 5, "[[P0001]][[B1_OPEN]]latin[[B1_CLOSE]]").otherwise("[[P0001]][[F1_0001]][[B1_OPEN]]汉[[B1_CLOSE]]")
    )
    cp = u.filter("ord % 11 != 7").select("id", t.alias("translated_text")).union(u.filter("ord % 17 = 5").select(F.concat("id", F.lit("-x")), F.lit("t")))
    return R.checkpoint_errors(toks, cp, _has_han())


def val_counters(spark, sf):
    """Kinds whose numbers of units differ from what is laid out."""
    u = units(spark, sf).withColumn("key", F.concat_ws("/", "page", "kind"))
    return R.counter_errors(u, u.filter("doc_id % 50 != 0 or kind != 'table'").unionByName(u.filter("doc_id = 7")), "key")


def _findings(spark, sf):
    """Findings of three reviews: of orders by their lines."""
    l = table(spark, sf, "lineitem")
    return l.select(
        (F.col("l_linenumber") % 3).cast("int").alias("review"), (F.col("l_orderkey") % 40).cast("int").alias("page"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("c"), (F.col("l_orderkey") % 25).cast("string"))).alias("category"),
        F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("u"), (F.col("l_orderkey") % 97).cast("string"))).alias("source_unit"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")).alias("symptom"),
        F.when(F.col("l_partkey") % 29 == 1, F.concat(F.lit("defect-own-"), (F.col("l_orderkey") % 50).cast("string"))).alias("defect_id"),
    )


def agg_defects(spark, sf):
    """Defects of all reviews, the reviews that name each, and the defects of its category."""
    return R.defects(_findings(spark, sf)).select("defect_id", "category", "reviews", "in_category")


def val_readiness(spark, sf):
    """Violations of repairs against the defects of the prior reviews."""
    d = R.defects(_findings(spark, sf)).withColumn("h", F.conv(F.substring(F.md5("defect_id"), 1, 4), 16, 10).cast("int"))
    none, one = F.array().cast("array<string>"), F.array(F.lit("a.png"))
    h = F.col("h")
    repairs = d.filter("h % 9 != 0").select(
        F.when(h % 31 == 1, F.concat("defect_id", F.lit("?"))).otherwise(F.col("defect_id")).alias("defect_id"), F.when(h % 7 == 1, "open").otherwise("resolved").alias("status"), F.when(h % 5 == 1, none).otherwise(one).alias("images"),
        F.when(h % 3 == 1, none).otherwise(one).alias("related_images"), F.when(h % 4 == 1, "").otherwise("all").alias("scope"), F.when(h % 6 == 1, none).otherwise(one).alias("regression"), (h % 8 == 1).alias("systemic"), (h % 10 == 1).alias("repeated"),
    )
    return R.readiness_errors(d.drop("h"), repairs.union(repairs.filter(F.endswith("defect_id", F.lit("7")))))


def join_ownership(spark, sf):
    """Display equations of papers against the groups that claim them."""
    u = paper(spark, sf).withColumn("page", F.floor(F.col("ord") / 15).cast("int"))
    d = F.col("doc_id")
    unit = lambda n: F.concat(F.lit("d"), d.cast("string"), F.lit("-u"), n.cast("string"))
    o = F.col("ord")
    ids = (
        F.when(d % 12 == 1, F.array(unit(o), unit(o))).when(d % 12 == 2, F.array(unit(o), F.lit("nowhere"))).when(d % 12 == 3, F.array(unit(o), unit(o - 1))).when(d % 12 == 4, F.array(unit(o), unit(o + 1)))
        .when(d % 12 == 5, F.array(unit(o), unit(o + 7))).when(d % 12 == 6, F.array().cast("array<string>")).when(d % 12 == 7, F.array(unit(o - 1), unit(o))).otherwise(F.array(unit(o)))
    )
    reviews = u.filter((F.col("kind") == "equation") & ~((d % 12 == 8) & (o % 2 == 0))).select("doc_id", F.col("id").alias("owner"), ids.alias("source_ids"))
    return R.ownership_errors(u, reviews)


#: Units with an issue by turn: kind, text, runs (text, style, size, flags), fragments (start, end, kind, size), and the issues.
_ISSUES = (
    ("heading", "1) Aims of it", [("1) Aims of it", "text", 10, 0)], [], [("heading_list_ambiguous", "")]),
    ("heading", "1) Aims of it", [("1) Aims of it", "bold", 10, 0)], [], []),
    ("body", "plain words here", [("plain words", "text", 10, 0), ("absent", "text", 10, 0)], [], [("unmatched_source_span", "1")]),
    ("body", "word and word", [("word", "text", 10, 0)], [], [("ambiguous_source_span", "0")]),
    ("body", "as beta grows", [("as", "text", 10, 0), ("beta", "math", 10, 0), ("grows", "text", 10, 0)], [], [("uncovered_math_span", "1")]),
    ("body", "as beta grows", [("as", "text", 10, 0), ("beta", "math", 10, 0), ("grows", "text", 10, 0)], [(3, 7, "math", 10.0)], []),
    ("body", "norm k of them", [("norm ", "text", 10, 0), ("k", "text", 7, 0), (" of them", "text", 10, 0)], [], [("orphan_script", "1")]),
    ("body", "norm k of them", [("norm ", "text", 10, 0), ("k", "text", 7, 0), (" of them", "text", 10, 0)], [(5, 6, "footnote-marker", 7.0)], []),
    ("body", "so that\na + b = c\n(2.1)", [], [], [("numbered_display_in_body", "2")]),
    ("body", "a = b + c / d * e + f + g", [], [], [("formula_only", "")]),
    ("body", "- one item", [], [], [("flow_ambiguous", "")]),
    ("body", "see 1) this 2) that", [], [], []),
    ("body", "- one 2. two", [], [], [("flow_ambiguous", "")]),
)


def val_source(spark, sf):
    """Issues of units that are given notation by turn, and of their neighbours."""
    u, n = paper(spark, sf), (F.col("ord") % len(_ISSUES)).cast("int") + 1
    pick = lambda k, f=F.lit: F.element_at(F.array(*[f(x[k]) for x in _ISSUES]), n)
    run_type, part_type = "array<struct<text:string,style:string,size:double,flags:int,font:string,line:int>>", "array<struct<start:int,end:int,kind:string,size:double>>"
    runs = lambda rs: F.array(*[F.struct(F.lit(t), F.lit(s), F.lit(float(z)), F.lit(f), F.lit(""), F.lit(0)) for t, s, z, f in rs]).cast(run_type)
    parts = lambda fs: F.array(*[F.struct(*map(F.lit, f)) for f in fs]).cast(part_type)
    made = u.filter("kind not in ('footnote', 'header', 'equation')").select(
        "doc_id", "id", "page", F.col("ord").alias("page_order"), pick(0).alias("kind"), pick(1).alias("source_text"), (F.col("ord") % 5 > 0).alias("translatable"), "suppressed", "size", "x0", "y0", "x1", "y1", pick(2, runs).alias("runs"),
        pick(3, parts).alias("fragments"), F.lit("paragraph").alias("flow_role"), F.lit(None).cast("string").alias("flow_error"), F.lit(None).cast("string").alias("flow_review"),
    )
    other = u.filter("kind in ('footnote', 'header', 'equation')")
    kind = F.when(F.col("kind") == "header", "caption").when(F.col("kind") == "footnote", "body").otherwise(F.col("kind"))
    rest = other.select(*[F.col(c) if c in other.columns and c not in ("kind", "source_text") else F.lit(None).alias(c) for c in made.columns if c not in ("kind", "source_text", "page_order", "translatable", "runs", "fragments")], F.col("ord").alias("page_order"), kind.alias("kind"), F.lit("lower case").alias("source_text"), F.lit(False).alias("translatable"), F.lit(None).cast(run_type).alias("runs"), F.lit(None).cast(part_type).alias("fragments"))
    v = u.filter("ord % 10 = 1").select("doc_id", "page", F.concat(F.lit("v-"), "id").alias("visual"), F.lit(None).cast("string").alias("caption_id"), F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-u5"))).alias("source_ids"), "x0", "y0", "x1", (F.col("y0") + 100.0).alias("y1"))
    return R.source_issues(made.unionByName(rest), v).select("id", "code", "detail")


_M = UNITS_SQL + """, base as (select doc_id, ord, id, '[[P0001]] ' || id || ' [[F1_0001]]' as protected, case when ord % 3 = 2 then '[[P0001]]旧[[F1_0001]]' || id else '' end as old from units),
b1 as (select * from units where ord % 4 < 2 and doc_id % 5 <> 4),
batch as (select case when ord % 20 = 9 then id || '?' else id end as id, case ord % 28 when 4 then ' ' when 5 then '[[P0001]]旧[[F1_0001]]' || id when 8 then '[[F1_0001]]新[[P0001]]' || id when 12 then '[[P0001]]new[[F1_0001]]' || id else '[[P0001]]新[[F1_0001]]' || id end as v, ord % 24 = 16 as extra from b1
  union all select id, '[[P0001]]again[[F1_0001]]', false from b1 where ord % 16 = 8),
one as (select id, count(*) as n, max(v) as v, bool_or(extra) as extra from batch group by id),
verdicts as (select coalesce(base.id, one.id) as id, ord, old, v,
  case when base.id is null then 'unknown' when one.id is null then 'kept' when n > 1 then 'duplicate' when extra then 'extra_fields'
    when trim(v) <> '' and regexp_extract_all(v, '\\[\\[[A-Za-z0-9_]+\\]\\]') <> regexp_extract_all(protected, '\\[\\[[A-Za-z0-9_]+\\]\\]') then 'tokens'
    when trim(v) <> '' and not regexp_matches(regexp_replace(v, '\\[\\[[A-Za-z0-9_]+\\]\\]', '', 'g'), '[㐀-䶿一-鿿]') then 'language' when trim(v) = '' then 'empty' when v = old then 'replayed' when old <> '' then 'frozen' else 'merged' end as verdict
  from base full join one on base.id = one.id)"""
_FINDINGS = """f as (select l_linenumber % 3 as review, l_orderkey % 40 as page, coalesce(case when l_suppkey % 3 > 0 then 'c' || (l_orderkey % 25) end, 'layout') as category, case when l_orderkey % 3 > 0 then 'u' || (l_orderkey % 97) end as unit,
  's' || (l_partkey % 5) as symptom, case when l_partkey % 29 = 1 then 'defect-own-' || (l_orderkey % 50) end as own from lineitem),
g as (select *, coalesce(own, 'defect-' || left(sha256('{"category":"' || category || '",' || case when unit is null then '"initial_page":' || page || ',"source_unit":null' else '"source_unit":"' || unit || '"' end || ',"symptom":"' || symptom || '"}'), 16)) as defect_id from f),
k as (select *, row_number() over (partition by defect_id order by review desc, page desc, symptom desc, category desc) as place from g),
d0 as (select defect_id, max(case when place = 1 then category end) as category, cast(count(distinct review) as bigint) as reviews from k group by defect_id),
d as (select *, cast(count(*) over (partition by category) as bigint) as in_category from d0)"""
SQL = {
    "state_merge": f"with {_M} select id, ord, case when verdict = 'merged' then v else old end as translated_text, verdict from verdicts",
    "state_merge_whole": f"""with {_M}, w as (select *, bool_or(verdict in ('unknown', 'duplicate', 'extra_fields', 'tokens', 'language', 'empty', 'frozen')) over (partition by regexp_extract(id, '^d(\\d+)-', 1)) as bad from verdicts)
select id, case when verdict = 'merged' and not bad then v else old end as translated_text, case when bad and verdict in ('merged', 'replayed') then 'refused' else verdict end as verdict from w""",
    "state_reconcile": f"""with {UNITS_SQL}, o as (select id, ord from units where ord % 5 <> 4), n as (select id, ord from units where ord % 7 <> 0)
select id, case when o.ord % 3 = 0 then 'done' when o.ord is not null then ' ' else '' end as translated_text,
  case when n.ord is null then case when o.ord % 3 = 0 then 'refused:orphan' else 'dropped' end when o.ord % 3 <> 0 or o.ord is null then 'open' when n.ord % 18 = 3 then 'refused:source_text' when n.ord % 18 = 15 then 'refused:list_id' else 'kept' end as state
from n full join o using (id)""",
    "val_flow": f"""with {PAPER_SQL} select id, case ord % 13 when 0 then 'role' when 1 then case when kind <> 'body' or ord % 2 = 1 then 'continuation_kind' end when 2 then 'continuation_id' when 3 then 'level' when 4 then 'paragraph_list' when 5 then 'list_id'
  when 6 then 'item_marker' when 8 then case when ltrim(source_text, ' ') not like '~%' then 'marker_text' end when 10 then 'continuation_marker' when 11 then 'list_id' when 12 then 'marker_type' end as error from paper""",
    "val_strict": f"""with {UNITS_SQL}, u as (select *, ord % 10 as n, kind = 'body' and length(source_text) >= 60 as long from units where translatable), h as (select * from u where ord % 11 <> 7), e as (
select id, 'missing' as code, '' as detail from u where ord % 11 = 7
union all select id, 'extra', '' from units where ord % 11 <> 7 and not translatable
union all select id || '-x', 'extra', '' from units where ord % 17 = 5
union all select id, 'empty', '' from h where n = 0 or (n = 1 and trim(source_text) = '')
union all select id, 'token_count', '[[P0001]] 0' from h where n = 1 and trim(source_text) <> ''
union all select id, 'token_count', '[[P0001]] 2' from h where n = 2
union all select id, 'token_count', '[[F1_0001]] 0' from h where n = 4
union all select id, 'style_order', 'B1' from h where n = 3 or (n = 1 and trim(source_text) <> '')
union all select id, 'language', '' from h where long and n in (1, 5)
union all select id, 'unchanged', '' from h where long and n = 1) select * from e""",
    "val_counters": f"""with {UNITS_SQL}, c as (select page || '/' || kind as key, count(*) as expected, sum((case when doc_id % 50 <> 0 or kind <> 'table' then 1 else 0 end) + case when doc_id = 7 then 1 else 0 end) as actual from units group by 1)
select key, expected, cast(actual as bigint) as actual from c where expected <> actual""",
    "agg_defects": f"with {_FINDINGS} select defect_id, category, reviews, in_category from d",
    "val_readiness": f"""with {_FINDINGS}, h as (select *, cast('0x' || left(md5(defect_id), 4) as integer) as h from d), r0 as (select *, case when h % 31 = 1 then defect_id || '?' else defect_id end as rid from h where h % 9 <> 0),
r as (select rid, any_value(h) as h, count(*) + max(case when right(rid, 1) = '7' then 1 else 0 end) as n from r0 group by rid),
j as (select coalesce(d.defect_id, r.rid) as defect_id, d.defect_id is null as alien, r.rid is null as bare, n, h, reviews, in_category from d full join r on d.defect_id = r.rid)
select defect_id, 'cover' as code from j where alien or bare or n > 1 union all select defect_id, 'unresolved' from j where h % 7 = 1 union all select defect_id, 'uninspected' from j where h % 5 = 1
union all select defect_id, 'systemic' from j where not bare and (h % 8 = 1 or in_category > 1) and (h % 3 = 1 or h % 4 = 1) union all select defect_id, 'regression' from j where not bare and (h % 10 = 1 or reviews > 1) and h % 6 = 1""",
    "join_ownership": f"""with {PAPER_SQL}, u as (select * replace (cast(ord // 15 as integer) as page) from paper), e as (select * from u where kind = 'equation' and not (doc_id % 12 = 8 and ord % 2 = 0)),
r as (select doc_id, id as owner, ord, case doc_id % 12 when 1 then [ord, ord] when 2 then [ord, -1] when 3 then [ord, ord - 1] when 4 then [ord, ord + 1] when 5 then [ord, ord + 7] when 6 then [] when 7 then [ord - 1, ord] else [ord] end as members from e),
m as (select r.doc_id, owner, r.ord as at, members, (select list(u.id order by u.ord) from u where u.doc_id = r.doc_id and list_contains(members, u.ord)) as known, (select bool_or(not u.suppressed and u.kind <> 'equation') from u where u.doc_id = r.doc_id and list_contains(members, u.ord)) as has_text,
  (select count(distinct u.page) from u where u.doc_id = r.doc_id and list_contains(members, u.ord)) as pages, (select u.id from u where u.doc_id = r.doc_id and list_contains(members, u.ord) and u.kind = 'equation' and not u.suppressed order by u.ord limit 1) as first,
  (select count(*) from u where u.doc_id = r.doc_id and not u.suppressed and u.ord > list_min(members) and u.ord < list_max(members) and not list_contains(members, u.ord)) as between_ids from r),
g as (select owner, case when len(members) = 0 then 'no_members' when len(list_distinct(members)) < len(members) then 'repeated' when coalesce(len(known), 0) < len(members) then 'unknown' when members <> list_sort(members) then 'order'
  when first is distinct from owner then 'owner' when has_text then 'text' when pages > 1 then 'pages' when between_ids > 0 then 'crosses' end as code from m),
o as (select unnest(known) as id, owner from m)
select owner, code from g where code is not null union all select id, 'overlap' from (select distinct id, owner from o) group by id having count(*) > 1
union all select id, 'unowned' from u where kind = 'equation' and not suppressed and id not in (select id from o)""",
}

_S = lambda x: "'" + x.replace("'", "''") + "'"
SQL["val_source"] = f"""with {PAPER_SQL}, e(k, code, detail) as (values {', '.join(f"({k}, '{c}', '{d}')" for k, x in enumerate(_ISSUES) for c, d in x[4])}),
t(k, kind, text) as (values {', '.join(f"({k}, '{x[0]}', {_S(x[1])})" for k, x in enumerate(_ISSUES))}),
u as (select p.*, p.kind in ('footnote', 'header', 'equation') as other, case p.kind when 'header' then 'caption' when 'footnote' then 'body' when 'equation' then 'equation' else t.kind end as k2, case when p.kind in ('footnote', 'header', 'equation') then 'lower case' else t.text end as t2 from paper p join t on t.k = p.ord % {len(_ISSUES)}),
w as (select *, lag(k2) over (partition by doc_id, page order by ord) as before from u)
select id, code, detail from u join e on e.k = u.ord % {len(_ISSUES)} where not other and not suppressed and ord % 5 > 0
union all select u.id, 'label_in_visual', 'v-' || v.id from u join paper v using (doc_id, page) where v.ord % 10 = 1 and not u.suppressed and u.k2 in ('heading', 'equation') and u.ord <> 5 and (u.x0 + u.x1) / 2 between v.x0 and v.x1 and (u.y0 + u.y1) / 2 between v.y0 and v.y0 + 100
union all select id, 'caption_tail', '' from w where before = 'caption' and k2 = 'body' and not suppressed and regexp_matches(t2, '^[a-z(]')"""

QUERIES = {f.__name__: f for f in (val_source, state_merge, state_merge_whole, state_reconcile, val_flow, val_strict, val_counters, agg_defects, val_readiness, join_ownership)}
