"""Queries of the gates on recorded evidence, made of orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evidence as E
from quire.operators import folds
from quire.operators.units import UNITS_SQL, table, units


def _text(c):
    return c.cast("string")


def val_metadata(spark, sf):
    """First fault of each part as a bibliographic item."""
    k = F.col("p_partkey")
    creator = lambda kind, name, last: F.struct(kind.cast("string").alias("creatorType"), name.cast("string").alias("name"), last.cast("string").alias("lastName"))
    none = F.lit(None)
    creators = (
        F.when(k % 11 == 1, F.array().cast("array<struct<creatorType:string,name:string,lastName:string>>")).when(k % 11 == 2, F.array(creator(F.lit("author"), F.lit("A"), none), creator(F.lit(" "), F.lit("A"), none)))
        .when(k % 11 == 3, F.array(creator(F.lit("author"), F.lit(""), none))).when(k % 11 == 4, none).otherwise(F.array(creator(F.lit("author"), none, F.lit("B"))))
    )
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(k % 17 != 0, "book").alias("type"), creators.alias("creators"), F.when(k % 3 == 0, "10.1/x").alias("doi"), F.when(k % 5 == 0, "2001.00001").alias("arxiv"),
        F.when(k % 2 == 0, "1999").alias("year"), F.when(k % 7 == 0, "ABCD123").when(k % 7 == 1, "ABCD1234").alias("parent_key"),
    )
    return p.select("p_partkey", E.metadata_error().alias("fault"))


def val_visual_review(spark, sf):
    """Violations of reviews: an order is a review, its lines are the pages."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    n = l.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("int").alias("page_count"))
    out = n.select(F.col("l_orderkey").alias("review"), F.lit("s").alias("source_sha"), F.lit("o").alias("output_sha"), "page_count")
    r = o.join(n, k == F.col("l_orderkey")).select(
        k.alias("review"), F.when(k % 7 == 0, "fail").otherwise("pass").alias("status"), F.when(k % 11 == 0, "x").otherwise("s").alias("source_sha"), F.when(k % 13 != 0, "o").alias("output_sha"), F.lit("visual-review").alias("role"),
        F.when(k % 17 == 0, " ").otherwise("a1").alias("agent"), F.when(k % 5 == 0, "coordinator-fallback").otherwise("subagent").alias("mode"), F.when(k % 2 == 0, "busy").alias("reason"), (k % 19 != 0).alias("contact_sheet"),
        F.when(k % 23 == 0, 1).otherwise(0).alias("open_issues"), (F.col("page_count") + F.when(k % 29 == 0, 1).otherwise(0)).alias("page_count"),
    )
    p = l.select(
        F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("page"), F.when(F.col("l_suppkey") % 9 == 0, "fail").otherwise("pass").alias("status"), F.when(F.col("l_partkey") % 31 == 0, 1).otherwise(0).alias("findings"),
        F.when(F.col("l_partkey") % 7 == 0, " ").otherwise("p.png").alias("image"), F.when(F.col("l_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("seen"))).alias("checks"),
    )
    return E.visual_review_errors(r, p, out)


def gate_ready(spark, sf):
    """Why the report of an order doesn't stand: its first four lines are gates."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"), F.max("l_partkey").alias("l_partkey"))
    k, g = F.col("o_orderkey"), F.concat(F.lit("g"), _text(F.col("l_linenumber")))
    reports = o.select(k.alias("report"), F.when(k % 5 == 0, "fail").otherwise("pass").alias("status"), F.when(k % 7 > 0, "f").alias("fingerprint"), F.lit("f").alias("current"))
    gates = l.select(F.col("l_orderkey").alias("report"), g.alias("gate"), F.when(F.col("l_suppkey") % 10 == 0, "fail").otherwise("pass").alias("status"), F.when(F.col("l_partkey") % 9 == 0, 2).when(F.col("l_partkey") % 9 > 1, 0).alias("missing_glyphs"))
    path = F.concat(F.lit("p"), _text(F.col("l_partkey") % 100))
    arts = l.filter("l_suppkey % 6 > 0").select(F.col("l_orderkey").alias("report"), g.alias("gate"), path.alias("path"), F.md5(path).alias("sha"))
    files = spark.range(95).select(F.concat(F.lit("p"), _text(F.col("id"))).alias("path")).select("path", F.when(F.col("path") == "p7", "x").otherwise(F.md5("path")).alias("sha"))
    return E.readiness(reports, gates, arts, files, ["g1", "g2", "g3"], ["g1", "g2"])


def cache_compile(spark, sf):
    """Earlier results that the parts' builds use again."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    key = F.sha2(F.concat_ws("|", "p_type", "p_brand"), 256)
    previous = p.filter("p_partkey % 2 = 1").select(k.alias("result"), key.alias("key"), F.when(k % 5 == 0, "fail").otherwise("pass").alias("status"), (k % 7 / 6).cast("int").alias("missing_glyphs"))
    arts = p.filter("p_partkey % 3 > 0").select(k.alias("result"), F.explode(F.array(_text(k % 50), _text(k % 49))).alias("path")).select("result", "path", F.md5("path").alias("sha"))
    files = spark.range(48).select(_text(F.col("id")).alias("path")).select("path", F.when(F.col("path") == "13", "x").otherwise(F.md5("path")).alias("sha"))
    return E.cached(p.filter("p_partkey % 2 = 0").select(k.alias("build"), key.alias("key")), previous, arts, files)


def state_receipt(spark, sf):
    """Status of files to deliver, made of parts, against what suppliers hold."""
    k = F.col("p_partkey")
    records = table(spark, sf, "part").select(k.alias("record"), F.concat(F.lit("t"), _text(k % 160)).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("c"), _text(k % 130))).alias("key"), (k % 3 == 0).alias("confirmed"), F.concat(F.lit("h"), _text(k % 160 % 9)).alias("sha"))
    s = F.col("s_suppkey")
    children = table(spark, sf, "supplier").select(F.concat(F.lit("c"), _text(s)).alias("child"), F.concat(F.lit("t"), _text(F.when(s % 10 == 3, s + 1).otherwise(s))).alias("title"), F.when(s % 4 > 0, F.concat(F.lit("h"), _text(s % F.when(s % 7 == 0, 8).otherwise(9)))).alias("sha"))
    return E.delivery_status(records, children)


def state_pointer(spark, sf):
    """Recovery pointers of users: their events are the updates."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "paper")
    updates = e.select("paper", F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("stage"), F.concat(F.lit("after "), _text(F.col("event_id"))).alias("next_action"), F.when(F.col("event_id") % 3 == 0, "old").otherwise("s").alias("source_sha"))
    return E.pointers(updates, e.select("paper").union(e.select((F.col("paper") + 5).alias("paper"))).distinct().withColumn("sha", F.lit("s")))


def join_placement(spark, sf):
    """The last placement of each unit that placements name: an order's lines place parts."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(_text(F.col("l_partkey")))).alias("ids"))
    return E.placements_by_member(l.select(F.col("l_orderkey").alias("pos"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("o"), _text(F.col("l_orderkey") % 90))).otherwise("").alias("id"), "ids"))


def proj_compact(spark, sf):
    """Units with fragments cut down to what a translator needs, and reviews applied."""
    d = F.col("doc_id")
    fields = lambda k: F.struct(F.lit("math").alias("kind"), _text(d).alias("text"), F.lit(f"x{k}").alias("tex"), F.when(d % 4 > 0, "unresolved").alias("review_status"), F.lit(None).cast("string").alias("footnote_id"), F.lit("<i/>").alias("html"), F.array(F.lit(1)).alias("runs"))
    u = table(spark, sf, "documents").select(_text(d).alias("id"), F.create_map(F.lit("[[F1]]"), fields(1), F.lit("[[F2]]"), fields(2)).alias("fragments"), d.alias("doc_id"))
    r = u.filter("doc_id % 3 = 0").select("id", F.lit("[[F1]]").alias("token"), F.lit("y").alias("tex"), F.lit(None).cast("string").alias("review_status"))
    r = r.union(u.filter("doc_id % 5 = 0").select("id", F.lit("[[F2]]"), F.lit(None).cast("string"), F.lit("reviewed")))
    return E.compact(u, r, "fragments").select("id", F.to_json("fragments", {"ignoreNullFields": "false"}).alias("fragments"))


def win_coalesce_style(spark, sf):
    """Neighbouring words of one style, parted by white space alone, are one run."""
    return folds.word_runs(units(spark, sf))


SQL = {
    "val_metadata": """select p_partkey, case when p_partkey % 13 = 0 then 'title' when p_partkey % 17 = 0 then 'type' when p_partkey % 11 in (1, 4) then 'creators' when p_partkey % 11 = 2 then 'creator_type' when p_partkey % 11 = 3 then 'creator_name'
  when p_partkey % 3 > 0 and p_partkey % 5 > 0 and p_partkey % 2 = 1 then 'year' when p_partkey % 7 = 0 then 'parent_key' end as fault from part""",
    "val_visual_review": """with l as (select * from lineitem), n as (select l_orderkey as k, max(l_linenumber) as n, count(*) as c, count(distinct l_linenumber) as d, min(l_linenumber) as lo from l join orders on o_orderkey = l_orderkey group by 1)
select k as review, cast(null as integer) as page, unnest(list_filter([case when k % 7 = 0 then 'status' end, case when k % 11 = 0 then 'source_sha' end, case when k % 13 = 0 then 'output_sha' end, case when k % 17 = 0 then 'reviewer' end, case when k % 17 > 0 and k % 5 = 0 and k % 2 = 1 then 'fallback' end,
  case when k % 19 = 0 then 'contact_sheet' end, case when k % 23 = 0 then 'open_issues' end, case when k % 29 = 0 then 'page_count' end, case when c <> n or d <> n or lo <> 1 then 'coverage' end], lambda x: x is not null)) as code from n
union all select l_orderkey, cast(l_linenumber as integer), 'evidence' from l where l_suppkey % 9 = 0 or l_partkey % 31 = 0 or l_partkey % 7 = 0 or l_partkey % 5 = 0""",
    "gate_ready": """with l as (select l_orderkey as k, l_linenumber as n, max(l_suppkey) as s, max(l_partkey) as p from lineitem group by 1, 2),
g as (select k, count(*) filter (where n <= 3 and s % 10 > 0) as passed, count(*) filter (where n <= 2 and (p % 9 = 0 or p % 9 = 1)) as glyphs, count(*) filter (where n <= 2 and s % 6 > 0 and p % 100 < 95 and p % 100 <> 7) as kept from l group by k)
select o_orderkey as report, case when o_orderkey % 5 = 0 then 'status' when o_orderkey % 7 = 0 then 'stale' when coalesce(passed, 0) < 3 then 'gates' when glyphs > 0 then 'glyphs' when kept < 2 then 'artifacts' end as error from orders left join g on k = o_orderkey""",
    "cache_compile": """with g as (select p_type, p_brand, min(p_partkey) as reused from part where p_partkey % 2 = 1 and p_partkey % 5 > 0 and p_partkey % 7 < 6 and p_partkey % 3 > 0 and p_partkey % 50 < 48 and p_partkey % 50 <> 13 and p_partkey % 49 < 48 and p_partkey % 49 <> 13 group by 1, 2)
select p_partkey as build, reused from part left join g using (p_type, p_brand) where p_partkey % 2 = 0""",
    "state_receipt": """with r as (select p_partkey as record, 't' || (p_partkey % 160) as title, case when p_partkey % 2 = 0 then 'c' || (p_partkey % 130) end as key, p_partkey % 3 = 0 as confirmed, 'h' || (p_partkey % 160 % 9) as sha from part),
c as (select 'c' || s_suppkey as child, 't' || case when s_suppkey % 10 = 3 then s_suppkey + 1 else s_suppkey end as title, case when s_suppkey % 4 > 0 then 'h' || (s_suppkey % case when s_suppkey % 7 = 0 then 8 else 9 end) end as sha from supplier),
j as (select r.*, (select count(*) from c where c.title = r.title) as n, (select min(child) from c where c.title = r.title) as a, (select child from c where c.child = r.key) as b from r),
k as (select *, coalesce(a, b) as one, (select sha from c where child = coalesce(a, b)) as stored from j)
select record, case when n > 1 or a <> b then 'duplicate' when confirmed and key <> a then 'key_changed' when stored <> sha then 'bytes' when one is null and confirmed then 'disappeared' when one is null then 'pending' when stored is null then 'metadata-created' else 'verified' end as status, coalesce(one, key) as key from k""",
    "state_pointer": """with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), s as (select user_id as paper from events union select user_id + 5 from events)
select paper, case when event_id is null then 'new' when event_id % 3 = 0 then 'stale' else 'current' end as state, case when event_id % 3 > 0 then event_type end as stage, case when event_id % 3 > 0 then 'after ' || event_id end as next_action from s left join l on user_id = paper and k = 1""",
    "join_placement": "select member, max(l_orderkey) as pos from (select l_orderkey, cast(l_partkey as varchar) as member from lineitem union all select l_orderkey, 'o' || (l_orderkey % 90) from lineitem where l_orderkey % 2 = 0) group by member",
    "proj_compact": """with f as (select doc_id, k, '"[[F' || k || ']]":{"kind":"math","text":"' || doc_id || '","tex":"' || case when k = 1 and doc_id % 3 = 0 then 'y' else 'x' || k end || '","review_status":' || case when k = 2 and doc_id % 5 = 0 then '"reviewed"' when doc_id % 4 > 0 then '"unresolved"' else 'null' end || ',"footnote_id":null}' as f
  from documents, (values (1), (2)) v(k)) select cast(doc_id as varchar) as id, '{' || string_agg(f, ',' order by k) || '}' as fragments from f group by doc_id""",
    "win_coalesce_style": f"""with {UNITS_SQL}, p as (select id, source_text, unnest(string_split(source_text, ' ')) as word, unnest(range(1, len(string_split(source_text, ' ')) + 1)) as k from units),
q as (select *, coalesce(sum(length(word) + 1) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) as start from p),
w as (select *, start + length(word) as stop, case when length(word) % 2 = 0 then 'bold' else 'italic' end as kind, row_number() over (partition by id order by k) as n from q where word <> '' and length(word) <> 3),
-- a run goes on over nothing but empty words
z as (select w.*, case when lag(kind) over o = kind and not exists (select 1 from q where q.id = w.id and q.k < w.k and q.k > w.pk and q.word <> '') then 0 else 1 end as new from (select *, lag(k) over (partition by id order by k) as pk from w) w window o as (partition by id order by k)),
y as (select *, sum(new) over (partition by id order by k) as island from z) select id, kind, cast(min(start) as bigint) as start, cast(max(stop) as bigint) as end from y group by id, island, kind""",
}

QUERIES = {f.__name__: f for f in (val_metadata, val_visual_review, gate_ready, cache_compile, state_receipt, state_pointer, join_placement, proj_compact, win_coalesce_style)}
