"""Gates on recorded evidence: metadata, visual reviews, readiness, cached results, deliveries and recovery pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _first(*rules: tuple[str, Column]) -> Column:
    """The code of the first condition that holds; null if none does."""
    out = None
    for code, rule in rules:
        hit = F.coalesce(rule, F.lit(False))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def metadata_error() -> Column:
    """First fault of an item: title, type, creators (array of struct(creatorType, name, lastName)), doi, arxiv, year, parent_key; null if it is sound."""
    return _first(
        ("title", _blank("title")), ("type", _blank("type")), ("creators", F.coalesce(F.size("creators"), F.lit(0)) <= 0), ("creator_type", F.exists("creators", lambda c: _blank(c["creatorType"]))),
        ("creator_name", F.exists("creators", lambda c: _blank(c["name"]) & _blank(c["lastName"]))), ("year", F.coalesce("doi", "arxiv", "year").isNull()), ("parent_key", ~_blank("parent_key") & ~F.col("parent_key").rlike("^[A-Za-z0-9]{8}$")),
    )


def visual_review_errors(reviews: DataFrame, pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """Violations (review, page, code) of visual reviews against outputs (review, source_sha, output_sha, page_count).

    reviews: review, status, source_sha, output_sha, role, agent, mode, reason, contact_sheet, open_issues, page_count; pages: review, page, status, findings, image, checks (array). A review must have
    passed, be of the current files, name its reviewer, leave nothing open, and hold each page of the output once with evidence. page is null where the whole review is meant.
    """
    r = reviews.join(outputs.select("review", F.col("source_sha").alias("_src"), F.col("output_sha").alias("_out"), F.col("page_count").alias("_n")), "review")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    named = (F.col("role") == "visual-review") & ~_blank("agent") & F.col("mode").isin("subagent", "coordinator-fallback")
    seen = pages.groupBy("review").agg(F.count("*").alias("_pages"), F.count_distinct("page").alias("_distinct"), F.min("page").alias("_lo"), F.max("page").alias("_hi"))
    r = r.join(seen, "review", "left")
    once = (F.col("_pages") == F.col("_n")) & (F.col("_distinct") == F.col("_n")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("_n"))
    codes = [
        ("status", bad(F.col("status") == "pass")), ("source_sha", bad(F.col("source_sha") == F.col("_src"))), ("output_sha", bad(F.col("output_sha") == F.col("_out"))), ("reviewer", bad(named)),
        ("fallback", F.coalesce(named & (F.col("mode") == "coordinator-fallback") & _blank("reason"), F.lit(False))), ("contact_sheet", bad(F.col("contact_sheet"))), ("open_issues", bad(F.col("open_issues") == 0)),
        ("page_count", bad(F.col("page_count") == F.col("_n"))), ("coverage", bad(once)),
    ]
    whole = r.select("review", F.lit(None).cast("int").alias("page"), F.explode(F.filter(F.array(*[F.when(c, code) for code, c in codes]), lambda x: x.isNotNull())).alias("code"))
    sound = (F.col("status") == "pass") & (F.col("findings") == 0) & ~_blank("image") & (F.size("checks") > 0) & F.forall("checks", lambda c: ~_blank(c))
    return whole.unionByName(pages.filter(bad(sound)).select("review", F.col("page").cast("int").alias("page"), F.lit("evidence").alias("code")))


def artifacts_state(evidence: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """For each key of evidence (by, path, sha) whether it has files and all are as recorded (files: path, sha): by, intact."""
    f = files.select(F.col("path").alias("_p"), F.col("sha").alias("_s"))
    j = evidence.join(f, F.col("path") == F.col("_p"), "left")
    return j.groupBy(by).agg(F.bool_and(F.coalesce(F.col("sha") == F.col("_s"), F.lit(False))).alias("intact"))


def readiness(reports: DataFrame, gates: DataFrame, artifacts: DataFrame, files: DataFrame, required: list[str], compiled: list[str]) -> DataFrame:
    """Why a report (report, status, fingerprint, current) doesn't stand (null if it does): status, stale, gates, glyphs or artifacts.

    gates: report, gate, status, missing_glyphs; artifacts: report, gate, path, sha. All required gates must have passed; compiled ones without missing glyphs and with unchanged artifacts.
    """
    passed = gates.groupBy("report").agg(
        F.count_distinct(F.when((F.col("status") == "pass") & F.col("gate").isin(required), F.col("gate"))).alias("_passed"), F.count_if(F.col("gate").isin(compiled) & ~F.coalesce(F.col("missing_glyphs") == 0, F.lit(False))).alias("_glyphs")
    )
    kept = artifacts_state(artifacts.filter(F.col("gate").isin(compiled)).withColumn("_k", F.struct("report", "gate")), files, "_k").filter("intact").groupBy(F.col("_k.report").alias("report")).agg(F.count("*").alias("_kept"))
    r = reports.join(passed, "report", "left").join(kept, "report", "left")
    error = _first(
        ("status", ~F.coalesce(F.col("status") == "pass", F.lit(False))), ("stale", ~F.col("fingerprint").eqNullSafe(F.col("current"))), ("gates", F.coalesce("_passed", F.lit(0)) < len(required)),
        ("glyphs", F.coalesce("_glyphs", F.lit(0)) > 0), ("artifacts", F.coalesce("_kept", F.lit(0)) < len(compiled)),
    )
    return r.select("report", error.alias("error"))


def cached(builds: DataFrame, previous: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Which earlier result each of builds (build, key) can use again (null: none): previous (result, key, status, missing_glyphs), artifacts (result, path, sha).

    A result counts if it passed, misses no glyphs, and all its artifacts, of which it has some, are as recorded; of several the smallest. Keys are summed before they are joined.
    """
    good = previous.filter("status = 'pass' and missing_glyphs = 0").join(artifacts_state(artifacts, files, "result").filter("intact"), "result").groupBy("key").agg(F.min("result").alias("reused"))
    return builds.join(good, "key", "left").select("build", "reused")


def delivery_status(records: DataFrame, children: DataFrame) -> DataFrame:
    """Status of each file to deliver (record, title, key, confirmed, sha) from what is there (child, title, sha: null while no bytes are stored).

    verified or metadata-created for the child of its title, else of its key; pending if there is none; errors: duplicate (titles, or title and key of two children),
    key_changed (of a confirmed one), bytes (others are stored) and disappeared (a confirmed one is gone).
    """
    by_title = children.groupBy(F.col("title").alias("_t")).agg(F.count("*").alias("_n"), F.min(F.struct("child", "sha")).alias("_a"))
    by_key = children.select(F.col("child").alias("_k"), F.struct("child", "sha").alias("_b")).dropDuplicates(["_k"])
    j = records.join(by_title, F.col("title") == F.col("_t"), "left").join(by_key, F.col("key") == F.col("_k"), "left")
    one = F.coalesce("_a", "_b")
    error = _first(
        ("duplicate", (F.col("_n") > 1) | (F.col("_a.child") != F.col("_b.child"))), ("key_changed", F.col("confirmed") & (F.col("key") != F.col("_a.child"))), ("bytes", one["sha"] != F.col("sha")), ("disappeared", one.isNull() & F.col("confirmed"))
    )
    return j.select("record", F.coalesce(error, F.when(one.isNull(), "pending").when(one["sha"].isNull(), "metadata-created").otherwise("verified")).alias("status"), F.coalesce(one["child"], F.col("key")).alias("key"))


def placements_by_member(placements: DataFrame) -> DataFrame:
    """The last placement (pos, id, ids, ...) of each member: member, pos. A placement's own id is a member too."""
    members = F.array_distinct(F.filter(F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array("id")), lambda x: x.isNotNull() & (x != "")))
    return placements.select("pos", F.explode(members).alias("member")).groupBy("member").agg(F.max("pos").alias("pos"))


def compact(units: DataFrame, reviews: DataFrame, fragments: str, keep: tuple[str, ...] = ("kind", "text", "tex", "review_status", "footnote_id")) -> DataFrame:
    """units (id, a map of token to struct) with fragments cut down to the fields of keep, where a review (id, token, tex, review_status) says other tex or status than null, these."""
    r = reviews.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("tex", "review_status")))).alias("_r"))
    said = lambda k, v, f: F.coalesce(F.element_at("_r", k)[f], v[f]) if f in ("tex", "review_status") else v[f]
    small = F.transform_values(fragments, lambda k, v: F.struct(*[said(k, v, f).alias(f) for f in keep]))
    return units.join(r, F.col("id") == F.col("_id"), "left").withColumn(fragments, small).drop("_id", "_r")


def pointers(updates: DataFrame, sources: DataFrame) -> DataFrame:
    """The recovery pointer of each paper: the last of updates (paper, step, stage, next_action, source_sha) if it is of the current source (paper, sha), else state stale; papers without updates are new."""
    last = updates.groupBy("paper").agg(F.max_by(F.struct("stage", "next_action", "source_sha"), "step").alias("p"))
    j = sources.join(last, "paper", "left")
    fresh = F.col("p.source_sha") == F.col("sha")
    return j.select("paper", F.when(F.col("p").isNull(), "new").when(fresh, "current").otherwise("stale").alias("state"), F.when(fresh, F.col("p.stage")).alias("stage"), F.when(fresh, F.col("p.next_action")).alias("next_action"))
