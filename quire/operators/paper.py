"""Papers: documents as units with the roles of an article, and the reviewed or derived range of their body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import normal_space
from quire.operators.units import UNITS_SQL, units

#: Headings that begin, conclude and end the body (fixed values).
INTRODUCTION = r"(?i)^\s*(?:\d+(?:\.\d+)*[.)]?\s+)?(?:introduction|引言)\b"
CONCLUSION = r"(?i)^\s*(?:\d+(?:\.\d+)*[.)]?\s+)?(?:conclusions?|concluding remarks?|discussion and conclusions?|结论)\b"
AFTER_BODY = (
    r"(?i)^\s*(?:[A-Z]|\d+(?:\.\d+)*)?[.)]?\s*(?:acknowledg(?:e)?ments?|funding|conflicts? of interest|author contributions?|references?|bibliography|"
    r"appendix|appendices|supplement(?:ary material)?|致谢|参考文献|附录)\b"
)
HEADINGS = ("heading", "abstract-heading", "keywords")
BODY_KINDS = ("heading", "body", "footnote")
REVIEWED_KINDS = (*BODY_KINDS, "front-matter")

#: Headings of the papers made of documents, in turn.
_TITLES = ("2 Methods", "3.1 Results of it", "4 Conclusion", "4.1 More  of it", "5 Outlook", "References")


def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of documents with kinds, numbered headings and boxes by their place: what the tables lack is made here and in PAPER_SQL alike."""
    o, d = F.col("ord"), F.col("doc_id")
    first = (o == 2) & (d % 6 != 0)
    kind = F.when(first | (o % 4 == 0), "heading").when(o % 7 == 3, "footnote").when(o % 7 == 5, "equation").when(o % 11 == 9, "header").otherwise("body")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), ((F.floor(o / 4) + d) % len(_TITLES) + 1).cast("int"))
    u = units(spark, sf_dir).select("doc_id", "id", "ord", "page", kind.alias("kind"), F.when(first, "1 Introduction").when(o % 4 == 0, title).otherwise(F.col("source_text")).alias("source_text"))
    line = (o - 1) % 40
    return u.select(
        "*",
        F.when(F.col("kind").isin(*BODY_KINDS), "text").otherwise("native").alias("render_mode"),
        ((d + o) % 13 == 6).alias("suppressed"),
        (F.lit(50.0) + 10 * (o % 3)).alias("x0"), (line * 20.0).alias("y0"), (F.lit(400.0) + 10 * (o % 3)).alias("x1"), (line * 20.0 + 12 + o % 5).alias("y1"),
        F.lit(10.0).alias("size"),
    )


PAPER_SQL = f"""{UNITS_SQL}, paper as (
  select *, case when kind in ('heading', 'body', 'footnote') then 'text' else 'native' end as render_mode, (doc_id + ord) % 13 = 6 as suppressed,
    cast(50 + 10 * (ord % 3) as double) as x0, cast(20 * ((ord - 1) % 40) as double) as y0, cast(400 + 10 * (ord % 3) as double) as x1, cast(20 * ((ord - 1) % 40) + 12 + ord % 5 as double) as y1, cast(10 as double) as size
  from (select doc_id, id, ord, page,
    case when (ord = 2 and doc_id % 6 <> 0) or ord % 4 = 0 then 'heading' when ord % 7 = 3 then 'footnote' when ord % 7 = 5 then 'equation' when ord % 11 = 9 then 'header' else 'body' end as kind,
    case when ord = 2 and doc_id % 6 <> 0 then '1 Introduction' when ord % 4 = 0 then ['2 Methods', '3.1 Results of it', '4 Conclusion', '4.1 More  of it', '5 Outlook', 'References'][(ord // 4 + doc_id) % 6 + 1] else source_text end as source_text
  from units))"""


def numbered_level(text):
    """Level of a heading by its number; null without one."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def body_by_headings(u: DataFrame) -> DataFrame:
    """Derived range of the body of each document (doc_id, id, ord, kind, source_text, render_mode).

    The body begins at the first introduction. After a conclusion it ends at the next heading whose number is of the same or a
    higher level and that is no conclusion itself, and at any heading of what follows a body. Adds section (the last heading, '' before the
    first), introduction_id, conclusion_id (the last before the end), stop_id (null if not found) and translatable.
    """
    all_of, before = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("ord")
    text = normal_space(F.col("source_text"))
    u = u.withColumn("_text", F.when(F.col("kind").isin(*HEADINGS) & (text != ""), text)).withColumn("_level", numbered_level(F.col("_text")))
    u = u.withColumn("_from", F.min(F.when(F.col("_text").rlike(INTRODUCTION), F.col("ord"))).over(all_of))
    inside = F.col("ord") > F.col("_from")
    u = u.withColumn("_conclusion", inside & F.col("_text").rlike(CONCLUSION))
    so_far = before.rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_open", F.last(F.when(F.col("_conclusion"), F.coalesce("_level", F.lit(1))), ignorenulls=True).over(so_far))
    ends = inside & ~F.col("_conclusion") & ((F.col("_level") <= F.col("_open")) | F.col("_text").rlike(AFTER_BODY))
    u = u.withColumn("_to", F.min(F.when(ends, F.col("ord"))).over(all_of))
    ahead = F.col("_to").isNull() | (F.col("ord") < F.col("_to"))
    return u.select(
        *[c for c in u.columns if not c.startswith("_")],
        F.coalesce(F.last("_text", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("")).alias("section"),
        F.max(F.when(F.col("ord") == F.col("_from"), F.col("id"))).over(all_of).alias("introduction_id"),
        F.max_by("id", F.when(F.col("_conclusion") & ahead, F.col("ord"))).over(all_of).alias("conclusion_id"),
        F.max(F.when(F.col("ord") == F.col("_to"), F.col("id"))).over(all_of).alias("stop_id"),
        F.coalesce((F.col("ord") >= F.col("_from")) & ahead & (F.col("render_mode") == "text") & F.col("kind").isin(*BODY_KINDS), F.lit(False)).alias("translatable"),
    )


def body_by_review(u: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed range of the body: u as in body_by_headings() with suppressed; reviews: doc_id, start_id, stop_before_id, include_ids, exclude_ids, allow_missing_conclusion.

    From start_id to before stop_before_id; included units count beyond kind and range, excluded and suppressed ones never. A review
    that names unknown units, runs backward, includes what it excludes, or finds no conclusion without leave is rejected
    whole: error says why and nothing of the document is translatable. Adds section, conclusion_id, translatable, error.
    """
    all_of, before = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.join(reviews, "doc_id")
    place = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("ord"))).over(all_of)
    u = u.withColumn("_from", place("start_id")).withColumn("_to", place("stop_before_id")).withColumn("_text", normal_space(F.col("source_text")))
    named = F.array_distinct(F.concat("include_ids", "exclude_ids"))
    met = F.sum(F.array_contains(named, F.col("id")).cast("int")).over(all_of)
    inside = (F.col("ord") >= F.col("_from")) & (F.col("ord") < F.col("_to"))
    active = inside & ~F.col("suppressed")
    u = u.withColumn("_last", F.last(F.when(active & ((F.col("kind") == "heading") | (F.col("id") == F.col("start_id"))) & (F.col("_text") != ""), F.col("_text")), ignorenulls=True).over(before))
    u = u.withColumn("conclusion_id", F.min_by("id", F.when(active & F.col("_text").rlike(CONCLUSION), F.col("ord"))).over(all_of))
    error = (
        F.when(F.col("_from").isNull() | F.col("_to").isNull(), "unknown_bounds").when(F.col("_from") >= F.col("_to"), "order").when(met < F.size(named), "unknown_ids")
        .when(F.arrays_overlap("include_ids", "exclude_ids"), "overlap").when(F.col("conclusion_id").isNull() & ~F.col("allow_missing_conclusion"), "no_conclusion")
    )
    u = u.withColumn("error", error)
    chosen = F.array_contains("include_ids", F.col("id")) | (inside & (F.col("render_mode") == "text") & F.col("kind").isin(*REVIEWED_KINDS))
    chosen = chosen & ~F.array_contains("exclude_ids", F.col("id")) & ~F.col("suppressed") & F.col("error").isNull()
    gone = [c for c in u.columns if c.startswith("_") or c in reviews.columns and c != "doc_id"]
    return u.withColumn("section", F.coalesce("_last", F.lit(""))).withColumn("translatable", F.coalesce(chosen, F.lit(False))).drop(*gone)


def body_range(u: DataFrame, include_ids: str = "include_ids") -> DataFrame:
    """Units from the introduction (the first unit without one) up to the end of the body, widened to every unit that is translatable or included and not suppressed.

    u: doc_id, id, ord, introduction_id, stop_id, translatable, suppressed and an array of included ids.
    """
    all_of = Window.partitionBy("doc_id")
    place = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("ord"))).over(all_of)
    needed = F.when((F.col("translatable") | F.array_contains(include_ids, F.col("id"))) & ~F.col("suppressed"), F.col("ord"))
    low = F.least(F.coalesce(place("introduction_id"), F.min("ord").over(all_of)), F.min(needed).over(all_of))
    high = F.greatest(F.coalesce(place("stop_id"), F.max("ord").over(all_of) + 1), F.max(needed).over(all_of) + 1)
    return u.withColumn("_low", low).withColumn("_high", high).filter((F.col("ord") >= F.col("_low")) & (F.col("ord") < F.col("_high"))).drop("_low", "_high")


#: Running text: repeated on so many pages, within this share of the page's top, with so many characters (fixed values).
RUNNING_PAGES, RUNNING_TOP, RUNNING_LENGTH = 3, 0.20, (5, 120)


def repeated_running(u: DataFrame, pages: DataFrame) -> DataFrame:
    """Headers that were read as body or heading: u (doc_id, id, page, kind, source_text, y1) with kind `header` where a text recurs at the top of at least three pages after the first.

    pages: doc_id, page, height. Texts are compared by their words in lower case.
    """
    text = normal_space(F.col("source_text"))
    top = u.join(pages, ["doc_id", "page"]).filter((F.col("page") > 1) & (F.col("height") > 0) & (F.col("y1") <= F.col("height") * RUNNING_TOP) & F.length(text).between(*RUNNING_LENGTH))
    key = F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "))
    top = top.select("doc_id", "id", "page", key.alias("key")).filter("key != ''")
    # pages are counted after one row a (key, page) is left: a hot key is summed in parts
    hot = top.select("doc_id", "key", "page").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= RUNNING_PAGES).drop("n")
    running = top.join(hot, ["doc_id", "key"], "left_semi").select("doc_id", "id").withColumn("_running", F.lit(True))
    out = u.join(running, ["doc_id", "id"], "left")
    return out.withColumn("kind", F.when(F.col("_running") & F.col("kind").isin("body", "heading"), "header").otherwise(F.col("kind"))).drop("_running")
