"""Rules over units, checkpoints and reviews: each reports its violations as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of prose, signs of mathematics, equation numbers, letters of scripts; headings stand out from this share of the body's size on (fixed values).
PROSE_WORD, MATH_SIGN = re.compile(r"[A-Za-z]{3,}"), re.compile(r"[=<>≤≥≈≠∑∏∫√∞±×÷∂∇∈∉→←↔⊥∗◦+*/^|]")
EQUATION_NUMBER, SCRIPT = re.compile(r"\(\d+(?:\.\d+)*[a-z]?\)\s*$", re.I), re.compile(r"[\wΑ-ω\U0001d400-\U0001d7ff]+")
STRONG_SIGN = re.compile(r"[=<>≤≥≈≠∑∏∫√∞±×÷∂∇∈∉→←↔⊥∗◦\U0001d400-\U0001d7ff]")
HEADING_SIZE, BASE_SIZE, CAPTION_TAIL = 1.12, 1.12, 180
FLOW_ROLES = ("paragraph", "list_item", "list_continuation")
#: Bodies of fewer characters may stay without Han text or unchanged (fixed value).
LONG_BODY = 60


def flow_error() -> Column:
    """The first broken rule of a unit's flow, over flow_role, list_id, list_level, source_marker, flow_reviewed, continuation_of, kind, translatable, source_text; null if all hold."""
    c, role, marker = F.col, F.col("flow_role"), F.col("source_marker")
    bare = F.coalesce(F.trim(marker), F.lit("")) == ""
    linked = c("continuation_of").isNotNull()
    return (
        F.when(~role.isin(*FLOW_ROLES), "role")
        .when(linked & (F.trim("continuation_of") == ""), "continuation_id")
        .when(linked & ~((role == "paragraph") & (c("kind") == "body") & c("translatable") & c("flow_reviewed")), "continuation_kind")
        .when(c("list_level") < 0, "level").when(marker.isNull(), "marker_type")
        .when((role == "paragraph") & (c("list_id").isNotNull() | (c("list_level") != 0) | (marker != "")), "paragraph_list")
        .when((role != "paragraph") & (F.coalesce(F.trim("list_id"), F.lit("")) == ""), "list_id")
        .when((role == "list_item") & bare, "item_marker").when((role == "list_item") & ~F.startswith(F.ltrim("source_text"), marker), "marker_text")
        .when((role == "list_continuation") & (marker != ""), "continuation_marker")
    )


def checkpoint_errors(units: DataFrame, checkpoint: DataFrame, has_language: Column) -> DataFrame:
    """Violations (id, code, detail) of a checkpoint (id, translated_text) against units (id, kind, source_text, translatable, literals, fragments, styles: arrays of tokens and keys).

    missing and extra ids; empty text; tokens that don't stand once; emphasis that doesn't open and close once, in this order; long bodies without
    the language (has_language, a condition on `_words`, the text without tokens) or with the source's own text.
    """
    j = units.filter("translatable").join(checkpoint.select(F.col("id").alias("_id"), F.col("translated_text").alias("_t")), F.col("id") == F.col("_id"), "full_outer")
    j = j.withColumn("_words", F.regexp_replace("_t", r"\[\[[A-Za-z0-9_]+\]\]", ""))
    t = F.col("_t")
    count = lambda k: ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("int")
    issue = lambda code, detail=None: F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"))
    here = F.col("id").isNotNull() & F.col("_id").isNotNull()
    blank = F.coalesce(F.trim(t), F.lit("")) == ""
    full = here & ~blank
    ends = lambda k, e: F.concat(F.lit("[["), k, F.lit(f"_{e}]]"))
    none = F.array().cast("array<struct<code:string,detail:string>>")
    tokens = F.transform(F.filter(F.concat("literals", "fragments"), lambda k: count(k) != 1), lambda k: F.struct(F.lit("token_count").alias("code"), F.concat(k, F.lit(" "), count(k).cast("string")).alias("detail")))
    styles = F.transform(
        F.filter("styles", lambda k: ~((count(ends(k, "OPEN")) == 1) & (count(ends(k, "CLOSE")) == 1) & (F.instr(t, ends(k, "OPEN")) < F.instr(t, ends(k, "CLOSE"))))), lambda k: F.struct(F.lit("style_order").alias("code"), k.alias("detail"))
    )
    long = full & (F.col("kind") == "body") & (F.length("source_text") >= LONG_BODY)
    found = F.concat(
        F.when(F.col("_id").isNull(), F.array(issue("missing"))).otherwise(none),
        F.when(F.col("id").isNull(), F.array(issue("extra"))).otherwise(none),
        F.when(here & blank, F.array(issue("empty"))).otherwise(none),
        F.when(full, F.coalesce(tokens, none)).otherwise(none),
        F.when(full, F.coalesce(styles, none)).otherwise(none),
        F.when(long & ~has_language, F.array(issue("language"))).otherwise(none),
        F.when(long & (t == F.col("source_text")), F.array(issue("unchanged"))).otherwise(none),
    )
    return j.select(F.coalesce("id", "_id").alias("id"), F.explode(found).alias("e")).select("id", "e.code", "e.detail")


def counter_errors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ: key, expected, actual."""
    e, a = left.groupBy(key).agg(F.count("*").alias("expected")), right.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("actual"))
    j = e.join(a, F.col(key).eqNullSafe(F.col("_k")), "full_outer").select(F.coalesce(key, "_k").alias(key), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return j.filter("expected != actual")


def defects(findings: DataFrame) -> DataFrame:
    """Defects (defect_id, category, source_unit, symptom, reviews, in_category) of findings (review, page, category, source_unit, symptom, defect_id).

    A defect without id is known by a hash of category, unit and symptom, and of its page where it has no unit; category is layout where it isn't said. reviews counts
    the reviews that name it, in_category the defects of its category.
    """
    f = findings.withColumn("category", F.coalesce("category", F.lit("layout")))
    known = F.struct(F.col("category"), F.col("source_unit"), F.col("symptom"))
    paged = F.struct(F.col("category"), F.col("page").alias("initial_page"), F.col("source_unit"), F.col("symptom"))
    text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    stable = F.sha2(F.when(F.col("source_unit").isNull(), text(paged)).otherwise(text(known)), 256)
    f = f.withColumn("defect_id", F.coalesce("defect_id", F.concat(F.lit("defect-"), F.substring(stable, 1, 16))))
    last = F.max_by(F.struct("category", "source_unit", "symptom"), F.struct("review", "page", "symptom", "category"))
    d = f.groupBy("defect_id").agg(last.alias("d"), F.count_distinct("review").alias("reviews")).select("defect_id", "d.*", "reviews")
    return d.join(d.groupBy(F.col("category").alias("_c")).agg(F.count("*").alias("in_category")), F.col("category") == F.col("_c")).drop("_c")


def readiness_errors(defect: DataFrame, repairs: DataFrame) -> DataFrame:
    """Violations (defect_id, code) of repairs (defect_id, status, images, related_images, scope, regression, systemic, repeated) of defects().

    Each defect must be repaired once, and nothing else; a repair is resolved and inspected; where several defects share a category, or it is systemic, images of related
    places and a scope are needed; where it was found in several reviews, or is repeated, regression evidence.
    """
    r = repairs.groupBy(F.col("defect_id").alias("_d")).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in repairs.columns if c != "defect_id"])).alias("r"))
    j = defect.join(r, F.col("defect_id") == F.col("_d"), "full_outer")
    lacks = lambda c: F.coalesce(F.size(f"r.{c}"), F.lit(0)) <= 0
    here = F.col("_d").isNotNull()
    systemic = F.coalesce("r.systemic", F.lit(False)) | (F.coalesce("in_category", F.lit(0)) > 1)
    repeated = F.coalesce("r.repeated", F.lit(False)) | (F.coalesce("reviews", F.lit(0)) > 1)
    codes = [
        F.when(F.col("defect_id").isNull() | ~here | (F.col("_n") > 1), "cover"), F.when(here & ~(F.coalesce("r.status", F.lit("")) == "resolved"), "unresolved"), F.when(here & lacks("images"), "uninspected"),
        F.when(here & systemic & (lacks("related_images") | (F.coalesce("r.scope", F.lit("")) == "")), "systemic"), F.when(here & repeated & lacks("regression"), "regression"),
    ]
    return j.select(F.coalesce("defect_id", "_d").alias("defect_id"), F.explode(F.filter(F.array(*codes), lambda x: x.isNotNull())).alias("code"))


def ownership_errors(units: DataFrame, reviews: DataFrame) -> DataFrame:
    """Violations (owner, code) of reviews (doc_id, owner, source_ids) that group the display equations of units (doc_id, id, ord, page, kind, suppressed).

    Of a group the first broken rule: no members, a member twice, unknown members, not in reading order, not owned by the first active equation, other active text within,
    several pages, an active unit between that isn't a member. Then units: owned twice (owner is the unit), and active equations that nobody owns.
    """
    m = reviews.select("doc_id", "owner", F.size("source_ids").alias("n"), F.size(F.array_distinct("source_ids")).alias("n_distinct"), F.posexplode_outer("source_ids").alias("pos", "id"))
    u = units.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), "ord", "page", (~F.col("suppressed")).alias("active"), (F.col("kind") == "equation").alias("equation"))
    m = m.join(u, (F.col("doc_id") == F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
    by = Window.partitionBy("doc_id", "owner").orderBy("pos")
    m = m.withColumn("back", F.col("ord") < F.lag("ord").over(by))
    g = m.groupBy("doc_id", "owner").agg(
        F.max("n").alias("n"), F.max("n_distinct").alias("n_distinct"), F.count("_id").alias("known"), F.bool_or("back").alias("back"), F.min_by("id", F.when(F.col("active") & F.col("equation"), F.col("ord"))).alias("first"),
        F.bool_or(F.col("active") & ~F.col("equation")).alias("text"), F.count_distinct("page").alias("pages"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_if("active").alias("n_active"),
    )
    # active units from the first to the last member, against the active members
    within = g.select("doc_id", "owner", "lo", "hi").join(units.filter("not suppressed").select(F.col("doc_id").alias("_doc"), F.col("ord").alias("_ord")), (F.col("doc_id") == F.col("_doc")) & F.col("_ord").between(F.col("lo"), F.col("hi")))
    g = g.join(within.groupBy("doc_id", "owner").agg(F.count("*").alias("n_within")), ["doc_id", "owner"], "left")
    code = (
        F.when(F.col("n") < 1, "no_members").when(F.col("n_distinct") < F.col("n"), "repeated").when(F.col("known") < F.col("n"), "unknown").when(F.coalesce("back", F.lit(False)), "order")
        .when(F.col("first").isNull() | (F.col("first") != F.col("owner")), "owner").when(F.coalesce("text", F.lit(False)), "text").when(F.col("pages") > 1, "pages").when(F.col("n_within") > F.col("n_active"), "crosses")
    )
    groups = g.select("owner", code.alias("code")).filter("code is not null")
    owned = m.filter("_id is not null").select("_id", "owner").distinct().groupBy("_id").agg(F.count("*").alias("n"))
    twice = owned.filter("n > 1").select(F.col("_id").alias("owner"), F.lit("overlap").alias("code"))
    bare = units.filter("kind = 'equation' and not suppressed").join(owned, F.col("id") == F.col("_id"), "left_anti").select(F.col("id").alias("owner"), F.lit("unowned").alias("code"))
    return groups.unionByName(twice).unionByName(bare)


def _unit_issues(u, body_size: float) -> list[tuple[str, str]]:
    """(code, detail) of one active, translatable body or heading unit; see source_issues()."""
    from quire.functions.protect import SCRIPT_SIZE, _is_code
    from quire.operators.folds import align, list_marks

    text, runs = u.source_text or "", list(u.runs) if u.runs is not None else []
    runs = [r if isinstance(r, dict) else r.asDict() for r in runs]
    marks = list_marks(text)
    mixed = len(marks) > 1 or bool(marks and marks[0][0] > 0)
    if u.kind == "heading":
        strong = any(r["style"] == "bold" or (r["flags"] or 0) & 16 for r in runs) or (body_size > 0 and (u.size or 0) >= body_size * HEADING_SIZE)
        return [("heading_list_ambiguous", "")] if marks and (mixed or not strong) else []
    out = []
    if u.flow_error is not None or mixed or u.flow_review is not None or (marks and u.flow_role != "list_item"):
        out.append(("flow_ambiguous", u.flow_error or u.flow_review or ""))
    fragments = [f if isinstance(f, dict) else f.asDict() for f in (u.fragments if u.fragments is not None else [])]
    largest = max((r["size"] or 0.0 for r in runs), default=0.0)
    for k, (r, (a, b, status)) in enumerate(zip(runs, align(text, [r["text"] or "" for r in runs], [r["line"] for r in runs]))):
        said = (r["text"] or "").strip()
        if not said:
            continue
        if status != "located":
            out.append((f"{status}_source_span", str(k)))
        if a is None:
            continue
        over = [f for f in fragments if f["start"] <= a and b <= f["end"]]
        if not over and not _is_code(r) and ((r["style"] == "math" and re.search(r"[\wΑ-ω]", said)) or STRONG_SIGN.search(said)):
            out.append(("uncovered_math_span", str(k)))
        script = SCRIPT.fullmatch(said) and ((r["flags"] or 0) & 1 or (largest > 0 and 0 < (r["size"] or 0) <= largest * SCRIPT_SIZE))
        if script and not any(f["kind"] in ("citation", "code", "footnote-marker", "list-marker") for f in over):
            if not any(f["kind"] == "math" and (f["size"] or 0) > (r["size"] or 0) * BASE_SIZE for f in over):
                out.append(("orphan_script", str(k)))
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if EQUATION_NUMBER.search(line):
            whole = f"{lines[k - 1]} {line}" if k and EQUATION_NUMBER.fullmatch(line.strip()) else line
            bare = EQUATION_NUMBER.sub("", whole.strip()).strip()
            if len(PROSE_WORD.findall(bare)) <= 2 and MATH_SIGN.search(bare):
                out.append(("numbered_display_in_body", str(k)))
    squeezed, dense = re.sub(r"\s+", " ", text).strip(), re.sub(r"\s+", "", text)
    if len(squeezed) >= 8:
        prose = len(PROSE_WORD.findall(squeezed))
        visible = [(len(re.sub(r"\s+", "", r["text"] or "")), r["style"] == "math") for r in runs]
        share = sum(n for n, math in visible if math) / max(1, sum(n for n, _ in visible))
        if (share >= 0.6 and prose < 2) or (prose == 0 and len(MATH_SIGN.findall(dense)) >= 2 and len(dense) >= 12):
            out.append(("formula_only", ""))
    return out


def source_issues(units: DataFrame, visuals: DataFrame) -> DataFrame:
    """Issues (doc_id, id, code, detail) of extracted units that a reader must decide.

    units: doc_id, id, page, page_order, kind, source_text, translatable, suppressed, size, x0, y0, x1, y1, runs (array of struct text, style, size, flags, font, line), fragments (array of struct start, end,
    kind, size: of its largest run), flow_role, flow_error, flow_review; visuals: doc_id, page, visual, caption_id, source_ids, x0, y0, x1, y1. Rules of a unit's own text and runs: headings that look like
    list items, flow, runs that can't be placed, formulas outside of fragments, scripts without a base, numbered displays and formulas as body text. Rules of neighbours: headings and
    equations whose centre lies in a visual that isn't theirs, short lower-case text after a caption.
    """
    active = units.filter(~F.col("suppressed"))
    sizes = active.filter((F.col("kind") == "body") & (F.col("size") > 0)).groupBy(F.col("doc_id").alias("_d")).agg(F.median("size").alias("body_size"))
    own = active.filter(F.col("kind").isin("body", "heading") & F.col("translatable")).join(sizes, F.col("doc_id") == F.col("_d"), "left")

    def run(parts):
        for part in parts:
            rows = [(u.doc_id, u.id, c, d) for u in part.itertuples() for c, d in _unit_issues(u, 0.0 if pd.isna(u.body_size) else u.body_size)]
            yield pd.DataFrame(rows, columns=["doc_id", "id", "code", "detail"])

    columns = ["doc_id", "id", "kind", "source_text", "size", "runs", "fragments", "flow_role", "flow_error", "flow_review", "body_size"]
    found = own.select(columns).mapInPandas(run, "doc_id long, id string, code string, detail string")
    v = visuals.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "visual", "caption_id", "source_ids", *[F.col(c).alias(f"v_{c}") for c in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = active.filter(F.col("kind").isin("heading", "equation")).join(v, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")))
    inside = inside.filter(x.between(F.col("v_x0"), F.col("v_x1")) & y.between(F.col("v_y0"), F.col("v_y1")) & ~F.col("id").eqNullSafe(F.col("caption_id")) & ~F.array_contains("source_ids", F.col("id")))
    before = F.lag("kind").over(Window.partitionBy("doc_id", "page").orderBy("page_order"))
    text = F.trim("source_text")
    tail = units.withColumn("_before", before).filter((F.col("_before") == "caption") & (F.col("kind") == "body") & ~F.col("suppressed") & (F.length(text) <= CAPTION_TAIL) & text.rlike("^[a-z(]"))
    return found.unionByName(inside.select("doc_id", "id", F.lit("label_in_visual").alias("code"), F.col("visual").alias("detail"))).unionByName(tail.select("doc_id", "id", F.lit("caption_tail").alias("code"), F.lit("").alias("detail")))
