"""Scalar text functions as column expressions. Patterns with (?U) see Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han code points (fixed values).
HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
#: Visual kinds by their name; other names are figures (fixed values).
LABEL_KINDS = {"table": "table", "表": "table", "algorithm": "algorithm", "算法": "algorithm", "listing": "listing"}


def words(c: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def normal_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_lines(c: Column) -> Column:
    """Strip lines and drop empty ones, rejoin hyphenated words, join lines that don't end a sentence, squeeze blanks."""
    c = F.regexp_replace(c, r"(?U)[ \t]*\n\s*", "\n")
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])-\n(?=[a-z])", "")
    c = F.regexp_replace(c, r"(?<![.!?:;])\n(?=\S)", " ")
    return F.regexp_replace(c, r"[ \t]+", " ")


def normal_body(c: Column) -> Column:
    """Paragraph text in one line: emphasis that opens a line begins a paragraph, hyphenated words rejoined, line ends between Han characters dropped, others blanks."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"\s*\n+\s*(?=\[\[[BI][A-Za-z0-9_]*_OPEN\]\])", "[[PAR]]")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])-\s*\n+\s*(?=[a-z])", "")
    c = F.regexp_replace(c, "(?<=" + HAN + ")\\s*\\n+\\s*(?=" + HAN + "|[\\d，。；：！？、）])", "")
    c = F.regexp_replace(c, "(?<=\\d)\\s*\\n+\\s*(?=" + HAN + ")", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*\n+\s*", " "), r"[ \t]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def compare_key(c: Column) -> Column:
    """Text without soft hyphens, hyphenation and white space, in lower case."""
    c = F.replace(c, F.lit("\u00ad"), F.lit(""))
    c = F.regexp_replace(c, r"(?U)(?<=[A-Za-z])-\s+(?=[a-z])", "")
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def running_key(c: Column) -> Column:
    """Lower case with runs of other than word characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def heading_level(c: Column) -> Column:
    """Dots in the leading section number and one; 1 without a number."""
    number = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."))) + 1).otherwise(1)


def numbered_heading(c: Column, space: str = r"(?U)\s+") -> Column:
    """Section number and title parted by an ideographic space; space is the pattern of what is squeezed to one blank."""
    c = F.regexp_replace(F.regexp_replace(c, space, " "), r"^ | \z", "")
    return F.regexp_replace(c, r"(?s)^(\d+(?:\.\d+)*)[.)]?[ \u00a0\u3000]+(.+)\z", "$1　$2")


def join_continuation(left: Column, right: Column) -> Column:
    """Join two parts of a paragraph: a hyphen closes up, Han text needs no blank."""
    a, b = F.rtrim(left), F.ltrim(right)
    han = a.rlike(HAN + "$") & b.rlike("^(?:" + HAN + "|\\d|[，。；：！？、）])")
    hyphen = a.endswith("-") & b.rlike("^[a-z]")
    return F.when(a == "", b).when(b == "", a).when(hyphen, F.concat(F.regexp_replace(a, "-$", ""), b)).when(han, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def doi(c: Column) -> Column:
    """The DOI in a string, lower case, without prefix and trailing marks; null if there is none."""
    c = F.regexp_replace(normal_space(c), r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)", "")
    c = F.regexp_replace(F.trim(c), r"[.,;)]+$", "")
    found = F.regexp_extract(c, r"(10\.\d{4,9}/\S+)", 1)
    return F.when(found != "", F.lower(found))


def arxiv(c: Column) -> Column:
    """The arXiv id in a string without version; null if there is none."""
    c = F.regexp_replace(normal_space(c), r"(?i)^(?:arxiv:\s*|https?://arxiv\.org/(?:abs|pdf)/)", "")
    c = F.regexp_replace(c, r"(?i)\.pdf$", "")
    found = F.regexp_extract(c, r"(?i)((?:[a-z-]+(?:\.[a-z-]+)?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?)", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"(?i)v\d+$", "")))


def year(c: Column) -> Column:
    found = F.regexp_extract(c, r"\b((?:18|19|20|21)\d{2})\b", 1)
    return F.when(found != "", found)


def label(c: Column) -> tuple[Column, Column]:
    """(kind, label) of the first figure, table, algorithm or listing named: table or figure, and such as figure-A7.1; nulls if none is."""
    pattern = r"(?i)(\bfigure|\bfig\.?|\btable|\balgorithm|\blisting|图|表|算法)\s*([A-Z]?\d+(?:[.\-]\d+)*)"
    said, number = F.lower(F.regexp_extract(c, pattern, 1)), F.upper(F.regexp_extract(c, pattern, 2))
    names = F.create_map(*[x for k, v in LABEL_KINDS.items() for x in (F.lit(k), F.lit(v))])
    name = F.coalesce(F.element_at(names, said), F.lit("figure"))
    return F.when(number != "", F.when(name == "table", "table").otherwise("figure")), F.when(number != "", F.concat_ws("-", name, number))


def tokens(c: Column) -> Column:
    """Protection tokens in order."""
    return F.regexp_extract_all(c, F.lit(r"(\[\[[A-Za-z0-9_]+\]\])"), F.lit(1))


def restored(c: Column, originals: Column, fragments: Column | None = None, styles: Column | None = None) -> Column:
    """Put originals (map token -> text) back; null unless every token stands once.

    fragments (tokens) must stand once and stay; each key of styles must open once and then close once.
    """
    count = lambda k: (F.length(c) - F.length(F.replace(c, k, F.lit("")))) / F.length(k)
    ok = F.forall(F.map_keys(originals), lambda k: count(k) == 1)
    text = F.aggregate(F.map_entries(originals), c, lambda a, e: F.replace(a, e["key"], e["value"]))
    ok = ok & (F.size(F.regexp_extract_all(text, F.lit(r"(\[\[P\d{4}\]\])"), F.lit(1))) == 0)
    if fragments is not None:
        ok = ok & F.forall(fragments, lambda k: count(k) == 1)
    if styles is not None:
        token = lambda k, end: F.concat(F.lit("[["), k, F.lit(f"_{end}]]"))
        ok = ok & F.forall(styles, lambda k: (count(token(k, "OPEN")) == 1) & (count(token(k, "CLOSE")) == 1) & (F.instr(c, token(k, "OPEN")) < F.instr(c, token(k, "CLOSE"))))
    return F.when(ok, text)


def balanced(c: Column, opening: str, closing: str) -> Column:
    """Brackets never close before they open, and end closed."""
    depth = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, x: F.struct((a["d"] + F.when(x == opening, 1).when(x == closing, -1).otherwise(0)).alias("d"), (a["ok"] & ~((x == closing) & (a["d"] == 0))).alias("ok")),
    )
    return (depth["d"] == 0) & depth["ok"]


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with keys in order; fields are text, integers or booleans."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def safe_path(c: Column) -> Column:
    """A relative path without parent steps, backslashes and colons."""
    return ~c.rlike(r"^/|\\|:|^$") & ~F.concat(F.lit("/"), c, F.lit("/")).contains("/../")


def redacted(c: Column, *secrets: str) -> Column:
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit("[redacted]"))
    return c


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def invariant_present(value: Column, output: Column) -> Column:
    """value stands in output, or two of three probes from its start, middle and end do. Both are compare keys; see compare_key()."""
    n = F.length(value)
    size = F.least(F.lit(64), F.greatest(F.lit(32), F.floor(n / 4))).cast("int")
    probes = [F.substring(value, F.lit(1), size), F.substring(value, (F.floor((n - size) / 2) + 1).cast("int"), size), F.substring(value, (n - size + 1).cast("int"), size)]
    hits = sum((F.contains(output, p).cast("int") for p in probes), F.lit(0))
    # probes of a value no longer than one are the value itself
    return F.contains(output, value) | ((n > size) & (hits >= 2))


#: Sections of a summary and the names they may have; characters it may have (fixed values).
SECTIONS = {
    "文献信息": ("文献信息", "书目信息", "论文信息"), "一句话结论": ("一句话结论", "一句话总结"), "研究问题": ("研究问题", "研究目标"),
    "方法与数据": ("方法与数据", "研究方法", "方法和数据"), "核心贡献": ("核心贡献", "主要贡献"), "主要结果": ("主要结果", "研究结果", "实验结果"),
    "局限": ("局限", "局限性", "研究局限"), "复现材料": ("复现材料", "可复现性", "复现信息"), "关键词": ("关键词", "关键术语"),
}
SUMMARY_CHARS = (800, 1500)


def summary_facts(markdown: Column) -> Column:
    """Characters and Han characters of a Markdown summary without marks and white space, its missing sections, and the errors: length, sections, language."""
    heads = F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*#{1,6}\s+(.+?)\s*$"), F.lit(1)), lambda h: F.lower(F.regexp_replace(h, r"(?U)[*_`：:]+|\s+", "")))
    missing = F.filter(
        F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, aliases)).alias("aliases")) for name, aliases in SECTIONS.items()]),
        lambda s: ~F.exists(heads, lambda h: F.exists(s["aliases"], lambda a: F.contains(h, a))),
    )
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(markdown, r"(?m)^\s*#{1,6}\s+", ""), r"[*_`>\[\]()\-]", ""), r"(?U)\s+", "")
    chars, han = F.length(body), F.length(F.regexp_replace(body, "[^" + HAN[1:], ""))
    low, high = SUMMARY_CHARS
    errors = F.filter(
        F.array(F.when(~chars.between(low, high), "length"), F.when(F.size(missing) > 0, "sections"), F.when(han < F.greatest(F.lit(100), F.floor(chars / 3)), "language")), lambda e: e.isNotNull()
    )
    return F.struct(chars.cast("long").alias("chars"), han.cast("long").alias("han"), F.array_join(F.transform(missing, lambda s: s["name"]), ",").alias("missing"), F.array_join(errors, ",").alias("errors"))
