"""Reversible protection of literals, inline notation and emphasis by tokens. Python on Arrow batches, never rows."""

from __future__ import annotations

import re
from bisect import bisect_right
from statistics import median

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from quire.operators.folds import align

#: Literals that stay as they are, in order of priority (fixed values).
LITERALS = re.compile(
    r"https?://[^\s)\]}>,;]+"
    r"|(?:doi\s*:\s*)?10\.\d{4,9}/[^\s)\]}>,;]+"
    r"|(?:arXiv\s*:?\s*)?\d{4}\.\d{4,5}(?:v\d+)?"
    r"|\[[^\[\]\n]{1,180}\]"
    r"|\((?=[^()\n]{0,180}(?:19|20)\d{2})[^()\n]{1,180}\)"
    r"|\$[^$\n]+\$"
    r"|(?<![\w.])[-+]?\d+(?:[.,]\d+)*(?:\s*(?:%|ms|s|min|h|Hz|"
    r"kHz|MHz|GHz|B|KB|MB|GB|TB|m|cm|mm|km|kg|g|mg|USD|USDC|"
    r"bps|bp|dB|°C|K))?(?![A-Za-z])"
)
#: Bracketed citations, fonts of code and of mathematics, list marks, what may stand between the runs of one formula (fixed values).
CITATION = re.compile(r"\[(?:\d{1,4}(?:\s*[-–,]\s*\d{1,4})*|[A-Za-z]{2,}\+?\d{2,4}[a-z]?(?:\s*,\s*[A-Za-z]{2,}\+?\d{2,4}[a-z]?)*)\]")
CODE_FONT = re.compile(r"CONSOLAS|COURIER|MONO|CMTT|LMTT|MENLO|INCONSOLATA|SOURCECODE", re.I)
MATH_FONT = re.compile(r"(?:^|[-+])(CMMI|CMSY|CMEX|MSAM|MSBM)|MATH|SYMBOL", re.I)
FORMULA_GAP = re.compile(r"[\s,.;:(){}\[\]=+\-*/^]*")
_LIST_MARK = re.compile(r"[•·▪●◦‣⁃–—\-]")
#: Letters by size against the unit's: up to this share a script; characters in italics from which a unit is italic as a whole (fixed values).
SCRIPT_SIZE, WHOLE_ITALIC = 0.82, 0.55


def _is_prose(literal: str) -> bool:
    """Brackets around several words, or parentheses that begin in lower case: what they hold is searched instead."""
    if literal[0] == "[":
        return len(re.findall(r"[A-Za-z][A-Za-z'-]*", literal)) > 1 and not CITATION.fullmatch(literal)
    return literal[0] == "(" and re.match(r"\(\s*[a-z]", literal) is not None


def literals(text: str, at: int = 0) -> list[tuple[int, int]]:
    """Bounds of the literals of a text in order, counted from at."""
    out: list[tuple[int, int]] = []
    for m in LITERALS.finditer(text):
        if _is_prose(m.group()):
            out += literals(m.group()[1:-1], at + m.start() + 1)
        else:
            out.append((at + m.start(), at + m.end()))
    return out


def protect(text: str, found: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The text with its literals as [[P0001]], ..., and the literals by token; found is gone on with."""
    found = {} if found is None else found
    out, last = [], 0
    for a, b in literals(text):
        token = f"[[P{len(found) + 1:04d}]]"
        found[token] = text[a:b]
        out += [text[last:a], token]
        last = b
    return "".join(out) + text[last:], found


def _is_code(run: dict) -> bool:
    font = run.get("font") or ""
    return run.get("style") != "math" and not MATH_FONT.search(font) and bool((run.get("flags") or 0) & 8 or CODE_FONT.search(font))


def _fragments(text: str, runs: list[dict], marker: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of list marker, code, citations, formulas and footnote markers; of overlapping ones the first, then the longer."""
    found: list[tuple[int, int, str]] = []
    lead = len(text) - len(text.lstrip())
    if marker and text.startswith(marker, lead):
        found.append((lead, lead + len(marker), "list-marker"))
    code: list[dict] = []
    for run in filter(_is_code, runs):
        joins = code and code[-1]["end"] == run["start"] and run.get("style") == code[-1].get("style") == "text" and run.get("line") == code[-1].get("line")
        if joins:
            code[-1] = {**run, "start": code[-1]["start"]}
        else:
            code.append(run)
    found += [(r["start"], r["end"], "code") for r in code]
    taken = lambda a, b: any(a < y and b > x for x, y, _ in found)
    for m in CITATION.finditer(text):
        interval = re.search(r"[∈∉→↦]\s*$", text[: m.start()])
        if not interval and not taken(m.start(), m.end()):
            found.append((m.start(), m.end(), "citation"))
    sizes = [r["size"] for r in runs if r.get("size")]
    body = median(sizes) if sizes else 0.0
    small = lambda r: body > 0 and (r.get("size") or 0.0) <= body * SCRIPT_SIZE
    groups: list[list[dict]] = []
    for run in runs:
        said = text[run["start"] : run["end"]]
        listed = _LIST_MARK.fullmatch(said.strip()) and not text[: run["start"]].rpartition("\n")[2].strip()
        if _is_code(run) or listed or not (run.get("style") == "math" or (small(run) and re.fullmatch(r"[\wΑ-ω]+", said))):
            continue
        last = groups[-1][-1] if groups else None
        gap = text[last["end"] : run["start"]] if last and run["start"] >= last["end"] else None
        if gap is not None and last.get("line") == run.get("line") and len(gap) <= 4 and FORMULA_GAP.fullmatch(gap):
            groups[-1].append(run)
        else:
            groups.append([run])
    for group in groups:
        a, b = group[0]["start"], group[-1]["end"]
        said = text[a:b].strip()
        single = re.fullmatch(r"[A-Za-zΑ-ω][,.;:]?", said) and not (said == "q" and text[b : b + 1] in ("-", "("))
        if single or taken(a, b):
            continue
        note = re.fullmatch(r"\d+|[⋆*†‡]", said) and all(map(small, group)) and any((r.get("flags") or 0) & 1 for r in group)
        found.append((a, b, "footnote-marker" if note else "math"))
    kept: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _emphasis(text: str, runs: list[dict], fragments: list[tuple[int, int, str]]) -> list[list]:
    """[start, end, kind] of bold and italic stretches outside of formulas; those parted by white space alone are one."""
    out: list[list] = []
    for r in runs:
        kind, a, b = r.get("style"), r["start"], r["end"]
        if kind not in ("bold", "italic") or any(k == "math" and a < y and b > x for x, y, k in fragments):
            continue
        if out and out[-1][2] == kind and a >= out[-1][1] and text[out[-1][1] : a].isspace():
            out[-1][1] = b
        else:
            out.append([a, b, kind])
    return out


def protect_rich(unit_id: str, text: str, runs: list[dict], marker: str = "") -> dict:
    """A unit with fragments, emphasis and literals as tokens.

    runs: text, style (text, bold, italic, math), size, flags, font, line, in the order of the text. Returns text, literals
    and fragments by token, styles by key, block (italic where at least 55 percent of the prose characters are; then italic tokens are left out). Fragment
    and style tokens carry the unit's id.
    """
    places = align(text, [r.get("text") or "" for r in runs], [r.get("line") for r in runs])
    runs = [{**r, "start": a, "end": b} for r, (a, b, status) in zip(runs, places) if a is not None]
    fragments = _fragments(text, runs, marker)
    styles = _emphasis(text, runs, fragments)
    prose = [r for r in runs if r.get("style") in ("text", "bold", "italic") and re.search("[A-Za-z]", r.get("text") or "")]
    chars = sum(len(r["text"]) for r in prose)
    italic = chars > 0 and sum(len(r["text"]) for r in prose if r["style"] == "italic") >= WHOLE_ITALIC * chars
    styles = [s for s in styles if not (italic and s[2] == "italic")]
    space = re.sub("[^A-Za-z0-9]", "", unit_id) or "unit"
    found: dict[str, str] = {}
    named = {f"[[F{space}_{k:04d}]]": f for k, f in enumerate(fragments, 1)}
    keys = {f"{'B' if s[2] == 'bold' else 'I'}{space}_{k:04d}": s for k, s in enumerate(styles, 1)}
    # what is put in at a place: closings first, the last opened first, then openings, then the fragment that begins there
    marks: dict[int, list[str]] = {}
    for key, (_, b, _) in reversed(keys.items()):
        marks.setdefault(b, []).append(f"[[{key}_CLOSE]]")
    for key, (a, _, _) in keys.items():
        marks.setdefault(a, []).append(f"[[{key}_OPEN]]")
    starts = {f[0]: (token, f[1]) for token, f in named.items()}
    stops = sorted({*marks, *starts, len(text)})
    out, at = [], 0
    while True:
        out += marks.get(at, [])
        if at in starts:
            token, at = starts[at]
            out.append(token)
            continue
        if at >= len(text):
            break
        to = stops[bisect_right(stops, at)]
        out.append(protect(text[at:to], found)[0])
        at = to
    return {
        "text": "".join(out), "literals": found, "fragments": {t: text[a:b] for t, (a, b, _) in named.items()}, "kinds": {t: k for t, (_, _, k) in named.items()},
        "styles": {k: s[2] for k, s in keys.items()}, "block": "italic" if italic else "normal",
    }


_MAP = MapType(StringType(), StringType())


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("originals", _MAP)]))
def protect_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [protect(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "originals": [r[1] for r in rows]})


_RICH = StructType([StructField("text", StringType()), *(StructField(x, _MAP) for x in ("literals", "fragments", "kinds", "styles")), StructField("block", StringType())])


@F.pandas_udf(_RICH)
def protect_rich_udf(ids: pd.Series, texts: pd.Series, runs: pd.Series, markers: pd.Series) -> pd.DataFrame:
    """protect_rich() of columns; runs: array of struct(text, style, size, flags, font, line)."""
    rows = [protect_rich(i or "", t or "", [r if isinstance(r, dict) else r.asDict() for r in (rs if rs is not None else [])], m or "") for i, t, rs, m in zip(ids, texts, runs, markers)]
    return pd.DataFrame(rows, columns=_RICH.names)
