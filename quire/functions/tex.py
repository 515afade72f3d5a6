"""TeX of plain text and of formulas read from pages. Tables of letters come from their Unicode names; Arrow batches, never rows."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that TeX reads as commands, and relations and operators by their commands (fixed values).
SPECIALS = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&", "_": r"\_", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"}
SIGNS = {
    "∈": r"\in", "∉": r"\notin", "∅": r"\varnothing", "∪": r"\cup", "∏": r"\prod", "∑": r"\sum", "∥": r"\parallel", "≈": r"\approx", "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "⊂": r"\subset", "⊆": r"\subseteq", "⊥": r"\bot",
    "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "↦": r"\mapsto", "↪": r"\hookrightarrow", "−": "-", "×": r"\times", "′": r"\prime", "□": r"\square", "⊙": r"\odot", "⌈": r"\lceil", "⌉": r"\rceil", "ℓ": r"\ell",
}
#: Letters whose command isn't their name: variants, and letters that look like Latin ones (fixed values).
VARIANTS = {"ϵ": r"\varepsilon", "ϑ": r"\vartheta", "ϖ": r"\varpi", "ϱ": r"\varrho", "ς": r"\varsigma", "ϕ": r"\varphi", "µ": r"\mu", "ℓ": r"\ell"}
LATIN_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΧ", "ABEZHIKMNOPTX"))


def _greek() -> dict[str, str]:
    """Command of each Greek letter that has one, by its Unicode name."""
    out = {}
    for c in map(chr, [*range(0x391, 0x3AA), *range(0x3B1, 0x3CA)]):
        case, _, name = unicodedata.name(c, "").removeprefix("GREEK ").partition(" LETTER ")
        if name and " " not in name and c not in LATIN_LIKE:
            name = {"LAMDA": "LAMBDA"}.get(name, name)
            out[c] = "\\" + (name.capitalize() if case == "CAPITAL" else name.lower())
    return out


GREEK = _greek()
#: Letters and digits above the line stand for those below it.
_RAISED = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xB2, 0xBA), *range(0x2B0, 0x2B9), 0x2E1, 0x2E2, 0x2E3, *range(0x1D2C, 0x1D6B), *range(0x2070, 0x2080)]) if unicodedata.decomposition(c).startswith("<super>")}
_TEXT = str.maketrans(
    SPECIALS | {c: rf"\({t}\)" for c, t in (SIGNS | GREEK | {"ο": "o", "ϕ": r"\phi", "д": "g"}).items() if c != "Υ"} | {"д": "g"} | {c: rf"\textsuperscript{{{b}}}" for c, b in _RAISED.items() if re.fullmatch(r"[A-Za-z0-9+]", b)} | {"⁻": r"\textsuperscript{-}"}
)
_MATH = str.maketrans(LATIN_LIKE | {c: t + " " for c, t in (GREEK | VARIANTS).items()})
#: How often scripts that follow each other are joined (fixed value).
JOINED_SCRIPTS = 8


def escaped(text: str) -> str:
    """Plain text as TeX: commands of special characters, Greek letters and signs as formulas, raised letters as superscripts."""
    return text.translate(_TEXT)


def normal_math(tex: str) -> str:
    """A formula read glyph by glyph: Greek letters as commands, scripts that follow each other joined, hats put over their letter, blanks squeezed."""
    tex = tex.translate(_MATH)
    for _ in range(JOINED_SCRIPTS):
        joined = re.sub(r"([\^_])\{([^{}]*)\}\s*\1\{([^{}]*)\}", r"\1{\2\3}", tex)
        if joined == tex:
            break
        tex = joined
    tex = re.sub(r"\\widehatmark\{\}\s*([A-Za-zΑ-ω])", r"\\hat{\1}", tex)
    tex = re.sub(r"([A-Za-zΑ-ω])\s*\\widehatmark\{\}", r"\\hat{\1}", tex)
    return re.sub(r"[ \t]+", " ", re.sub(r"(\\[A-Za-z]+) (?=[}\]])", r"\1", tex)).strip()


def percent_safe(tex: str) -> str:
    """Percent signs that no backslash escapes, escaped, so that they begin no comment."""
    return re.sub(r"(?<!\\)((?:\\\\)*)%", r"\1\\%", tex)


@F.pandas_udf(StringType())
def escaped_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else escaped(t))


@F.pandas_udf(StringType())
def normal_math_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else percent_safe(normal_math(t)))
