"""Table functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.units import PAGE_UNITS

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.udtf(returnType="ord int, page int, kind string, source_text string, words long", useArrow=True)
class UnitsFromText:
    """The lines of a text as units: ord from 1, page, kind, text, words. Null has none."""

    def eval(self, text: str):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            kind = "heading" if k == 0 else "table" if "|" in line else "caption" if len(line) < 40 else "body"
            yield k + 1, k // PAGE_UNITS + 1, kind, line, len(_WORD.findall(line))


def units_from_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a row for each unit of a text, by a lateral join with the table function."""
    return docs.lateralJoin(UnitsFromText(F.col(text).outer()))
