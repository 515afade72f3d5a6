"""Text functions that need Python: Unicode normalisation, slugs. Arrow batches, never rows."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC, white space squeezed, case folded."""
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().casefold())


@F.pandas_udf(StringType())
def slug(texts: pd.Series) -> pd.Series:
    """ASCII letters and digits joined by hyphens, at most 80; 'paper' if nothing is left."""

    def one(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"[^A-Za-z0-9]+", "-", t).strip("-").lower()[:80] or "paper"

    return texts.map(one)
