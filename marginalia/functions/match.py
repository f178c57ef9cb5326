"""String similarity and Unicode folding that Spark has no built-in for (Arrow batches)."""

from __future__ import annotations

from difflib import SequenceMatcher
from unicodedata import normalize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: normalize("NFKC", v or ""))
