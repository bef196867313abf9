"""Matching-block ratio of two texts as a vectorised function."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [1.0 if a == b else SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)],
        dtype="float64",
    )


def block_ratio(left: Column, right: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(left, right)
