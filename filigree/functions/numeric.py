"""Numbers: rounding as Python does it, means that skip NaN, stable zeros."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(c: Column, digits: int) -> Column:
    """Python's correctly rounded, half-to-even round of the binary value (Arrow batches)."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if pd.isna(v) else round(float(v), digits)).astype("float64")

    return rounded(c.cast("double"))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for comparing engines; -0.0 becomes 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def nan_mean(c: Column) -> Column:
    """Mean of what is not NaN; NaN when nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(c), c)), F.lit(float("nan")))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty))
