"""Series fitted in Arrow batches; their sums are native columns (``functions.series``)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..functions import series


def fitted(f: Callable, *params: Column, sines: bool = False) -> Column:
    """Coefficients of the period's series, or with ``sines`` of the series of sines, of f(s, *params), a NumPy function; an array with NaN alone where a parameter is null.

    Fit distinct parameters and join the result where rows share them.
    """
    fit = series.fit_sines if sines else series.fit_period

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(fit(f, *(c.to_numpy(dtype="float64", na_value=float("nan")) for c in columns)), dtype=object)

    return pandas_udf(run, "array<double>")(*params)


def period_inverse(c: Column, y: Column) -> Column:
    """s at which the integral of a positive function, fitted with a period, is y; null where there is none."""

    def run(c: pd.Series, y: pd.Series) -> pd.Series:
        rows = [[float("nan")] if x is None else x for x in c]
        return pd.Series(series.inverse_integral(rows, y.to_numpy(dtype="float64", na_value=float("nan"))))

    return pandas_udf(run, "double")(c, y)
