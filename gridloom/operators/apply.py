"""A user's own functions over series and columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import Key, keys


def over_series(df: DataFrame, key: Key, t: str, v: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "value") -> DataFrame:
    """(key, t, out): fn of each key's whole series in order of time; it gives a value for each step. A series is one group,
    so it should have thousands of steps at most."""
    names = keys(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        return pdf[[*names, t]].assign(**{out: np.asarray(fn(pdf[v].to_numpy(float)), float)})

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in [*names, t])
    return df.select(*names, t, v).groupBy(*names).applyInPandas(run, f"{kinds}, {out} double")


def over_columns(df: DataFrame, names: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """fn of each named column, in one projection."""
    return df.withColumns({n: fn(F.col(n)) for n in names})
