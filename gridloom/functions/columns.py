"""Column checks and keys that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def require(df: DataFrame, *names: str) -> None:
    """Raises ValueError for names that df lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN becomes null in the named columns, or in all float columns."""
    kinds = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    use = names or tuple(kinds)
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in use if n in kinds})


def month_index(time: Column, base_year: int) -> Column:
    """Months since January of base_year, for timestamps."""
    return ((F.year(time) - base_year) * 12 + F.month(time) - 1).cast("int")


def month_of(t: str | Column) -> Column:
    """Month 0-11 of a month index."""
    return F.pmod(F.col(t) if isinstance(t, str) else t, F.lit(12))


def with_step(df: DataFrame, time_col: str, out: str = "t_idx") -> DataFrame:
    """Adds the position of each time among the distinct times. The distinct times of a model run are few (thousands), so
    ordering them in one task is cheap; the join back is left to Spark, which broadcasts them when they are small."""
    require(df, time_col)
    times = df.select(time_col).distinct()
    numbered = times.withColumn(out, (F.row_number().over(Window.orderBy(time_col)) - 1).cast("int"))
    return df.join(numbered, time_col)
