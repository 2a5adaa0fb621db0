"""Null-safe column helpers. The engine has NULL for a missing value, never NaN."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN compares greater than everything in Spark, so it is turned into NULL on the way in."""
    chosen = set(df.columns if columns is None else columns)
    floats = {
        f.name
        for f in df.schema.fields
        if f.name in chosen and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    present = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}
    return df.withColumns(present) if floats else df


def at_least(column: Column, low) -> Column:
    """Clip from below; NULL stays NULL (greatest() would return the bound)."""
    return F.when(column < low, low).otherwise(column)


def clip(column: Column, low, high) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    return F.when(column < low, low).when(column > high, high).otherwise(column)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero divisor."""
    return F.try_divide(top, bottom)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def share(condition: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return F.count_if(condition) / F.count(F.lit(1)) * 100.0


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; NULL without spread, where corr() fails in ANSI mode."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def ntz_literal(value) -> Column:
    """A zone-free timestamp literal; passed as text, since a Python datetime would be read in the driver's time zone."""
    return F.lit(None if value is None else str(value)).cast("timestamp_ntz")
