"""Calendar columns from a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYCLES = {"hour": 24, "dayofweek": 7, "month": 12}


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Model features; dayofweek counts from Monday = 0."""
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "dayofweek": F.weekday(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "dayofyear": F.dayofyear(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def cyclic_columns(parts: dict[str, Column]) -> dict[str, Column]:
    """A sine and cosine per periodic part, so that the end of a cycle is next to its start."""
    out = {}
    for name, period in CYCLES.items():
        angle = parts[name] * F.lit(2.0 * math.pi) / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def add_calendar_features(df: DataFrame, timestamp_col: str = "timestamp") -> DataFrame:
    parts = calendar_columns(F.col(timestamp_col))
    return df.withColumns({**parts, **cyclic_columns(parts)})


def profile_columns(ts: Column) -> dict[str, Column]:
    """Calendar columns of the exploratory reports."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
        "is_weekend": F.weekday(ts) >= 5,
        "is_month_start": F.dayofmonth(ts) == 1,
        "is_month_end": F.to_date(ts) == F.last_day(F.to_date(ts)),
    }


def add_profile_calendar(df: DataFrame, timestamp_col: str = "timestamp") -> DataFrame:
    return df.withColumns(profile_columns(F.col(timestamp_col)))


def season(month: Column) -> Column:
    """Meteorological season of the northern hemisphere."""
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )


def is_us_holiday(ts: Column) -> Column:
    """US federal holidays on their calendar day: fixed dates, and n-th weekdays of a month."""
    month, day, dow, year = F.month(ts), F.dayofmonth(ts), F.weekday(ts), F.year(ts)
    # The federal holiday rules.
    fixed = ((month == 1) & (day == 1)) | ((month == 7) & (day == 4)) | ((month == 11) & (day == 11))
    fixed = fixed | ((month == 12) & (day == 25)) | ((month == 6) & (day == 19) & (year >= 2021))
    king = (month == 1) & (dow == 0) & day.between(15, 21)
    presidents = (month == 2) & (dow == 0) & day.between(15, 21)
    memorial = (month == 5) & (dow == 0) & (day >= 25)
    labor = (month == 9) & (dow == 0) & (day <= 7)
    columbus = (month == 10) & (dow == 0) & day.between(8, 14)
    thanksgiving = (month == 11) & (dow == 3) & day.between(22, 28)
    return fixed | king | presidents | memorial | labor | columbus | thanksgiving


def add_extended_calendar(df: DataFrame, timestamp_col: str = "timestamp") -> DataFrame:
    """Quarter, season and holiday flag."""
    ts = F.col(timestamp_col)
    return df.withColumns(
        {
            "quarter": F.quarter(ts),
            "season": season(F.month(ts)),
            "is_holiday": is_us_holiday(ts).cast("int"),
        }
    )
