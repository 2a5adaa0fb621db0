"""Weather and building expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import at_least, clip, ratio

# Magnus coefficients of the saturation vapour pressure.
MAGNUS_A = 17.625
MAGNUS_B = 243.04


def _saturation(t: Column) -> Column:
    return F.exp(ratio(F.lit(MAGNUS_A) * t, F.lit(MAGNUS_B) + t))


def relative_humidity(air: Column, dew: Column) -> Column:
    """Percent, from air temperature and dew point in Celsius."""
    return clip(F.lit(100.0) * ratio(_saturation(dew), _saturation(air)), F.lit(0.0), F.lit(100.0))


def apparent_temperature(air: Column, humidity: Column, wind: Column) -> Column:
    """Steadman's shade formula with wind: Celsius, percent, metres per second."""
    vapour = humidity / 100.0 * 6.105 * F.exp(ratio(F.lit(17.27) * air, F.lit(237.7) + air))
    return air + vapour * 0.33 - wind * 0.7 - 4.0


def to_fahrenheit(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32.0


def building_age(year_built: Column, reference_year: int) -> Column:
    """Age in a stated year, so that results do not drift with the clock."""
    return at_least(F.lit(reference_year) - year_built, F.lit(0))


def log_area(square_feet: Column) -> Column:
    return F.log1p(square_feet)


def tidy_category(text: Column) -> Column:
    """Lower case without any leading or trailing white space."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def area_per_floor(square_feet: Column, floors: Column) -> Column:
    """An unknown floor count counts as one floor; zero floors give NULL."""
    return ratio(square_feet, F.coalesce(floors, F.lit(1.0)))


def parse_building_id(building_id: Column) -> dict[str, Column]:
    """Site, use type and name from Site_Use_Name; ids with fewer parts are unknown."""
    parts = F.split(building_id, "_")
    known = F.size(parts) >= 3
    unknown = F.lit("unknown")
    return {
        "site": F.when(known, F.element_at(parts, 1)).otherwise(unknown),
        "use_type": F.when(known, F.try_element_at(parts, F.lit(2))).otherwise(unknown),
        "building_name": F.when(known, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")).otherwise(building_id),
    }
