"""Row-wise solar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds the results depend on.
DAY_IRRADIATION = 1e-4
SUNNY_IRRADIATION = 0.1
DAYLIGHT_POWER = 0.5
STEPS_PER_HOUR = 4
PEAK_HOURS = (10, 15)
DAYS_PER_YEAR = 365.25


def above(value: str, threshold: float) -> Column:
    """Whether a reading is above the threshold; a missing one is not, and neither is NaN, which Spark holds to be the largest number."""
    return F.coalesce((F.col(value) > threshold) & ~F.isnan(value), F.lit(False))


def is_day(irradiation: str = "irradiation", threshold: float = DAY_IRRADIATION) -> Column:
    """1 above the threshold, 0 below it or when the reading is missing."""
    return above(irradiation, threshold).cast("int")


def temp_diff(module: str = "module_temperature", ambient: str = "ambient_temperature") -> Column:
    return F.col(module) - F.col(ambient)


def calendar(time: str) -> dict[str, Column]:
    return {"hour": F.hour(time), "minute": F.minute(time), "day_of_year": F.dayofyear(time)}


def cyclic(time: str) -> dict[str, Column]:
    """Hour of day (whole hours) and day of year as points on a circle."""
    day = 2 * math.pi * F.hour(time) / 24.0
    year = 2 * math.pi * F.dayofyear(time) / DAYS_PER_YEAR
    return {
        "hour_sin": F.sin(day), "hour_cos": F.cos(day),
        "day_of_year_sin": F.sin(year), "day_of_year_cos": F.cos(year),
    }


def at_night_zero(value: str, day_flag: str = "is_day") -> Column:
    return F.when(F.col(day_flag) == 0, F.lit(0.0)).otherwise(F.col(value))


def limited(prediction: str, day_flag: str | None = "is_day") -> Column:
    """No output at night, never below zero."""
    p = F.col(prediction) if day_flag is None else at_night_zero(prediction, day_flag)
    return F.when(p < 0, F.lit(0.0)).otherwise(p)


def energy_mwh(power_sum_kw: Column) -> Column:
    return power_sum_kw / float(STEPS_PER_HOUR) / 1000.0
