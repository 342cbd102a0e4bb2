"""Display names and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(name: Column) -> Column:
    """om_temperature_2m → Temperature 2M: a letter is large wherever none stands before it."""
    spaced = F.replace(F.replace(F.upper(name), F.lit("OM_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.array_join(F.transform(F.split(spaced, "(?<=[^A-Z])(?=[A-Z])"), F.initcap), "")


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def decimals(value: Column, digits: int, suffix: str = "") -> Column:
    return F.format_string(f"%.{digits}f" + suffix.replace("%", "%%"), value)
