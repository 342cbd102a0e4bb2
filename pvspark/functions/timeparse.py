"""Text to naive timestamps, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The time formats of the input files.
DAY_FIRST = "dd-MM-yyyy HH:mm"
ISO = "yyyy-MM-dd HH:mm:ss"


def parse_time(text: Column | str, fmt: str) -> Column:
    """Timestamp without zone; text of another shape becomes null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_by_plant(text: Column | str, plant: Column | str, day_first_plants: tuple[int, ...] = (1,)) -> Column:
    """Generation files of some plants put the day first; all others are ISO."""
    plant = F.col(plant) if isinstance(plant, str) else plant
    return F.when(plant.isin(*day_first_plants), parse_time(text, DAY_FIRST)).otherwise(parse_time(text, ISO))


def require_times(df: DataFrame, time: str, what: str) -> DataFrame:
    """Fail the job at the first row whose time could not be read."""
    ok = F.assert_true(F.col(time).isNotNull(), F.concat(F.lit(f"unreadable {time} in "), F.lit(what)))
    return df.withColumn(time, F.when(ok.isNull(), F.col(time)))


def date_text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd")
