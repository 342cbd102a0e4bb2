"""Join generation with its weather and fill the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import series as S
from pvspark.operators.fill import fill_linear
from pvspark.operators.small import checked_small, join_side

# Column names of the input tables.
SENSOR_COLS = ["ambient_temperature", "module_temperature", "irradiation"]
WEATHER_META = ["plant_no", "latitude", "longitude", "open_meteo_timezone", "open_meteo_utc_offset_seconds"]

PLANT, SOURCE, TIME = "plant_id", "source_key", "date_time"


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns which exist, in the wanted order."""
    have = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() in have]


def drop_bad_times(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.dropna(subset=[time])


def join_weather(
    generation: DataFrame, sensor: DataFrame, weather: DataFrame | None = None, plant: str = PLANT, time: str = TIME
) -> DataFrame:
    """generation ⟕ ground sensor ⟕ macro weather on (plant, instant).

    The weather side is broadcast only when it is checked to be small. Otherwise the join shuffles, and a
    crowded plant-instant is split on the generation side by adaptive execution.
    """
    out = join_side(drop_bad_times(generation, time), sensor.select(plant, time, *SENSOR_COLS), [plant, time])
    if weather is not None:
        out = join_side(out, weather.drop(*WEATHER_META), [plant, time])
    return out


def _fill_side(
    instants: DataFrame, side: DataFrame, plant: str, time: str, cols: list[str], max_rows: int | None
) -> tuple[DataFrame, int | None]:
    """The side table with a filled row at every instant where generation has rows, and its size if counted."""
    known = side.select(plant, time, *cols).filter(F.col(time).isNotNull())
    missing = instants.join(known.select(plant, time), [plant, time], "left_anti")
    both, n = checked_small(known.unionByName(missing, allowMissingColumns=True))
    return fill_linear(both, [plant], [time], cols, "time", max_rows, n), n


def clean(
    generation: DataFrame, sensor: DataFrame, weather: DataFrame | None = None, fill: str = "time",
    plant: str = PLANT, source: str = SOURCE, time: str = TIME, max_rows: int | None = None,
) -> DataFrame:
    """Cleaned table: generation with sensor and macro weather at every instant.

    fill="time" interpolates each plant's weather series by the clock before the join, so all devices see
    the same weather at an instant. fill="row" interpolates over the joined rows in (time, device) order,
    the way a positional fill of the joined table does.
    """
    generation = drop_bad_times(generation, time)
    if fill == "time":
        instants, _ = checked_small(generation.select(plant, time).distinct())
        out = generation
        for side, cols in ((sensor, SENSOR_COLS), (weather, [] if weather is None else columns_with_prefix(weather, "om_"))):
            if side is not None:
                filled, n = _fill_side(instants, side, plant, time, cols, max_rows)
                out = join_side(out, filled, [plant, time], rows=n)
        return out
    if fill == "row":
        joined = join_weather(generation, sensor, weather, plant, time)
        cols = SENSOR_COLS + columns_with_prefix(joined, "om_")
        return fill_linear(joined, [plant], [time, source], cols, "row", max_rows)
    raise ValueError(f"unknown fill {fill!r}: time or row")
