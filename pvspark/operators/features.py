"""Model features of each device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.functions import physics
from pvspark.operators import series as S
from pvspark.operators.clean import PLANT, SOURCE, TIME
from pvspark.operators.fill import carry_between_series, fill_edges

# Lagged readings (new column, source column, rows back), window length, model inputs.
LAGS = [
    ("irradiation_lag_1", "irradiation", 1),
    ("irradiation_lag_2", "irradiation", 2),
    ("ambient_temp_lag_1", "ambient_temperature", 1),
    ("module_temp_lag_1", "module_temperature", 1),
]
ROLL_ROWS = 4
ROLL_MEAN, ROLL_STD = "irradiation_roll_mean_1h", "irradiation_roll_std_1h"
HISTORY = [name for name, _, _ in LAGS] + [ROLL_MEAN, ROLL_STD]
MODEL_FEATURES = [
    "ambient_temperature", "module_temperature", "irradiation", "temp_diff",
    "hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos",
    "irradiation_lag_1", "irradiation_lag_2", "ambient_temp_lag_1", "module_temp_lag_1",
    "irradiation_roll_mean_1h", "irradiation_roll_std_1h",
    "om_temperature_2m", "om_relative_humidity_2m",
]
TARGET = "ac_power"


def add_row_features(df: DataFrame, time: str = TIME) -> DataFrame:
    """Day flag, heating above ambient, calendar and its circular encoding."""
    return df.withColumns(
        {"is_day": physics.is_day(), "temp_diff": physics.temp_diff(), **physics.calendar(time), **physics.cyclic(time)}
    )


def lagged(cut: S.Series, lags: list[tuple[str, str, int]]) -> S.Series:
    return cut.with_columns({new: f"lag(`{c}`, {n}) {cut.over()}" for new, c, n in lags})


def rolled(cut: S.Series, col: str, rows: int, mean: str, std: str) -> S.Series:
    """Mean and sample deviation of the `rows` readings before the current one; null unless all are known."""
    w = cut.over(f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING")
    stats = {mean: "avg", std: "stddev_samp"}
    return cut.with_columns(
        {new: f"CASE WHEN count(`{col}`) {w} = {rows} THEN {fn}(`{col}`) {w} END" for new, fn in stats.items()}
    )


def add_history(
    df: DataFrame, plant: str = PLANT, source: str = SOURCE, time: str = TIME,
    heads: str = "fill", scope: str = "group", max_rows: int | None = None,
) -> DataFrame:
    """Lags and rolling statistics of each device.

    heads: "null" keeps the gaps at the start of a series, "fill" gives them the next known value,
    "drop" removes those rows. scope="carry" additionally hands the last value of the previous device of the
    plant to a device that has none, as a fill over the whole frame does.
    """
    cut = S.segments(df, [plant, source], [time], before=max([n for _, _, n in LAGS] + [ROLL_ROWS]), max_rows=max_rows)
    cut = rolled(lagged(cut, LAGS), "irradiation", ROLL_ROWS, ROLL_MEAN, ROLL_STD)
    cut = cut.with_frame(cut.frame.filter(S.OWN))
    if heads == "drop":
        return cut.own_rows().dropna(subset=HISTORY)
    if heads == "null":
        return cut.own_rows()
    if heads != "fill":
        raise ValueError(f"unknown heads {heads!r}: null, fill or drop")
    filled = fill_edges(cut, HISTORY).own_rows()
    if scope == "group":
        return filled
    if scope == "carry":
        return carry_between_series(filled, [plant], source, time, HISTORY, max_rows)
    raise ValueError(f"unknown scope {scope!r}: group or carry")


def cap_at_night(df: DataFrame, powers: tuple[str, ...] = ("ac_power", "dc_power"), keep_raw: bool = True) -> DataFrame:
    """Power is 0 at night; the readings stay available as `<power>_raw`."""
    raw = {f"{p}_raw": F.col(p) for p in powers} if keep_raw else {}
    return df.withColumns({**raw, **{p: physics.at_night_zero(p) for p in powers}})


def engineer(df: DataFrame, heads: str = "fill", scope: str = "group", max_rows: int | None = None) -> DataFrame:
    """Cleaned table → processed table."""
    return cap_at_night(add_history(add_row_features(df), heads=heads, scope=scope, max_rows=max_rows))
