"""Sliding history → target windows over the rows of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import series as S

# Two days of history predict the next day, in 15-minute steps.
STEPS_PER_DAY = 96
LOOKBACK, HORIZON = 2 * STEPS_PER_DAY, STEPS_PER_DAY
SEQUENCE_FEATURES = ["ac_power", "irradiation", "module_temperature", "temp_diff"]


def _starts(df: DataFrame, keys: list[str], time: str, length: int, max_rows: int) -> S.Series:
    """Series with a `_full` flag on rows which have `length` rows from themselves on."""
    cut = S.segments(df, keys, [time], after=length - 1, max_rows=max_rows)
    return cut.with_columns({"_full": f"count(1) {cut.over(f'ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING')} = {length}"})


#: Rows of a series in one block; more if a window is longer.
BLOCK_ROWS = 4096


def series_blocks(
    df: DataFrame, keys: list[str], time: str, features: list[str], target: str, length: int,
    block_rows: int = BLOCK_ROWS, max_rows: int | None = None,
) -> DataFrame:
    """Each series as arrays: `times`, `x` (structs of the features) and `targets` of a block's rows and the `length` - 1 rows behind them.

    `n_starts` rows of a block begin a window of `length` rows that fits into the series. Blocks without one are left out. A reading is copied once at most,
    for the block before it, so what is shuffled hardly depends on `length`.
    """
    size = max(block_rows, length)
    needed = list(dict.fromkeys([*keys, time, *features, target]))
    rows = S.row_index(df.select(*needed), keys, [time], "_i", max_rows)
    home, offset = f"CAST(floor((_i - 1) / {size}) AS BIGINT)", f"((_i - 1) % {size})"
    homes = f"array_compact(array({home}, CASE WHEN {offset} < {length - 1} AND {home} > 0 THEN {home} - 1 END))"
    rows = rows.selectExpr("*", f"explode({homes}) AS block")
    entry = f"struct(_i, {S.q(time)} AS _time, struct({', '.join(map(S.q, features))}) AS _x, {S.q(target)} AS _y)"
    blocks = rows.groupBy(*keys, "block").agg(F.expr(f"array_sort(collect_list({entry}), (a, b) -> CAST(a._i - b._i AS INT)) AS _rows"))
    return blocks.selectExpr(
        *map(S.q, keys), "block", "transform(_rows, e -> e._time) AS times", "transform(_rows, e -> e._x) AS x", "transform(_rows, e -> e._y) AS targets",
        f"least({size}, size(_rows) - {length - 1}) AS n_starts",
    ).filter("n_starts > 0")


def cut_windows(blocks: DataFrame, keys: list[str], lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """The windows of blocks, as slices of their arrays: `start_time`, `x` and the next `horizon` targets `y`."""
    places = blocks.selectExpr(*map(S.q, keys), "times", "x", "targets", "explode(sequence(1, n_starts)) AS _s")
    return places.selectExpr(
        *map(S.q, keys), "times[_s - 1] AS start_time", f"slice(x, _s, {lookback}) AS x", f"slice(targets, _s + {lookback}, {horizon}) AS y"
    )


def sequence_windows(
    df: DataFrame, keys: list[str], time: str, features: list[str] | None = None, target: str = "ac_power",
    lookback: int = LOOKBACK, horizon: int = HORIZON, max_rows: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per window: `x` holds `lookback` structs of the features, `y` the next `horizon` targets.

    Windows slide by one row, count rows rather than clock time, and never leave their series: pass the
    split as a key to keep them inside a split. They are cut from blocks where they are needed; only blocks are shuffled.
    """
    blocks = series_blocks(df, keys, time, features or SEQUENCE_FEATURES, target, lookback + horizon, block_rows, max_rows)
    return cut_windows(blocks, keys, lookback, horizon)


def window_starts(
    df: DataFrame, keys: list[str], time: str, lookback: int = LOOKBACK, horizon: int = HORIZON,
    max_rows: int | None = None,
) -> DataFrame:
    """First instant of every window, without building the arrays."""
    cut = _starts(df.select(*keys, time), keys, time, lookback + horizon, max_rows)
    return cut.frame.filter(F.col("_full") & F.col(S.OWN)).select(*keys, time)


def sample_window(
    df: DataFrame, keys: list[str], time: str, index: int = 100, lookback: int = LOOKBACK, horizon: int = HORIZON,
    max_rows: int | None = None,
) -> DataFrame:
    """The rows of window number `index` (from 0, in key and time order) with their `step` from 1.

    Steps 1 … lookback are the history, the others the target.
    """
    start = window_starts(df, keys, time, lookback, horizon, max_rows).orderBy(*keys, time).offset(index).limit(1)
    start = F.broadcast(start.withColumnRenamed(time, "_start"))  # a single row
    rows = df.join(start, keys).filter(F.col(time) >= F.col("_start")).orderBy(time).limit(lookback + horizon)
    return S.row_index(rows.drop("_start"), keys, [time], "step", max_rows)


def steps_of(windows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(window × step) rows from target and prediction arrays, for scoring; steps count from 1."""
    rest = [c for c in windows.columns if c not in (y, p, "x")]
    pairs = F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("step", "_pair")
    flat = windows.select(*rest, pairs)
    return flat.select(*rest, (F.col("step") + 1).alias("step"), F.col("_pair.y").alias("y"), F.col("_pair.p").alias("p"))
