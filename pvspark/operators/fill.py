"""Gap filling along ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import series as S
from pvspark.operators.small import checked_small, join_side


def _interpolated(c: str, at: str) -> str:
    """The value itself, else the line between its neighbours, else whichever neighbour exists."""
    line = f"`_pv_{c}` + (`_nv_{c}` - `_pv_{c}`) * try_divide({at} - `_pp_{c}`, `_np_{c}` - `_pp_{c}`)"
    return f"coalesce(`{c}`, {line}, `_pv_{c}`, `_nv_{c}`) AS `{c}`"


def fill_linear(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], by: str = "time",
    max_rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Linear interpolation, then back-fill of the head and forward-fill of the tail.

    `by="time"` weighs by the clock of the first order column; `by="row"` counts rows, as positional
    interpolation does.
    """
    if not cols:
        return df
    columns = df.columns
    if by == "row":
        _, n_long = S.long_series(df, keys, max_rows)
        if n_long == 0:
            cut = S.segments(df, keys, order, longest=0)
            cut = cut.with_columns({"_row": f"row_number() {cut.over()}"})
        else:
            cut = S.segments(S.row_index(df, keys, order, "_row", max_rows), keys, order, max_rows=max_rows, index="_row")
        at = "CAST(_row AS DOUBLE)"
    elif by == "time":
        cut = S.segments(df, keys, order, max_rows=max_rows, longest=longest)
        at = S.position(df, order[0])
    else:
        raise ValueError(f"unknown axis {by!r}: time or row")
    found = S.neighbours(cut, cols, at)
    return found.selectExpr(*[_interpolated(c, at) if c in cols else S.q(c) for c in columns])


def fill_edges(cut: S.Series, cols: list[str]) -> S.Series:
    """Back-fill inside each series, then forward-fill what is left at its end."""
    found = S.neighbours(cut, cols, None)
    filled = {c: f"coalesce(`{c}`, `_nv_{c}`, `_pv_{c}`) AS `{c}`" for c in cols}
    return cut.with_frame(found.selectExpr(*[filled.get(c, S.q(c)) for c in cut.frame.columns]))


def fill_forward(cut: S.Series, cols: list[str]) -> S.Series:
    """Nulls take the last known value of their own series."""
    found = S.neighbours(cut, cols, None, "before")
    filled = {c: f"coalesce(`{c}`, `_pv_{c}`) AS `{c}`" for c in cols}
    return cut.with_frame(found.selectExpr(*[filled.get(c, S.q(c)) for c in cut.frame.columns]))


def carry_between_series(
    df: DataFrame, group: list[str], series_key: str, time: str, cols: list[str], max_rows: int | None = None
) -> DataFrame:
    """Give a series without any value the last value of the nearest earlier series of its group.

    That is what a forward-fill over the whole frame, sorted by (series, time), adds to series whose own
    gaps are filled already. Only a summary with one row per series is ordered across the group.
    """
    known = [F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN `{time}` END) AS `{c}`") for c in cols]
    last = df.groupBy(*group, series_key).agg(*known)
    last, n = checked_small(last)
    handed = fill_forward(S.segments(last, group, [series_key], max_rows=max_rows, longest=n), cols).own_rows()
    handed = handed.selectExpr(*map(S.q, [*group, series_key]), *[f"`{c}` AS `_h_{c}`" for c in cols])
    filled = {c: f"coalesce(`{c}`, `_h_{c}`) AS `{c}`" for c in cols}
    return join_side(df, handed, [*group, series_key]).selectExpr(*[filled.get(c, S.q(c)) for c in df.columns])


def time_grid(spans: DataFrame, keys: list[str], start: str, end: str, time: str, step: str = "15 minutes") -> DataFrame:
    """Every instant from `start` to `end`, both included, for each key."""
    instants = F.sequence(F.col(start), F.col(end), F.expr(f"interval {step}"))
    return spans.select(*keys, F.explode(instants).alias(time))


def align_to_grid(
    hourly: DataFrame, grid: DataFrame, keys: list[str], time: str, cols: list[str], constants: list[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Put an hourly series on a finer grid: keep the readings that fall on it, interpolate the rest.

    Readings off the grid are dropped, as a reindex does. `constants` are columns with one value per key,
    repeated on every grid row.
    """
    on_grid, n = checked_small(join_side(grid, hourly.select(*keys, time, *cols), [*keys, time]))
    # Grid steps are equal, so weighing by time is weighing by position.
    filled = fill_linear(on_grid, keys, [time], cols, "time", max_rows, n)
    if not constants:
        return filled
    per_key = hourly.groupBy(*keys).agg(*[F.expr(f"min_by(`{c}`, `{time}`) AS `{c}`") for c in constants])
    return join_side(filled, per_key, keys)
