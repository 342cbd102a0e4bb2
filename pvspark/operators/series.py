"""Ordered work over series (rows sharing `keys`, sorted by `order`) of any length.

A series is usually short and one window task handles it. A series longer than `max_rows` is cut into
segments of `max_rows` consecutive rows, each one its own window group. Rows near a segment's edge are
copied into the neighbour that needs them; values known only in another segment travel through a summary
with one row per segment. Results do not depend on where the cuts fall.

Expressions are SQL text: many are built in loops over columns, and text needs one call to Spark each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.operators.small import checked_small
from pvspark.session import cut

MAX_ROWS = 1_000_000  # rows of one series handled by one task, unless the session setting says otherwise
MAX_ROWS_CONF = "spark.pvspark.seriesRows"
SLICES_PER_SEGMENT = 2  # finer cuts while counting, as a sample cuts only roughly evenly

SEG = "_seg"
OWN = "_own"
INDEX = "_index"
_SLICE = "_slice"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def q(name: str) -> str:
    return f"`{name}`"


def over(keys: list[str], order: list[str], frame: str = "", descending: bool = False) -> str:
    turn = " DESC" if descending else ""
    return f"OVER (PARTITION BY {', '.join(map(q, keys))} ORDER BY {', '.join(q(c) + turn for c in order)} {frame})"


def position(df: DataFrame, name: str) -> str:
    """SQL for a number that grows with `name`, to interpolate by: seconds for time, days for dates."""
    c, kind = q(name), df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        days = f"CAST(unix_date(CAST({c} AS DATE)) AS DOUBLE)"
        return f"({days} * 86400 + hour({c}) * 3600 + minute({c}) * 60 + CAST(extract(SECOND FROM {c}) AS DOUBLE))"
    if isinstance(kind, T.DateType):
        return f"CAST(unix_date({c}) AS DOUBLE)"
    return f"CAST({c} AS DOUBLE)"


def rows_per_task(df: DataFrame, max_rows: int | None = None) -> int:
    return max_rows or int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))


def long_series(df: DataFrame, keys: list[str], max_rows: int | None = None) -> tuple[DataFrame, int | None]:
    """Series above `max_rows`, with their length `_n`: at most one per `max_rows` input rows, and normally none."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return checked_small(stats.filter(f"_n > {rows_per_task(df, max_rows)}"))


def sliced(rows: DataFrame, keys: list[str], order: list[str], n_rows: int, max_rows: int) -> DataFrame:
    """`rows` with `_slice`: ranges of (keys, order) with about max_rows / SLICES_PER_SEGMENT rows each.

    The ranges come from ranks in a sample, so neither an outlier nor a burst nor long common prefixes unbalance them.
    A second sample could cut elsewhere, so the slices are written before anything reads them twice.
    """
    n = math.ceil(n_rows * SLICES_PER_SEGMENT / max_rows)
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn(_SLICE, F.spark_partition_id()))


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str | None, name: str, max_rows: int | None = None
) -> DataFrame:
    """Inclusive running total of `value` (of 1 if None, i.e. the row number) along each series.

    A long series is totalled slice by slice, and the totals of the slices before are added: neither the series nor a
    crowded instant is one task.
    """
    max_rows = rows_per_task(df, max_rows)
    item = "1L" if value is None else q(value)
    total = f"sum({item}) {over(keys, order, UPTO)}"
    long, n_long = long_series(df, keys, max_rows)
    if n_long == 0:
        return df.withColumn(name, F.expr(total))

    names = long.select(*keys)
    n_rows = long.agg(F.sum("_n")).first()[0]
    cuts = sliced(df.join(names, keys, "left_semi"), keys, order, n_rows, max_rows)
    # One row per slice: max_rows / SLICES_PER_SEGMENT input rows become one.
    sums = cuts.groupBy(*keys, _SLICE).agg(F.expr(f"sum({item}) AS _total"))
    base = sums.selectExpr(*map(q, keys), _SLICE, f"sum(_total) {over(keys, [_SLICE], BEFORE)} AS _base")
    cuts = (
        cuts.withColumn(name, F.expr(f"sum({item}) {over([*keys, _SLICE], order, UPTO)}"))
        .join(base, [*keys, _SLICE], "left")
        .withColumn(name, F.expr(f"{q(name)} + coalesce(_base, 0)"))
        .drop("_base", _SLICE)
    )
    return df.join(names, keys, "left_anti").withColumn(name, F.expr(total)).unionByName(cuts)


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = INDEX, max_rows: int | None = None) -> DataFrame:
    """1, 2, 3, … along each series."""
    return running_sum(df, keys, order, None, name, max_rows)


@dataclass(frozen=True)
class Series:
    """A frame cut into window groups. `cut` tells whether any series spans several segments."""

    frame: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    def with_frame(self, frame: DataFrame) -> Series:
        return Series(frame, self.keys, self.order, self.cut)

    def with_columns(self, exprs: dict[str, str]) -> Series:
        return self.with_frame(self.frame.selectExpr("*", *[f"{e} AS {q(c)}" for c, e in exprs.items()]))

    def over(self, frame: str = "") -> str:
        return over([*self.keys, SEG], self.order, frame)

    def over_backwards(self, frame: str = "") -> str:
        # A descending window with a growing frame is linear; UNBOUNDED FOLLOWING would be quadratic.
        return over([*self.keys, SEG], self.order, frame, descending=True)

    def own_rows(self) -> DataFrame:
        """The input rows again, without copies and helper columns."""
        return self.frame.filter(OWN).drop(SEG, OWN, INDEX)


def segments(
    df: DataFrame, keys: list[str], order: list[str], before: int = 0, after: int = 0,
    max_rows: int | None = None, index: str | None = None, longest: int | None = None,
) -> Series:
    """Cut `df` into segments; each also holds copies of the `before` / `after` rows around it.

    `index` names an existing row number column; without it only long series are numbered. `longest` is an
    upper bound on the series length, if the caller has counted already.
    """
    max_rows = rows_per_task(df, max_rows)
    size = max(max_rows, before, after, 1)
    one_segment = ["*", f"0L AS {SEG}", f"true AS {OWN}"]
    if longest is not None and longest <= size:
        return Series(df.selectExpr(*one_segment), keys, order, False)
    if index is None:
        long, n_long = long_series(df, keys, size)
        if n_long == 0:
            return Series(df.selectExpr(*one_segment), keys, order, False)
        names = long.select(*keys)
        rows = row_index(df.join(names, keys, "left_semi"), keys, order, INDEX, max_rows)
        whole = df.join(names, keys, "left_anti").selectExpr(*one_segment)
        index = INDEX
    else:
        rows, whole = df, None

    home, offset = f"CAST(floor(({q(index)} - 1) / {size}) AS BIGINT)", f"(({q(index)} - 1) % {size})"
    homes = [home]
    if before:
        homes.append(f"CASE WHEN {offset} >= {size - before} THEN {home} + 1 END")
    if after:
        homes.append(f"CASE WHEN {offset} < {after} AND {home} > 0 THEN {home} - 1 END")
    parts = rows.selectExpr("*", f"{home} AS _home", f"explode(array_compact(array({', '.join(homes)}))) AS {SEG}")
    parts = parts.withColumn(OWN, F.expr(f"{SEG} = _home")).drop("_home", INDEX)
    return Series(parts if whole is None else whole.unionByName(parts), keys, order, True)


def neighbours(series: Series, cols: list[str], pos: str | None, sides: str = "both") -> DataFrame:
    """Nearest known value of each column at or before and at or after every row.

    Adds `_pv_c` / `_nv_c`, and with `pos` (SQL) also the positions `_pp_c` / `_np_c` where they were found.
    """
    frame = series.frame
    walks = {
        "p": (series.over(UPTO), "max", over(series.keys, [SEG], BEFORE)),
        "n": (series.over_backwards(UPTO), "min", over(series.keys, [SEG], BEFORE, descending=True)),
    }
    walks = {s: w for s, w in walks.items() if sides == "both" or s == sides[0].replace("b", "p").replace("a", "n")}
    fields = "vp" if pos else "v"
    place = f"struct({', '.join(map(q, series.order))})"

    found = [
        f"last({q(c) if f == 'v' else f'CASE WHEN {q(c)} IS NOT NULL THEN {pos} END'}, true) {window} AS `_{s}{f}_{c}`"
        for s, (window, _, _) in walks.items() for c in cols for f in fields
    ]
    out = frame.selectExpr("*", *found)
    if not series.cut:
        return out

    # What each segment knows at its edge, one row per segment, then carried along the series of segments.
    aggs, carries, merged = [], [], {}
    for s, (_, extreme, along) in walks.items():
        for c in cols:
            at = f"CASE WHEN {q(c)} IS NOT NULL THEN {place} END"
            aggs += [F.expr(f"{extreme}_by({q(c) if f == 'v' else pos}, {at}) AS `_e{s}{f}_{c}`") for f in fields]
            for f in fields:
                carries.append(f"last(`_e{s}{f}_{c}`, true) {along} AS `_c{s}{f}_{c}`")
                merged[f"_{s}{f}_{c}"] = f"_c{s}{f}_{c}"
    summary = frame.filter(OWN).groupBy(*series.keys, SEG).agg(*aggs)
    carried = summary.selectExpr(*map(q, series.keys), SEG, *carries)
    out = out.join(carried, [*series.keys, SEG], "left")
    out = out.withColumns({own: F.expr(f"coalesce(`{own}`, `{other}`)") for own, other in merged.items()})
    return out.drop(*merged.values())
