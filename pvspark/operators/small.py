"""Side tables which may be broadcast, and the check that allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many rows are ever broadcast (about 30 columns of doubles: under 50 MB), unless the session
# setting says otherwise.
BROADCAST_ROWS = 200_000
BROADCAST_ROWS_CONF = "spark.pvspark.broadcastRows"


def broadcast_rows(df: DataFrame, limit: int | None = None) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS))) if limit is None else limit


def checked_small(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, int | None]:
    """Evaluate `df` if it has at most `limit` rows.

    Returns (local broadcastable table, row count) when it fits, else (the untouched plan, None): then
    joins on it are shuffle joins, whose hot keys adaptive execution splits. `take` reads partitions only
    until the limit is passed, so a large table is found out early.
    """
    limit = broadcast_rows(df, limit)
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema, verifySchema=False)), len(rows)


def join_side(
    df: DataFrame, side: DataFrame, keys: list[str], how: str = "left", limit: int | None = None, rows: int | None = None
) -> DataFrame:
    """Join `df` to a side table: broadcast behind a row check, else a shuffle join.

    `rows` is the size of the side (or a bound on it) where it has been counted already.
    """
    if rows is None:
        side, _ = checked_small(side, limit)
    elif rows <= broadcast_rows(df, limit):
        side = F.broadcast(side)
    return df.join(side, keys, how)
