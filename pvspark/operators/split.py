"""Chronological train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators.clean import PLANT, TIME
from pvspark.operators.small import join_side

# Lengths of the training and validation periods.
TRAIN_DAYS, VAL_DAYS = 20, 7


def chrono_split(
    df: DataFrame, plant: str = PLANT, time: str = TIME, train_days: int = TRAIN_DAYS, val_days: int = VAL_DAYS
) -> DataFrame:
    """Add `split`; the periods start at the first instant of each plant and exclude their end.

    A row without a time is in no period: its split is null.
    """
    origin = df.groupBy(plant).agg(F.min(time).alias("_start"))
    val_start = F.col("_start") + F.expr(f"interval {train_days} days")
    test_start = F.col("_start") + F.expr(f"interval {train_days + val_days} days")
    split = F.when(F.col(time) < val_start, "train").when(F.col(time) < test_start, "val").when(F.col(time) >= test_start, "test")
    return join_side(df, origin, [plant]).withColumn("split", split).drop("_start")


def split_report(df: DataFrame, plant: str = PLANT, time: str = TIME) -> DataFrame:
    return df.groupBy(plant, "split").agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("n_rows")
    )
