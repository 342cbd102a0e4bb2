"""Telemetry views over the `events` table: users are devices, event types feed the different tables.

Every 15-minute instant, device and plant below is derived from the stored events, so all of it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvspark.operators import fill, series
from pvspark.operators.clean import PLANT, SOURCE, TIME, clean, join_weather
from pvspark.operators.features import add_history, add_row_features, cap_at_night
from pvspark.operators.profile import date_span
from pvspark.operators.small import join_side
from pvspark.operators.split import chrono_split
from pvspark.sources.files import WEATHER_COLS

NARROW = ["om_temperature_2m", "om_relative_humidity_2m"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*kinds))
    return ev.select(
        F.window("ts", "15 minutes")["start"].alias(TIME),
        (F.col("user_id") % 2 + 1).cast("int").alias(PLANT), F.col("user_id").alias(SOURCE),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("value")
    rows = readings(spark, sf_dir, "click", "purchase", "view").groupBy(TIME, PLANT, SOURCE)
    return rows.agg(F.round(total * 10, 4).alias("dc_power"), F.round(total, 4).alias("ac_power"))


def daylight_bell(instant: Column) -> Column:
    """0 at night, 1 at noon."""
    return F.greatest(F.lit(0.0), F.sin(F.pi() * (F.hour(instant) - 6) / F.lit(12.0)))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm, k = F.avg("value") / 4, F.avg("k")
    rows = readings(spark, sf_dir, "error").groupBy(TIME, PLANT)
    return rows.agg(warm.alias("_w"), k.alias("_k")).select(
        TIME, PLANT, F.round("_w", 8).alias("ambient_temperature"),
        F.round(F.col("_w") + F.col("_k") / 5, 8).alias("module_temperature"),
        F.round(daylight_bell(F.col(TIME)) * F.col("_k") / 100, 8).alias("irradiation"),
    )


def weather(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    """Hourly macro weather of each plant, with gaps."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    rows = ev.select(
        F.window("ts", "1 hour")["start"].alias(TIME), (F.col("user_id") % 2 + 1).cast("int").alias(PLANT),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    hourly = rows.groupBy(TIME, PLANT).agg(F.avg("value").alias("_v"), F.avg("k").alias("_k"), F.max("k").alias("_m"))
    v, k, m = F.col("_v"), F.col("_k"), F.col("_m").cast("double")
    short = daylight_bell(F.col(TIME)) * v * 10
    values = {
        "om_temperature_2m": v, "om_relative_humidity_2m": k, "om_dew_point_2m": v - k / 5,
        "om_apparent_temperature": v + k / 50, "om_pressure_msl": 1000 + k / 10, "om_surface_pressure": 950 + k / 10,
        "om_precipitation": F.greatest(F.lit(0.0), k - 60) / 10, "om_cloud_cover": m,
        "om_wind_speed_10m": F.abs(k - 50) / 2, "om_wind_direction_10m": k * 3.6, "om_shortwave_radiation": short,
        "om_direct_radiation": short * (100 - m) / 100, "om_diffuse_radiation": short * m / 100,
        "om_direct_normal_irradiance": short * (100 - m) / 90, "om_sunshine_duration": 36 * (100 - m),
    }
    return hourly.select(TIME, PLANT, *[F.round(values[c], 8).alias(c) for c in (cols or WEATHER_COLS)])


def joined(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    return join_weather(generation(spark, sf_dir), sensor(spark, sf_dir), weather(spark, sf_dir, cols or NARROW))


def cleaned(spark: SparkSession, sf_dir: str, fill_by: str = "time", cols: list[str] | None = None) -> DataFrame:
    side = weather(spark, sf_dir, NARROW if cols is None else cols)
    return clean(generation(spark, sf_dir), sensor(spark, sf_dir), side, fill=fill_by)


def sensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, without macro weather."""
    return clean(generation(spark, sf_dir), sensor(spark, sf_dir))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_at_night(add_history(add_row_features(cleaned(spark, sf_dir))))


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Night-capped, split rows without lags and macro weather."""
    return chrono_split(cap_at_night(add_row_features(sensed(spark, sf_dir)), keep_raw=False))


def with_daily_yield(df: DataFrame) -> DataFrame:
    """Energy of the device since midnight, over the at most 96 rows of a device's day."""
    today = Window.partitionBy(PLANT, SOURCE, F.to_date(TIME)).orderBy(TIME)
    return df.withColumn("daily_yield", F.round(F.sum("ac_power").over(today) / 4, 4))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_span([generation(spark, sf_dir), sensor(spark, sf_dir)])


def previous_power(df: DataFrame) -> DataFrame:
    """Stand-in models that need no fit: power one reading ago, and the mean of the last four."""
    cut = series.segments(df, [PLANT, SOURCE], [TIME], before=4)
    return cut.with_columns(
        {
            "last_reading": f"coalesce(lag(ac_power) {cut.over()}, 0D)",
            "mean_reading": f"coalesce(avg(ac_power) {cut.over('ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING')}, 0D)",
        }
    ).own_rows()


LAST, MEAN = "Last Reading", "Mean Reading"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlimited predictions of two stand-in models; plant 2 has only one of them."""
    rows = previous_power(capped(spark, sf_dir))
    both = F.array(
        F.struct(F.lit(LAST).alias("model"), (F.col("last_reading") - 20).alias("prediction")),
        F.when(F.col(PLANT) == 1, F.struct(F.lit(MEAN).alias("model"), (F.col("mean_reading") - 10).alias("prediction"))),
    )
    return rows.select(
        PLANT, SOURCE, TIME, "split", "is_day", "ac_power", "last_reading", F.inline(F.array_compact(both))
    )


def plant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plant's total power and filled sensor readings on the whole 15-minute grid (calendar-bound)."""
    grid = fill.time_grid(span(spark, sf_dir), [PLANT], "start_time", "end_time", TIME)
    power = generation(spark, sf_dir).groupBy(PLANT, TIME).agg(F.sum("ac_power").alias("ac_power"))
    cols = ["ambient_temperature", "module_temperature", "irradiation"]
    side = fill.align_to_grid(sensor(spark, sf_dir), grid, [PLANT], TIME, cols)
    rows = join_side(side, power, [PLANT, TIME]).withColumn("ac_power", F.coalesce("ac_power", F.lit(0.0)))
    return rows.withColumn("temp_diff", F.col("module_temperature") - F.col("ambient_temperature"))
