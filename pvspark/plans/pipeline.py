"""The five steps from input files to leaderboard. Steps exchange stage tables, so each can be rerun alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.functions import physics
from pvspark.functions.timeparse import require_times
from pvspark.operators import features, fill, learn, metrics, profile, search, sequences, split
from pvspark.operators.clean import PLANT, TIME, available, clean
from pvspark.operators.small import checked_small
from pvspark.session import configure
from pvspark.sources import files
from pvspark.sources import weather as weather_source


@dataclass(frozen=True)
class Inputs:
    """Paths of the input files, per plant."""

    generation: dict[int, str]
    sensor: dict[int, str]
    weather: dict[int, str]
    day_first_plants: tuple[int, ...] = (1,)


def clean_step(spark: SparkSession, inputs: Inputs, folder: str, fill: str = "time") -> None:
    generation = files.read_generation(spark, inputs.generation, inputs.day_first_plants)
    weather = files.read_weather(spark, inputs.weather)
    cleaned = clean(generation, files.read_sensor(spark, inputs.sensor), weather, fill=fill)
    files.write_stage(cleaned, folder, "cleaned")


def profile_tables(cleaned: DataFrame) -> dict[str, DataFrame]:
    """The data of every profiling chart, by name."""
    df = cleaned.withColumn("temp_diff", physics.temp_diff())
    day, sunny, peak = profile.daylight(df), profile.sunny(df), profile.peak_hours(df)
    tables = {
        "hist_ac": profile.histogram(day, "ac_power"),
        "hist_dc": profile.histogram(day, "dc_power"),
        "density_ac": profile.density_curve(day, "ac_power"),
        "density_dc": profile.density_curve(day, "dc_power"),
        "hourly_profile": profile.hourly_profile(df, ["ac_power", "irradiation", "module_temperature", "ambient_temperature"]),
        "correlation": profile.label_pairs(profile.correlation_matrix(df, available(df, profile.CORR_EXTENDED), [PLANT])),
        "scatter": profile.scatter_density(df, "irradiation", "ac_power"),
        "zero_power": profile.zero_power(df),
        "yield": profile.yield_gap(profile.inverter_yield(df)),
    }
    charts = [
        ("wind", sunny, "om_wind_speed_10m", "temp_diff"), ("cloud_direct", peak, "om_cloud_cover", "om_direct_radiation"),
        ("cloud_diffuse", peak, "om_cloud_cover", "om_diffuse_radiation"),
        ("humidity", sunny, "om_relative_humidity_2m", "ac_power"),
    ]
    for name, rows, x, y in charts:
        if available(rows, [x, y]) == [x, y]:
            tables[f"{name}_trend"] = profile.trend_line(rows, x, y)
            if name != "humidity":
                tables[f"{name}_binned"] = profile.binned_means(rows, x, y)
    return tables


def profile_step(spark: SparkSession, folder: str) -> None:
    for name, table in profile_tables(files.read_stage(spark, folder, "cleaned")).items():
        table.write.mode("overwrite").parquet(f"{folder}/profile/{name}")


def feature_step(spark: SparkSession, folder: str, heads: str = "fill", scope: str = "group") -> None:
    files.write_stage(features.engineer(files.read_stage(spark, folder, "cleaned"), heads, scope), folder, "processed")


def split_step(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the split table and returns its report."""
    files.write_stage(split.chrono_split(files.read_stage(spark, folder, "processed")), folder, "split", (PLANT, "split"))
    return split.split_report(files.read_stage(spark, folder, "split"))


def weather_step(
    spark: SparkSession, payloads: dict[int, str], folder: str, start: str, end: str, step: str = "15 minutes",
    coordinates: dict[int, tuple[float, float]] | None = None,
) -> None:
    """Saved payloads to the stage table `weather` on a regular grid from `start` to `end`.

    The job fails at the first payload that cannot be used, and at the first time that cannot be read.
    """
    good = weather_source.require_good(weather_source.read_payloads(spark, payloads, coordinates))
    hourly = require_times(weather_source.hourly_rows(good, coordinates), TIME, "weather payload")
    spans = hourly.select("plant_no").distinct().selectExpr("plant_no", f"timestamp_ntz '{start}' AS _from", f"timestamp_ntz '{end}' AS _to")
    grid = fill.time_grid(spans, ["plant_no"], "_from", "_to", TIME, step)
    fixed = ["latitude", "longitude", "open_meteo_timezone", "open_meteo_utc_offset_seconds"]
    rows = fill.align_to_grid(hourly, grid, ["plant_no"], TIME, files.WEATHER_COLS, fixed)
    files.write_stage(rows.select(*weather_source.STAGE_COLS), folder, "weather", ("plant_no",))


def day_ahead_step(spark: SparkSession, folder: str, **overrides) -> DataFrame:
    """Forecast the next day of each plant's total power from two days of history; writes and returns the scores per plant and split."""
    total = files.read_stage(spark, folder, "split").groupBy(PLANT, "split", TIME).agg(F.sum("ac_power").alias("ac_power"))
    windows = sequences.sequence_windows(total, [PLANT, "split"], TIME, ["ac_power"])
    files.write_stage(learn.day_ahead_rows(windows, sequences.STEPS_PER_DAY), folder, "day_ahead_rows")

    def one(_, mine):
        model = learn.fit_day_ahead(mine.filter("split = 'train'"), **overrides)
        return metrics.limit_predictions(model.transform(learn.assemble_day_ahead(mine.filter("split <> 'train'"))), learn.PREDICTION, None)

    scored = reduce(DataFrame.unionByName, learn.for_each_plant(files.read_stage(spark, folder, "day_ahead_rows"), one))
    files.write_stage(metrics.evaluate(scored, "y", learn.PREDICTION, (PLANT, "split")), folder, "day_ahead_scores")
    return files.read_stage(spark, folder, "day_ahead_scores")


def tuned(
    spark: SparkSession, folder: str, key: str, settings: list[dict], folds: int, name: str, most: int | None = None, seconds: float | None = None
) -> list[learn.Fitted]:
    """Cross-validate settings of a registry model on each plant's training rows; the best ones, fitted, for `model_step(extra=...)`.

    Results are kept in the folder `search`, so a call after a stop goes on where the last one ended. With `most` or `seconds` a call does that many
    fits, or begins none after that time, and raises `search.Unfinished` while some are missing.
    """
    prepared, features = learn.prepare(files.read_stage(spark, folder, "split"))
    found = search.Search(prepared, features, learn.MODELS[key][1](), settings, folds, f"{folder}/search")
    found.fill(most, seconds)
    return found.best(name, key)


def model_step(
    spark: SparkSession, folder: str, models: list[str] | None = None, overrides: dict[str, dict] | None = None,
    author: str | None = None, estimators: dict[str, Estimator] | None = None, extra: list[learn.Fitted] = (),
) -> DataFrame:
    """Fit, score, save models and reports; returns this run's board rows.

    `models` are registry keys, or "ridge", which is fitted for all plants at once. `estimators` are Spark regressors of one's own by
    board name, `extra` models fitted before, such as tuned ones.
    """
    rows = files.read_stage(spark, folder, "split")
    learn.skipped_rows(rows).write.mode("overwrite").parquet(f"{folder}/skipped_rows")
    prepared, names = learn.prepare(rows)
    keys = models if models is not None else [] if estimators or extra else ["random_forest"]
    fitted = learn.fit_models(prepared, names, [k for k in keys if k != "ridge"], overrides) if set(keys) - {"ridge"} else []
    for name, estimator in (estimators or {}).items():
        fitted += learn.fit_each_plant(prepared, names, estimator, name.lower().replace(" ", "_"), name)
    fitted += list(extra)
    parts = [learn.score(prepared, fitted).drop("_label")] if fitted else []
    parts += [learn.score_least_squares(rows)] if "ridge" in keys else []
    files.write_stage(reduce(DataFrame.unionByName, parts), folder, "predictions")
    importances = [f.importances() for f in fitted]
    if importances:
        reduce(DataFrame.unionByName, importances).coalesce(1).write.mode("overwrite").parquet(f"{folder}/importances")
    scored = files.read_stage(spark, folder, "predictions")
    rows, _ = checked_small(metrics.metrics_report(scored).withColumn("author", F.lit(author).cast("string")))

    for one in fitted:
        learn.save_model(one, f"{folder}/models")
    files.write_report_csv(rows, f"{folder}/metrics_report_csv")
    files.write_report_text(metrics.report_lines(rows), f"{folder}/metrics_report_txt")
    files.add_to_board(rows, f"{folder}/board")

    best, _ = checked_small(metrics.preferred_model(rows).select("plant", "model"))
    plant_name = F.concat(F.lit("Plant "), F.col(PLANT).cast("string"))
    curve = scored.filter(F.col("split") == "test").withColumn("plant", plant_name).join(best, ["plant", "model"])
    metrics.forecast_curve(curve).write.mode("overwrite").parquet(f"{folder}/forecast_curve")
    return rows


def run(
    spark: SparkSession, inputs: Inputs, folder: str, models: list[str] | None = None,
    overrides: dict[str, dict] | None = None,
) -> DataFrame:
    configure(spark)
    clean_step(spark, inputs, folder)
    profile_step(spark, folder)
    feature_step(spark, folder)
    split_step(spark, folder)
    return model_step(spark, folder, models, overrides)


