"""One registered query per operator. All of them read whole tables.

Results are rounded only here, for the comparison with the SQL oracle; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.functions import physics, text, timeparse
from pvspark.operators import dayahead, features, fill, learn, metrics, profile, scale, search, sequences, split
from pvspark.operators import series as S
from pvspark.operators.clean import PLANT, SENSOR_COLS, SOURCE, TIME, drop_bad_times
from pvspark.operators.small import checked_small
from pvspark.plans import fixtures as fx
from pvspark.session import configure, cut, scratch
from pvspark.sources import files
from pvspark.sources import weather as payloads

KEYS = [PLANT, SOURCE, TIME]
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    REGISTRY[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places. Ties, and what float noise makes of them, always go up."""
    unit = f"1e{digits}D"
    return df.selectExpr(
        *[
            f"floor(`{f.name}` * {unit} + 0.5001D) / {unit} AS `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
            for f in df.schema
        ]
    )


# Sources


@query
def src_generation(spark, sf):
    lines = files.csv_lines(fx.generation(spark, sf))
    raw = files.parse_lines(lines, [TIME, PLANT, SOURCE, "dc_power", "ac_power"])
    typed = files.type_generation(raw, F.col(PLANT).cast("int"))
    return typed.withColumn(SOURCE, F.col(SOURCE).cast("long"))


@query
def src_sensor(spark, sf):
    lines = files.csv_lines(fx.sensor(spark, sf), day_first_plants=())
    return files.type_sensor(files.parse_lines(lines, [TIME, PLANT, *SENSOR_COLS]), F.col(PLANT).cast("int"))


@query
def src_weather(spark, sf):
    lines = files.csv_lines(fx.weather(spark, sf), day_first_plants=())
    return files.type_weather(files.parse_lines(lines, [TIME, PLANT, *files.WEATHER_COLS]), F.col(PLANT).cast("int"))


def _through_files(spark, name, df, day_first=()):
    """Input files of every plant, written in its time format. The second plant's columns are in another order."""
    folder = scratch(spark, name)
    stamp = F.when(F.col(PLANT).isin(*day_first), F.date_format(TIME, timeparse.DAY_FIRST)).otherwise(F.date_format(TIME, timeparse.ISO))
    text = df.withColumn(TIME, stamp)
    paths = {1: f"{folder}/first", 2: f"{folder}/second"}
    files.write_csv(text.filter(F.col(PLANT) == 1), paths[1])
    files.write_csv(text.filter(F.col(PLANT) == 2).select(*reversed(df.columns)), paths[2])
    return paths


@query
def files_generation(spark, sf):
    rows = fx.generation(spark, sf)
    back = files.read_generation(spark, _through_files(spark, "generation", rows, (1,)))
    return back.withColumn(SOURCE, F.col(SOURCE).cast("long")).select(*rows.columns)


@query
def files_sensor(spark, sf):
    return files.read_sensor(spark, _through_files(spark, "sensor", fx.sensor(spark, sf)))


@query
def files_weather(spark, sf):
    rows = fx.weather(spark, sf)
    return files.read_weather(spark, _through_files(spark, "weather", rows)).select(*rows.columns)


@query
def stage_table(spark, sf):
    """The split table, published twice and read back."""
    folder, rows = scratch(spark, "stages"), split.chrono_split(fx.generation(spark, sf))
    files.write_stage(rows.filter("split = 'train'"), folder, "split", (PLANT, "split"))
    files.write_stage(rows, folder, "split", (PLANT, "split"))
    return files.read_stage(spark, folder, "split").select(*KEYS, "split")


def _payload_text(spark, sf, broken: bool):
    """One JSON payload per plant and day, at most 24 hours each. Some days are spoilt if `broken`."""
    day = F.to_date(TIME)
    hours = F.array_sort(F.collect_list(F.struct(TIME, *files.WEATHER_COLS)))
    daily = fx.weather(spark, sf).groupBy(F.col(PLANT).alias("plant_no"), day.alias("day")).agg(hours.alias("_h"))
    turn = F.dayofmonth("day") % 7 if broken else F.lit(6)

    def series(c):
        return F.transform("_h", lambda h: h[c])

    stamps = F.transform("_h", lambda h: F.date_format(h[TIME], payloads.PAYLOAD_TIME))
    variables = [
        F.when(turn != 1, series(f"om_{v}")).alias(v) if v == "wind_speed_10m" else series(f"om_{v}").alias(v)
        for v in files.WEATHER_VARIABLES
    ]
    body = F.struct(
        F.when(turn == 0, F.lit(True)).alias("error"), F.when(turn == 0, F.lit("daily limit exceeded")).alias("reason"),
        F.lit("Asia/Kolkata").alias("timezone"), F.lit(19800).alias("utc_offset_seconds"),
        F.when(turn != 2, F.struct(stamps.alias("time"), *variables)).alias("hourly"),
    )
    return daily.select("plant_no", "day", F.to_json(body).alias("payload"))


@query
def weather_json(spark, sf):
    return payloads.hourly_rows(payloads.parse_payloads(_payload_text(spark, sf, False), "payload"))


@query
def weather_json_bad(spark, sf):
    bad = payloads.bad_payloads(payloads.parse_payloads(_payload_text(spark, sf, True), "payload"))
    return bad.select("plant_no", "day", "fault")


# Time


def _order_times(spark, sf, fmt):
    orders = fx.table(spark, sf, "orders")
    stamp = F.when(F.col("o_orderkey") % 10 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", fmt))
    return orders.select("o_orderkey", stamp.alias("time_text"))


@query
def parse_dmy(spark, sf):
    df = _order_times(spark, sf, timeparse.DAY_FIRST)
    return drop_bad_times(df.withColumn(TIME, timeparse.parse_time("time_text", timeparse.DAY_FIRST)))


@query
def parse_iso(spark, sf):
    df = _order_times(spark, sf, timeparse.ISO)
    return df.withColumn(TIME, timeparse.parse_time("time_text", timeparse.ISO))


@query
def bad_time_count(spark, sf):
    df = _order_times(spark, sf, timeparse.DAY_FIRST)
    parsed = timeparse.parse_time("time_text", timeparse.DAY_FIRST)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(parsed.isNull()).alias("n_bad"))


@query
def date_span(spark, sf):
    return fx.span(spark, sf).withColumns(
        {"start_date": timeparse.date_text("start_time"), "end_date": timeparse.date_text("end_time")}
    )


@query
def time_grid(spark, sf):
    return fill.time_grid(fx.span(spark, sf), [PLANT], "start_time", "end_time", TIME)


@query
def weather_grid(spark, sf):
    hourly = fx.weather(spark, sf).withColumns({"plant_no": F.col(PLANT), "open_meteo_timezone": F.lit("Asia/Kolkata")})
    grid = fill.time_grid(fx.span(spark, sf), [PLANT], "start_time", "end_time", TIME)
    return rounded(
        fill.align_to_grid(hourly, grid, [PLANT], TIME, files.WEATHER_COLS, ["plant_no", "open_meteo_timezone"])
    )


# Cleaning


@query
def clean_join(spark, sf):
    return fx.joined(spark, sf)


@query
def clean_fill_time(spark, sf):
    return rounded(fx.cleaned(spark, sf))


@query
def clean_fill_row(spark, sf):
    return rounded(fx.cleaned(spark, sf, "row"))


@query
def table_profile(spark, sf):
    df = fx.joined(spark, sf)
    return rounded(profile.table_profile(df, ["dc_power", "ac_power", *SENSOR_COLS, *fx.NARROW]))


@query
def preview(spark, sf):
    return profile.first_rows(fx.generation(spark, sf), [TIME, PLANT, SOURCE], 3)


@query
def daylight_rows(spark, sf):
    return profile.daylight(fx.generation(spark, sf))


@query
def peak_hours(spark, sf):
    return profile.peak_hours(fx.generation(spark, sf))


# Features


@query
def feat_basic(spark, sf):
    df = fx.joined(spark, sf).withColumns({"is_day": physics.is_day(), "temp_diff": physics.temp_diff()})
    return rounded(df.select(*KEYS, "is_day", "temp_diff"))


@query
def feat_calendar(spark, sf):
    return fx.generation(spark, sf).withColumns(physics.calendar(TIME)).select(*KEYS, "hour", "minute", "day_of_year")


@query
def feat_cyclic(spark, sf):
    parts = physics.cyclic(TIME)
    return rounded(fx.generation(spark, sf).withColumns(parts).select(*KEYS, *parts))


def _history(df):
    return features.add_history(df, heads="null")


@query
def feat_lags(spark, sf):
    return rounded(_history(fx.sensed(spark, sf)).select(*KEYS, *[n for n, _, _ in features.LAGS]))


@query
def feat_rolling(spark, sf):
    return rounded(_history(fx.sensed(spark, sf)).select(*KEYS, features.ROLL_MEAN, features.ROLL_STD))


@query
def feat_filled(spark, sf):
    return rounded(features.add_history(fx.joined(spark, sf)).select(*KEYS, *features.HISTORY))


@query
def feat_filled_carry(spark, sf):
    return rounded(features.add_history(fx.joined(spark, sf), scope="carry").select(*KEYS, *features.HISTORY))


@query
def night_cap(spark, sf):
    df = features.cap_at_night(features.add_row_features(fx.sensed(spark, sf)))
    return rounded(df.select(*KEYS, "is_day", "ac_power", "dc_power", "ac_power_raw", "dc_power_raw"))


# Profiling


@query
def hourly_profile(spark, sf):
    return rounded(profile.hourly_profile(fx.sensed(spark, sf), ["ac_power", "irradiation", "module_temperature", "ambient_temperature"]))


@query
def inverter_yield(spark, sf):
    return rounded(profile.inverter_yield(fx.generation(spark, sf)), 8)


@query
def yield_rank(spark, sf):
    return rounded(profile.ranked_yield(fx.generation(spark, sf)), 8)


@query
def yield_gap(spark, sf):
    return rounded(profile.yield_gap(profile.inverter_yield(fx.generation(spark, sf))), 8)


@query
def zero_power(spark, sf):
    return rounded(profile.zero_power(fx.sensed(spark, sf)))


@query
def corr_matrix_5(spark, sf):
    return rounded(profile.correlation_matrix(fx.sensed(spark, sf), profile.CORR_SENSOR, [PLANT]))


def _corr_9(spark, sf):
    om = [c for c in profile.CORR_SELECTED if c.startswith("om_")]
    return profile.correlation_matrix(fx.cleaned(spark, sf, cols=om), profile.CORR_SELECTED, [PLANT])


@query
def corr_matrix_9(spark, sf):
    return rounded(_corr_9(spark, sf))


@query
def corr_labels(spark, sf):
    return rounded(profile.label_pairs(_corr_9(spark, sf)).select(PLANT, "label_a", "label_b", "r"))


@query
def corr_matrix_15(spark, sf):
    om = [c for c in profile.CORR_EXTENDED if c.startswith("om_")]
    df = fx.cleaned(spark, sf, cols=om).withColumn("temp_diff", physics.temp_diff())
    return rounded(profile.correlation_matrix(fx.with_daily_yield(df), profile.CORR_EXTENDED, [PLANT]))


@query
def hist_ac(spark, sf):
    return rounded(profile.histogram(profile.daylight(fx.generation(spark, sf)), "ac_power"))


@query
def hist_dc(spark, sf):
    return rounded(profile.histogram(profile.daylight(fx.generation(spark, sf)), "dc_power"))


@query
def hist_ac_35(spark, sf):
    return rounded(profile.histogram(profile.daylight(fx.generation(spark, sf)), "ac_power", bins=35))


@query
def kde_ac(spark, sf):
    return rounded(profile.density_curve(profile.daylight(fx.generation(spark, sf)), "ac_power"), 8)


@query
def kde_dc(spark, sf):
    return rounded(profile.density_curve(profile.daylight(fx.generation(spark, sf)), "dc_power"), 8)


@query
def wind_trend(spark, sf):
    df = profile.sunny(fx.cleaned(spark, sf, cols=["om_wind_speed_10m"])).withColumn("temp_diff", physics.temp_diff())
    return rounded(profile.trend_line(df, "om_wind_speed_10m", "temp_diff"))


@query
def wind_binned(spark, sf):
    df = profile.sunny(fx.cleaned(spark, sf, cols=["om_wind_speed_10m"])).withColumn("temp_diff", physics.temp_diff())
    return rounded(profile.binned_means(df, "om_wind_speed_10m", "temp_diff"))


def _peak_radiation(spark, sf):
    df = fx.cleaned(spark, sf, cols=["om_cloud_cover", "om_direct_radiation", "om_diffuse_radiation"])
    return profile.peak_hours(df)


@query
def cloud_trend(spark, sf):
    return rounded(profile.trend_line(_peak_radiation(spark, sf), "om_cloud_cover", "om_direct_radiation"))


@query
def cloud_diffuse_trend(spark, sf):
    return rounded(profile.trend_line(_peak_radiation(spark, sf), "om_cloud_cover", "om_diffuse_radiation"))


@query
def cloud_binned(spark, sf):
    return rounded(profile.binned_means(_peak_radiation(spark, sf), "om_cloud_cover", "om_direct_radiation"))


@query
def humidity_trend(spark, sf):
    return rounded(profile.trend_line(profile.sunny(fx.cleaned(spark, sf)), "om_relative_humidity_2m", "ac_power"))


@query
def scatter_density(spark, sf):
    return profile.scatter_density(fx.sensed(spark, sf), "irradiation", "ac_power")


# Split and scaling


@query
def chrono_split(spark, sf):
    return split.chrono_split(fx.generation(spark, sf)).select(*KEYS, "split")


@query
def split_report(spark, sf):
    return split.split_report(split.chrono_split(fx.generation(spark, sf)))


SCALED = ["ambient_temperature", "module_temperature", "irradiation", "temp_diff"]


def _scaled(spark, sf, fit):
    df = fx.capped(spark, sf).select(*KEYS, "split", *SCALED)
    params = fit(df.filter(F.col("split") == "train"), SCALED)
    return rounded(scale.apply_scale(df, params, SCALED))


@query
def scale_standard(spark, sf):
    return _scaled(spark, sf, scale.fit_standard)


@query
def scale_minmax(spark, sf):
    return _scaled(spark, sf, scale.fit_minmax)


@query
def unscale(spark, sf):
    df = fx.previous_power(fx.capped(spark, sf))
    params = scale.fit_minmax(df.filter(F.col("split") == "train"), ["ac_power"])
    guess = df.select(*KEYS, (F.col("last_reading") - 20).alias("ac_power"))
    scaled = scale.apply_scale(guess, params, ["ac_power"]).withColumnRenamed("ac_power", "prediction")
    return rounded(scale.unscale(scaled, params, {"prediction": "ac_power"}))


# Scores


def _limited(spark, sf):
    return metrics.limit_predictions(fx.scored(spark, sf))


@query
def pred_limits(spark, sf):
    return rounded(_limited(spark, sf).select(*KEYS, "model", "is_day", "prediction"))


@query
def eval_metrics(spark, sf):
    return rounded(metrics.evaluate(_limited(spark, sf), by=(PLANT, "model", "split")))


@query
def metrics_report(spark, sf):
    return rounded(metrics.metrics_report(_limited(spark, sf)))


@query
def metrics_text(spark, sf):
    board = metrics.metrics_report(_limited(spark, sf))
    # A second plant whose number sorts after 2, with a long model name and large numbers: nothing may be cut off.
    wide = {c: F.col(c) * 1e9 for c in metrics.BOARD_METRICS if not c.endswith("_mape") and c != "val_r2"}
    large = board.filter("plant = 'Plant 1'").withColumns(wide)
    large = large.withColumns({"plant": F.lit("Plant 10"), "model": F.concat("model", F.lit(" with Optimized Parameters"))})
    board, _ = checked_small(board.unionByName(large))
    return metrics.report_lines(board)


def _board_and_news(spark, sf):
    rows = fx.scored(spark, sf)
    board = metrics.metrics_report(metrics.limit_predictions(rows))
    again = rows.filter(F.col("model") == fx.LAST).withColumn("prediction", F.col("last_reading"))
    return board, metrics.metrics_report(metrics.limit_predictions(again)).withColumn("author", F.lit("team"))


@query
def leaderboard_upsert(spark, sf):
    return rounded(metrics.upsert_board(*_board_and_news(spark, sf)).select("plant", "model", "author", *metrics.BOARD_METRICS))


@query
def leaderboard_files(spark, sf):
    """The same through published versions."""
    board, news = _board_and_news(spark, sf)
    path = scratch(spark, "board")
    files.add_to_board(board, path)
    files.add_to_board(news, path)
    return rounded(files.read_board(spark, path).select("plant", "model", "author", *metrics.BOARD_METRICS))


@query
def report_file(spark, sf):
    """The report as CSV, read back."""
    path = f"{scratch(spark, 'report')}/metrics_report"
    files.write_report_csv(metrics.metrics_report(_limited(spark, sf)), path)
    schema = f"plant string, model string, {', '.join(f'{c} double' for c in metrics.BOARD_METRICS)}"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query
def preferred_model(spark, sf):
    return metrics.preferred_model(metrics.metrics_report(_limited(spark, sf)), [fx.MEAN, fx.LAST])


@query
def model_slug(spark, sf):
    board = metrics.metrics_report(_limited(spark, sf))
    return rounded(board.select("plant", "model", text.slug(F.col("model")).alias("slug"), "test_r2"))


@query
def forecast_curve(spark, sf):
    rows = _limited(spark, sf).filter((F.col("split") == "test") & (F.col("model") == fx.LAST))
    return rounded(metrics.forecast_curve(rows))


# Sequences


def _window_digest(windows):
    def total(name):
        return F.aggregate("x", F.lit(0.0), lambda acc, e: acc + e[name])

    sums = {f"sum_{c}": total(c) for c in sequences.SEQUENCE_FEATURES}
    y_sum = F.aggregate("y", F.lit(0.0), lambda acc, v: acc + v)
    out = windows.withColumns(
        {**sums, "sum_y": y_sum, "last_x": F.element_at("x", -1)["ac_power"], "first_y": F.element_at("y", 1),
         "n_x": F.size("x"), "n_y": F.size("y")}
    )
    return rounded(out.drop("x", "y"))


@query
def seq_windows(spark, sf):
    return _window_digest(sequences.sequence_windows(fx.plant_series(spark, sf), [PLANT], TIME))


@query
def seq_windows_device(spark, sf):
    return _window_digest(
        sequences.sequence_windows(fx.capped(spark, sf), [PLANT, "split", SOURCE], TIME, lookback=8, horizon=4)
    )


@query
def seq_sample(spark, sf):
    rows, _ = checked_small(fx.plant_series(spark, sf))
    sample = sequences.sample_window(rows, [PLANT], TIME).select(PLANT, TIME, "step", "ac_power")
    day_before = sample.select(PLANT, (F.col("step") + sequences.STEPS_PER_DAY).alias("step"), F.col("ac_power").alias("predicted"))
    target = sample.filter(F.col("step") > sequences.LOOKBACK).join(day_before, [PLANT, "step"])
    step = (F.col("step") - sequences.LOOKBACK).cast("int")
    return rounded(target.select(PLANT, TIME, step.alias("step"), F.col("ac_power").alias("actual"), "predicted"))


@query
def eval_multistep(spark, sf):
    windows = sequences.sequence_windows(fx.capped(spark, sf), [PLANT, "split", SOURCE], TIME, lookback=8, horizon=4)
    last = F.element_at("x", -1)["ac_power"]
    held = windows.withColumn("p", F.transform("y", lambda v: last))
    return rounded(metrics.evaluate(sequences.steps_of(held), "y", "p", (PLANT, "split")))


@query
def eval_multistep_day(spark, sf):
    """Two days of history, one day ahead: the day before as the forecast."""
    windows = sequences.sequence_windows(split.chrono_split(fx.plant_series(spark, sf)), [PLANT, "split"], TIME)
    day = F.transform(F.slice("x", -sequences.STEPS_PER_DAY, sequences.STEPS_PER_DAY), lambda e: e["ac_power"])
    return rounded(metrics.evaluate(sequences.steps_of(windows.withColumn("p", day)), "y", "p", (PLANT, "split")))


# Learning. Tree fits differ from run to run of other engines, so these have no SQL twin.


def _prepared(spark, sf):
    """Processed rows written once, so that the many passes of a fit do not replay the cleaning."""
    return learn.prepare(cut(split.chrono_split(fx.processed(spark, sf))))


def _fit_report(spark, sf, key, **overrides):
    prepared, names = _prepared(spark, sf)
    fitted = learn.fit_models(prepared, names, [key], {key: overrides})
    return metrics.metrics_report(learn.score(prepared, fitted))


@query
def skipped_rows(spark, sf):
    rows = split.chrono_split(features.add_history(features.add_row_features(fx.joined(spark, sf)), heads="null"))
    return learn.skipped_rows(rows)


@query
def fit_linear(spark, sf):
    return _fit_report(spark, sf, "linear_regression")


@query
def fit_tree(spark, sf):
    return _fit_report(spark, sf, "decision_tree")


@query
def fit_forest(spark, sf):
    # A smaller buffer for node statistics only: eight tasks of two fits must share a default 1 GB heap.
    return _fit_report(spark, sf, "random_forest", maxMemoryInMB=32)


@query
def fit_boosted(spark, sf):
    return _fit_report(spark, sf, "boosted_trees")


LINEAR_FEATURES = ["ambient_temperature", "module_temperature", "irradiation", "om_temperature_2m"]


def _scaled_split(spark, sf, names):
    """Split rows with scaled features, written once."""
    rows = cut(split.chrono_split(fx.processed(spark, sf)))
    return scale.apply_scale(rows, scale.fit_standard(rows.filter("split = 'train'"), names), names)


def _weights(scaled, names, alpha):
    return learn.fit_least_squares(scaled.filter("split = 'train'"), names, alpha=alpha)


def _by_feature(weights, names):
    pairs = [F.struct(F.lit(n).alias("feature"), F.col("weights")[i].alias("weight")) for i, n in enumerate(names)]
    pairs.append(F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("weight")))
    return rounded(weights.select(PLANT, F.inline(F.array(*pairs))), 5)


@query
def linear_weights(spark, sf):
    return _by_feature(_weights(_scaled_split(spark, sf, LINEAR_FEATURES), LINEAR_FEATURES, 0.0), LINEAR_FEATURES)


@query
def ridge_weights(spark, sf):
    names = features.MODEL_FEATURES
    return _by_feature(_weights(_scaled_split(spark, sf, names), names, learn.RIDGE_ALPHA), names)


@query
def fit_ridge(spark, sf):
    names = features.MODEL_FEATURES
    scaled = _scaled_split(spark, sf, names)
    predicted = learn.predict_least_squares(scaled, _weights(scaled, names, learn.RIDGE_ALPHA), names)
    limited = metrics.limit_predictions(predicted).withColumn("model", F.lit("Ridge"))
    return rounded(metrics.metrics_report(limited), 5)


@query
def cv_folds(spark, sf):
    train = fx.capped(spark, sf).filter("split = 'train'")
    return learn.contiguous_folds(train, learn.SEARCH_FOLDS).select(*KEYS, "fold")


def _day_ahead(spark, sf):
    windows = sequences.sequence_windows(split.chrono_split(fx.plant_series(spark, sf)), [PLANT, "split"], TIME)
    return learn.day_ahead_rows(windows, sequences.STEPS_PER_DAY)


@query
def day_ahead_inputs(spark, sf):
    """What the day-ahead model gets, summed up per step."""
    sums = [F.avg(c).alias(c) for c in ("last_value", "mean_value", "day_before", "y")]
    rows = _day_ahead(spark, sf).groupBy(PLANT, "split", "step")
    return rounded(rows.agg(F.count("*").alias("n"), *sums, F.avg(F.col("day_before") * F.col("y")).alias("product")))


SHORT = {"lookback": 2, "horizon": 3}


def _plant_blocks(spark, sf, lookback=sequences.LOOKBACK, horizon=sequences.HORIZON):
    rows = split.chrono_split(fx.plant_series(spark, sf))
    return sequences.series_blocks(rows, [PLANT, "split"], TIME, sequences.SEQUENCE_FEATURES, "ac_power", lookback + horizon)


@query
def day_ahead_weights(spark, sf):
    """Three steps ahead from two readings of the four series: few enough for SQL to solve."""
    train = _plant_blocks(spark, sf, **SHORT).filter("split = 'train'")
    models = dayahead.fit(train, sequences.SEQUENCE_FEATURES, **SHORT)
    pairs = [F.struct(F.lit(f"x{i}").alias("input"), F.col("weights")[i].alias("weight")) for i in range(2 * len(sequences.SEQUENCE_FEATURES))]
    pairs.append(F.struct(F.lit("intercept").alias("input"), F.col("intercept").alias("weight")))
    return rounded(models.select(PLANT, F.col("step").cast("int").alias("step"), "n", F.inline(F.array(*pairs))), 4)


@query
def day_ahead_linear(spark, sf):
    """The 96 next steps at once from two days of four series, beside the value of the day before."""
    blocks = cut(_plant_blocks(spark, sf))
    models = dayahead.fit(blocks.filter("split = 'train'"), sequences.SEQUENCE_FEATURES, alpha=learn.RIDGE_ALPHA * 1000)
    held = blocks.filter("split <> 'train'")
    found = dayahead.predict(held, models, sequences.SEQUENCE_FEATURES, [PLANT, "split"]).withColumn("model", F.lit("Linear, all steps"))
    windows = sequences.cut_windows(held, [PLANT, "split"])
    day = F.transform(F.slice("x", -sequences.STEPS_PER_DAY, sequences.STEPS_PER_DAY), lambda e: e["ac_power"])
    before = windows.select(PLANT, "split", "start_time", "y", day.alias("p"), F.lit("Day before").alias("model"))
    steps = sequences.steps_of(found.unionByName(before))
    return metrics.evaluate(metrics.limit_predictions(steps, "p", None), "y", "p", (PLANT, "split", "model"))


@query
def importance_topk(spark, sf):
    prepared, names = _prepared(spark, sf)
    return reduce(DataFrame.unionByName, map(learn.top_importances, learn.fit_models(prepared, names, ["boosted_trees"])))


def _search(spark, sf, estimator, settings, folds):
    prepared, _ = _prepared(spark, sf)

    def one(plant, rows):
        return learn.search_results(learn.search(rows, estimator, settings, folds), settings, plant)

    return reduce(DataFrame.unionByName, learn.for_each_plant(prepared.filter(F.col("split") == "train"), one))


@query
def search_grid(spark, sf):
    settings = learn.draw_settings({"maxDepth": [4, 8], "minInstancesPerNode": [2, 8]}, draws=4)
    return _search(spark, sf, learn.MODELS["decision_tree"][1](), settings, learn.GRID_FOLDS)


@query
def search_random(spark, sf):
    """The randomized search over the whole space with all its draws and folds, stopped half way and continued."""
    prepared, names = _prepared(spark, sf)
    settings = learn.draw_settings(learn.FOREST_SPACE)
    found = search.Search(prepared, names, learn.MODELS["random_forest"][1](), settings, learn.SEARCH_FOLDS, scratch(spark, "search"))
    found.fill(most=learn.SEARCH_DRAWS * learn.SEARCH_FOLDS)  # half of the fits of two plants
    found.fill()
    return found.summary().drop("seconds_per_fit")


@query
def forecast_day_ahead(spark, sf):
    rows = cut(learn.spread(cut(_day_ahead(spark, sf)), learn.SPREAD_ROWS))

    def one(_, mine):
        model = learn.fit_day_ahead(mine.filter(F.col("split") == "train"))
        predicted = model.transform(learn.assemble_day_ahead(mine.filter(F.col("split") != "train")))
        return metrics.limit_predictions(predicted, learn.PREDICTION, None)

    scored = reduce(DataFrame.unionByName, learn.for_each_plant(rows, one))
    return metrics.evaluate(scored, "y", learn.PREDICTION, (PLANT, "split"))
