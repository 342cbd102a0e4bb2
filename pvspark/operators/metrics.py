"""Scores of limited predictions, the report and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvspark.functions.physics import limited
from pvspark.operators.clean import PLANT, SOURCE, TIME
from pvspark.operators.small import checked_small

# Smallest power that enters the percentage error, board columns, model preference.
MAPE_FLOOR = 5.0
BOARD_KEYS = ["plant", "model"]
METRICS = ["r2", "mae", "rmse", "mape"]
BOARD_METRICS = [f"{s}_{m}" for s in ("val", "test") for m in METRICS]
MODEL_PRIORITY = ["Boosted Trees", "XGBoost", "Random Forest", "Linear Regression"]


def limit_predictions(df: DataFrame, prediction: str = "prediction", day_flag: str | None = "is_day") -> DataFrame:
    return df.withColumn(prediction, limited(prediction, day_flag))


def metric_columns(y: str, p: str, where: Column | None = None, prefix: str = "") -> list[Column]:
    """R², MAE, RMSE and daytime MAPE over the rows selected by `where`, as aggregates of one pass.

    A constant target gives R² 1 when every prediction is exact and 0 otherwise; fewer than two rows give null.
    """
    use = F.col(y).isNotNull() & F.col(p).isNotNull()
    use = use if where is None else use & where
    t, e = F.when(use, F.col(y)), F.when(use, F.col(y) - F.col(p))
    n, sse = F.count(t), F.sum(e * e)
    flat = F.max(t) == F.min(t)
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(flat, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.try_divide(sse, F.var_pop(t) * n))
    )
    share = F.abs(F.try_divide(F.when(use & (F.col(y) > MAPE_FLOOR), F.col(y) - F.col(p)), F.col(y)))
    return [
        r2.alias(f"{prefix}r2"), F.avg(F.abs(e)).alias(f"{prefix}mae"), F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        (F.coalesce(F.avg(share), F.lit(0.0)) * 100).alias(f"{prefix}mape"),
    ]


def evaluate(df: DataFrame, y: str = "ac_power", p: str = "prediction", by: tuple[str, ...] = (PLANT,)) -> DataFrame:
    """Scores per group; `p` must be limited already."""
    return df.groupBy(*by).agg(*metric_columns(y, p))


def metrics_report(
    scored: DataFrame, y: str = "ac_power", p: str = "prediction", plant: str = PLANT, model: str = "model"
) -> DataFrame:
    """One board row per plant and model with the scores of both holdout splits."""
    aggs = [c for s in ("val", "test") for c in metric_columns(y, p, F.col("split") == s, f"{s}_")]
    rows = scored.filter(F.col("split").isin("val", "test")).groupBy(plant, model).agg(*aggs)
    name = F.concat(F.lit("Plant "), F.col(plant).cast("string"))
    return rows.select(name.alias("plant"), F.col(model).alias("model"), *BOARD_METRICS)


def upsert_board(board: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` replace those with the same plant and model; columns known to one side only stay.

    Both sides are read once: of the rows of a plant and model the newest side stays, one window over a board of one row each.
    """
    both = board.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    last = F.max("_side").over(Window.partitionBy(*BOARD_KEYS))
    return both.withColumn("_last", last).filter("_side = _last").drop("_side", "_last")


def preferred_model(board: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """The first listed model each plant has a score for, whatever its score."""
    priority = priority or MODEL_PRIORITY
    place = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("model"))
    return (
        board.withColumn("_place", place).filter("_place > 0").groupBy("plant")
        .agg(F.min_by("model", "_place").alias("model"))
    )


# Texts of the report.
REPORT_TITLE = "SOLAR POWER MODELS: METRICS REPORT"
BLOCK_TITLES = ["[EVALUATION ON VALIDATION SET]", "[EVALUATION ON TEST SET (HOLDOUT FUTURE)]"]
REPORT_COLUMNS = "Model                  |         R2 |   MAE (kW) |   RMSE (kW) |   MAPE (%)"


def report_lines(board: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The text report: title, and per plant a validation and a test block with column names, as (line_no, line).

    Plants are in the order of their numbers, models in the order of `models`, others behind them by name. Texts that are
    wider than their column widen it. The board has one row per plant and model, so ordering it as a whole is cheap.
    """
    from pvspark.operators.series import row_index

    def row(split: str) -> Column:
        scores = [f"{split}_{m}" for m in METRICS]
        return F.format_string("%-22s | %10.4f | %10.2f | %11.2f | %9.2f%%", "model", *scores)

    def line(block: int, kind: int, place: Column, model: Column, text: Column) -> Column:
        return F.struct(F.lit(block).alias("block"), F.lit(kind).alias("kind"), place.alias("place"), model.alias("model"), text.alias("line"))

    none, first, listed = F.lit(""), F.lit(0), models or []
    heads = [line(0, 0, first, none, F.concat(F.lit("--- "), F.upper("plant"), F.lit(" ---")))]
    for k, title in enumerate(BLOCK_TITLES, 1):
        heads += [line(k, 0, first, none, F.lit(title)), line(k, 1, first, none, F.lit(REPORT_COLUMNS))]
    place = F.array_position(F.array(*[F.lit(m) for m in listed]).cast("array<string>"), F.col("model"))
    place = F.when(place > 0, place).otherwise(len(listed) + 1).cast("int")
    body = [line(k, 2, place, F.col("model"), row(split)) for k, split in enumerate(("val", "test"), 1)]
    lines = board.select("plant").distinct().select("plant", F.inline(F.array(*heads)))
    lines = lines.unionByName(board.select("plant", F.inline(F.array(*body))))
    number = F.regexp_extract("plant", "([0-9]+)$", 1).try_cast("long")
    lines = lines.withColumns({"_all": F.lit(0), "_number": number})
    order = ["_number", "plant", "block", "kind", "place", "model"]
    numbered = row_index(lines, ["_all"], order, "line_no").select((F.col("line_no") + 1).alias("line_no"), "line")
    title = board.sparkSession.createDataFrame([(1, REPORT_TITLE)], "line_no long, line string")
    return title.unionByName(numbered.select(F.col("line_no").cast("long").alias("line_no"), "line"))


def forecast_curve(
    scored: DataFrame, days: int = 3, plant: str = PLANT, source: str = SOURCE, time: str = TIME,
    y: str = "ac_power", p: str = "prediction",
) -> DataFrame:
    """Actual and predicted power of each plant's first test device over its first `days` days."""
    start, _ = checked_small(scored.groupBy(plant).agg(F.min(time).alias("_start")))
    # One row per plant; the sample is a selective join, not a per-plant window.
    first = scored.join(start, plant).filter(F.col(time) == F.col("_start")).groupBy(plant, "_start").agg(F.min(source).alias(source))
    first, _ = checked_small(first)
    end = F.col("_start") + F.expr(f"interval {days} days")
    return (
        scored.join(first, [plant, source])
        .filter(F.col(time).between(F.col("_start"), end))
        .select(plant, source, time, F.col(y).alias("actual"), F.col(p).alias("predicted"))
    )
