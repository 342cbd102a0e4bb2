"""Input CSV files, stage tables and reports."""

from __future__ import annotations

import re
import time
from urllib.parse import unquote_plus

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.functions.timeparse import DAY_FIRST, ISO, parse_by_plant, parse_time
from pvspark.operators.clean import PLANT, SENSOR_COLS, SOURCE, TIME
from pvspark.operators.metrics import upsert_board
from pvspark.operators.small import checked_small, join_side
from pvspark.session import cut
from pvspark.sources.publish import file_system, newest, publish, published

# Columns of the input files.
GENERATION_MEASURES = ["dc_power", "ac_power", "daily_yield", "total_yield"]
WEATHER_VARIABLES = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature", "pressure_msl",
    "surface_pressure", "precipitation", "cloud_cover", "wind_speed_10m", "wind_direction_10m",
    "shortwave_radiation", "direct_radiation", "diffuse_radiation", "direct_normal_irradiance", "sunshine_duration",
]
WEATHER_COLS = [f"om_{v}" for v in WEATHER_VARIABLES]


#: Versions of a stage table that are kept.
KEPT_STAGES = 3


class MissingStage(FileNotFoundError):
    """An earlier stage has not written its output yet."""


def number(col: str) -> Column:
    """Text to double; blanks, NaN and anything unreadable become null."""
    v = F.col(col).try_cast("double")
    return F.when(~F.isnan(v), v)


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _typed(df: DataFrame, measures: list[str], instant: Column, plant: int | Column) -> DataFrame:
    """Text columns to types. Columns beyond the known ones stay text."""
    plant = plant if isinstance(plant, Column) else F.lit(plant)
    out = df.withColumns({TIME: instant, PLANT: plant.cast("int")})
    return out.withColumns({m: number(m) for m in measures if m in df.columns})


def type_generation(text: DataFrame, plant: int | Column, day_first_plants: tuple[int, ...] = (1,)) -> DataFrame:
    """Raw generation text of a plant (or several, told apart by a column) → typed rows."""
    text = _lower(text)
    plant_col = plant if isinstance(plant, Column) else F.lit(plant)
    return _typed(text, GENERATION_MEASURES, parse_by_plant(TIME, plant_col, day_first_plants), plant_col)


def type_sensor(text: DataFrame, plant: int | Column) -> DataFrame:
    return _typed(_lower(text), SENSOR_COLS, parse_time(TIME, ISO), plant)


def type_weather(text: DataFrame, plant: int | Column) -> DataFrame:
    return _typed(_lower(text), [*WEATHER_COLS, "latitude", "longitude"], parse_time(TIME, ISO), plant)


def _plant_files(spark: SparkSession, paths: dict[int, str]) -> tuple[list[str], list[tuple[str, int]]]:
    """The files and folders that `paths` name (which may be patterns), and the plants of every file in them."""
    roots: list[tuple[str, int]] = []
    for plant, path in sorted(paths.items()):
        fs, place = file_system(spark, path)
        found = fs.globStatus(place)
        if not found:
            raise MissingStage(f"no input at {path}")
        roots += [(s.getPath().toString(), plant) for s in found]
    places = list(dict.fromkeys(r for r, _ in roots))
    plants: dict[str, list[int]] = {}
    for root, plant in roots:
        plants.setdefault(_plain(root), []).append(plant)
    rows = []
    for file in spark.read.text(places).inputFiles():
        # A file belongs to the folder it lies in, or to one above.
        part = _plain(file)
        while part and part not in plants:
            part = part.rpartition("/")[0]
        rows += [(_plain(file), plant) for plant in plants.get(part, [])]
    return places, rows


def _plain(uri: str) -> str:
    """An address as `_plain_column` writes it: addresses of a file differ in slashes and escapes."""
    return re.sub("^([^:/]+):/+", r"\1:/", unquote_plus(uri)).rstrip("/")


def _plain_column(uri: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_url_decode(uri), uri), "^([^:/]+):/+", "$1:/")


#: Column of the plant that a file belongs to.
_OF = "_plant"


def read_plant_files(spark: SparkSession, paths: dict[int, str], time: str = TIME) -> DataFrame:
    """The text columns of the CSV files of all plants, and `_plant`: one scan, however many plants and files there are.

    Each file's columns are told by its own header: the line that names the time column. Headers are found by one more scan. A file has no
    line breaks inside quotes. Lines of a file without a header make the job fail.
    """
    places, rows = _plant_files(spark, paths)
    plants = spark.createDataFrame(rows, f"_file string, {_OF} int")
    lines = spark.read.text(places).select(_plain_column(F.col("_metadata.file_path")).alias("_file"), F.col("value").alias("_line")).filter("trim(_line) <> ''")
    fields = F.transform(F.split(F.regexp_replace("_line", '["\ufeff]', ""), ","), lambda c: F.lower(F.trim(c)))
    named = lines.filter(F.lower("_line").contains(time)).select("_file", fields.alias("_names")).filter(F.array_contains("_names", time))
    # One row per file.
    headers = cut(named.groupBy("_file").agg(F.first("_names").alias("_names")))
    layouts = [r[0] for r in headers.select("_names").distinct().collect()]  # one row per layout
    columns = list(dict.fromkeys(c for names in sorted(layouts) for c in names))
    most = max(map(len, layouts), default=1)
    at = F.array(*[F.array_position("_names", F.lit(c)).cast("int") for c in columns]) if columns else F.array().cast("array<int>")
    of = join_side(plants, headers.select("_file", at.alias("_at")), ["_file"], rows=len(rows))
    text = F.from_csv("_line", ", ".join(f"c{i} string" for i in range(most)))
    got = join_side(lines, of, ["_file"], "inner", rows=len(rows))
    known = F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("no header in "), F.col("_file")))).otherwise(text)
    got = got.select(_OF, "_at", known.alias("_c"))
    values = F.array(*[F.col("_c")[f"c{i}"] for i in range(most)])
    got = got.select(_OF, *[F.when(F.col("_at")[k] > 0, F.get(values, F.col("_at")[k] - 1)).alias(c) for k, c in enumerate(columns)])
    return got.filter(F.coalesce(F.lower(F.trim(time)) != time, F.lit(True))) if columns else got


def read_generation(spark: SparkSession, paths: dict[int, str], day_first_plants: tuple[int, ...] = (1,)) -> DataFrame:
    """One table from the generation files of all plants."""
    return type_generation(read_plant_files(spark, paths), F.col(_OF), day_first_plants).drop(_OF)


def read_sensor(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    return type_sensor(read_plant_files(spark, paths), F.col(_OF)).select(PLANT, TIME, *SENSOR_COLS)


def read_weather(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    return type_weather(read_plant_files(spark, paths), F.col(_OF)).drop(_OF)


def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """A stage table written by `write_stage`; types come back as they were."""
    try:
        return spark.read.parquet(newest(spark, f"{folder}/{stage}") or f"{folder}/{stage}")
    except AnalysisException as e:
        raise MissingStage(f"stage {stage!r} has no output in {folder}: run it first") from e


def write_stage(df: DataFrame, folder: str, stage: str, partitions: tuple[str, ...] = (PLANT,)) -> None:
    """Replace a stage table as a whole. The rebalance splits a dominant plant over many files of even size.

    Readers see the old table until the new one is complete, and those that have begun may read it on for two more writes.
    """
    even = df.hint("rebalance", *[F.col(c) for c in partitions])
    publish(df.sparkSession, f"{folder}/{stage}", lambda _, to: even.write.partitionBy(*partitions).parquet(to), keep=KEPT_STAGES)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


BOARD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("plant", "model", "author")]
    + [T.StructField(f"{s}_{m}", T.DoubleType()) for s in ("val", "test") for m in ("r2", "mae", "rmse", "mape")]
)


def _board_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the board's versions, newest first; none if there is no board. Failures of the storage are raised."""
    found = published(spark, path)
    if found:
        return [folder for _, folder in found]
    fs, place = file_system(spark, path)  # a board from before there were manifests
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("version=")]
    return [f"{path}/{n}" for n in sorted(names, key=lambda n: -int(n.partition("=")[2]))]


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """The newest leaderboard version that can be read, or an empty board if there is none."""
    for version in _board_versions(spark, path):
        try:
            board = spark.read.parquet(version)
            board.count()
        except (PySparkException, Py4JJavaError):  # empty or damaged: an older one is better than none
            continue
        return board
    return spark.createDataFrame([], BOARD_SCHEMA)


def _write_version(board: DataFrame, folder: str) -> None:
    # A board has one row per plant and model.
    board.coalesce(1).write.parquet(folder)


def _version_name() -> str:
    return f"version={time.time_ns()}"


def write_board(df: DataFrame, path: str) -> None:
    """Make `df` the newest version of the board. Rows that others add meanwhile are not in it; `add_to_board` keeps them."""
    publish(df.sparkSession, path, lambda _, to: _write_version(df, to), _version_name)


def add_to_board(new: DataFrame, path: str) -> None:
    """Upsert rows into the newest board. Of writers at the same time each one's rows stay: who comes second starts again from the first one's board."""
    spark = new.sparkSession
    new, _ = checked_small(new)  # evaluated once, however often it is tried

    def write(base: str | None, to: str) -> None:
        _write_version(upsert_board(read_board(spark, path), new), to)

    publish(spark, path, write, _version_name)


def write_report_csv(board: DataFrame, path: str) -> None:
    board.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report_text(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def csv_lines(df: DataFrame, plant: str = PLANT, when: str = TIME, day_first_plants: tuple[int, ...] = (1,)) -> DataFrame:
    """Rows as the text lines of an input file, in each plant's own time format."""
    stamp = F.when(F.col(plant).isin(*day_first_plants), F.date_format(when, DAY_FIRST)).otherwise(F.date_format(when, ISO))
    return df.withColumn(when, stamp).select(plant, F.to_csv(F.struct(*df.columns)).alias("line"))


def parse_lines(lines: DataFrame, columns: list[str], line: str = "line") -> DataFrame:
    """CSV text lines → text columns."""
    schema = ", ".join(f"{c} string" for c in columns)
    return lines.select(F.from_csv(line, schema).alias("_r")).select("_r.*")
