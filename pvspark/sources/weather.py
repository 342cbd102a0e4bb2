"""Saved hourly weather payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.functions.timeparse import parse_time
from pvspark.operators.clean import TIME
from pvspark.sources.files import WEATHER_VARIABLES, MissingStage

# Plant coordinates and the time format of the payload.
PLANT_COORDINATES = {1: (14.815, 78.287), 2: (19.997, 73.790)}
PAYLOAD_TIME = "yyyy-MM-dd'T'HH:mm"

PAYLOAD = (
    "error boolean, reason string, timezone string, utc_offset_seconds int, hourly struct<time: array<string>, "
    + ", ".join(f"{v}: array<double>" for v in WEATHER_VARIABLES)
    + ">"
)


def read_payloads(spark: SparkSession, paths: dict[int, str], coordinates: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """One row per saved response, with its plant, which must have coordinates."""
    out = None
    for plant, path in sorted(paths.items()):
        if plant not in (PLANT_COORDINATES if coordinates is None else coordinates):
            raise ValueError(f"unknown plant {plant}")
        try:
            part = spark.read.schema(PAYLOAD).json(path, multiLine=True).withColumn("plant_no", F.lit(plant))
        except AnalysisException as e:
            raise MissingStage(f"no payload at {path}") from e
        out = part if out is None else out.unionByName(part)
    return out


def parse_payloads(text: DataFrame, col: str) -> DataFrame:
    """Payloads held as JSON text in a column."""
    rest = [c for c in text.columns if c != col]
    return text.select(*rest, F.from_json(col, PAYLOAD).alias("_p")).select(*rest, "_p.*")


def fault() -> Column:
    """Why a payload cannot be used; null for a good one. The first failing check is named."""
    time = F.col("hourly.time")
    checks = [
        F.when(F.col("error"), F.coalesce(F.col("reason"), F.lit("weather service error"))),
        F.when(time.isNull(), F.lit("no hourly time")),
    ]
    for v in WEATHER_VARIABLES:
        checks.append(F.when(F.col(f"hourly.{v}").isNull(), F.lit(f"missing variable: {v}")))
    for v in WEATHER_VARIABLES:
        checks.append(F.when(F.size(f"hourly.{v}") != F.size(time), F.lit(f"wrong length: {v}")))
    return F.coalesce(*checks)


def bad_payloads(payloads: DataFrame) -> DataFrame:
    """Quarantine: the unusable payloads with their `fault`."""
    return payloads.withColumn("fault", fault()).filter(F.col("fault").isNotNull()).drop("hourly")


def require_good(payloads: DataFrame) -> DataFrame:
    """Fail the job at the first unusable payload."""
    found = fault()
    return payloads.withColumn("hourly", F.when(F.assert_true(found.isNull(), found).isNull(), F.col("hourly")))


#: Columns of the stage table, in order.
STAGE_COLS = [
    "plant_no", TIME, *[f"om_{v}" for v in WEATHER_VARIABLES], "latitude", "longitude", "open_meteo_timezone", "open_meteo_utc_offset_seconds",
]


def hourly_rows(payloads: DataFrame, coordinates: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Good payloads as one row per hour, variables named om_*, metadata repeated. Plants without coordinates have null ones."""
    places = PLANT_COORDINATES if coordinates is None else coordinates
    good = payloads.filter(fault().isNull())
    zipped = F.arrays_zip("hourly.time", *[f"hourly.{v}" for v in WEATHER_VARIABLES])
    rows = good.select("plant_no", "timezone", "utc_offset_seconds", F.explode(zipped).alias("_h"))
    lat = F.create_map(*[F.lit(x) for p, (la, _) in places.items() for x in (p, la)])
    lon = F.create_map(*[F.lit(x) for p, (_, lo) in places.items() for x in (p, lo)])
    return rows.select(
        "plant_no", parse_time(F.col("_h.time"), PAYLOAD_TIME).alias(TIME),
        *[F.col(f"_h.{v}").alias(f"om_{v}") for v in WEATHER_VARIABLES],
        F.try_element_at(lat, "plant_no").alias("latitude"), F.try_element_at(lon, "plant_no").alias("longitude"),
        F.col("timezone").alias("open_meteo_timezone"),
        F.col("utc_offset_seconds").alias("open_meteo_utc_offset_seconds"),
    )
