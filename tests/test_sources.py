import datetime as dt
import json
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pvspark.functions import text, timeparse
from pvspark.operators.small import BROADCAST_ROWS, checked_small, join_side
from pvspark.sources import files, publish, weather

T = dt.datetime


def test_golden_time_parsing(spark):
    texts = ["2020-05-15 00:00:00", "2020-05-15", "bad", "15-05-2020 00:00", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    iso = [r[0] for r in df.select(timeparse.parse_time("t", timeparse.ISO)).collect()]
    assert iso == [T(2020, 5, 15), None, None, None, None, None]
    dmy = [r[0] for r in df.select(timeparse.parse_time("t", timeparse.DAY_FIRST)).collect()]
    assert dmy == [None, None, None, T(2020, 5, 15), None, None]


def test_strict_times(spark):
    df = spark.createDataFrame([(T(2020, 1, 1),), (None,)], "t timestamp_ntz")
    assert timeparse.require_times(df.filter("t is not null"), "t", "sensor").count() == 1
    with pytest.raises(PySparkException, match="unreadable t in sensor"):
        timeparse.require_times(df, "t", "sensor").collect()


def test_names(spark):
    names = ["AC_POWER", "om_temperature_2m", "OM_WIND_SPEED_10M", "IRRADIATION"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.display_name(F.col("n"))).collect()]
    assert got == ["Ac Power", "Temperature 2M", "Wind Speed 10M", "Irradiation"]
    row = spark.range(1).select(text.slug(F.lit("Random Forest")), text.decimals(F.lit(1.23456), 2, "%")).first()
    assert row[:] == ("random_forest", "1.23%")


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "g1.csv").write_text(
        "DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER,DAILY_YIELD,TOTAL_YIELD\n"
        "15-05-2020 00:15,4135001,1BY6WEcLGh8j5v7,10.5,1.25,0,6259559\n"
        "bad,4135001,1BY6WEcLGh8j5v7,,NaN,0,6259559\n"
    )
    (tmp_path / "g2.csv").write_text(
        "DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER,DAILY_YIELD,TOTAL_YIELD\n2020-05-15 00:15:00,4136001,4UPUqMRk7TRMgml,1,2,3,4\n"
    )
    (tmp_path / "s1.csv").write_text(
        "DATE_TIME,PLANT_ID,SOURCE_KEY,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE,IRRADIATION\n2020-05-15 00:15:00,4135001,HmiyD2TTLFNqkNe,25.1,22.8,0.5\n"
    )
    return tmp_path


def test_generation_files(spark, inputs):
    df = files.read_generation(spark, {1: f"{inputs}/g1.csv", 2: f"{inputs}/g2.csv"})
    rows = df.orderBy("plant_id", "date_time").collect()
    assert [r.plant_id for r in rows] == [1, 1, 2]
    assert [r.date_time for r in rows] == [None, T(2020, 5, 15, 0, 15), T(2020, 5, 15, 0, 15)]
    assert rows[0].ac_power is None and rows[0].dc_power is None
    assert (rows[1].dc_power, rows[1].total_yield) == (10.5, 6259559.0)


def test_sensor_keeps_its_four_columns(spark, inputs):
    df = files.read_sensor(spark, {1: f"{inputs}/s1.csv"})
    assert df.columns == ["plant_id", "date_time", "ambient_temperature", "module_temperature", "irradiation"]
    assert df.first()[:] == (1, T(2020, 5, 15, 0, 15), 25.1, 22.8, 0.5)


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(files.MissingStage, match="nothing.csv"):
        files.read_generation(spark, {1: f"{tmp_path}/nothing.csv"})
    with pytest.raises(files.MissingStage, match="'cleaned'"):
        files.read_stage(spark, str(tmp_path), "cleaned")
    with pytest.raises(files.MissingStage):
        weather.read_payloads(spark, {1: f"{tmp_path}/none.json"})


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "train", T(2020, 1, 1), 1.5, None), (2, "val", T(2020, 1, 2), 2.5, "x")],
        "plant_id int, split string, date_time timestamp_ntz, v double, s string",
    )
    files.write_stage(df, str(tmp_path), "split", ("plant_id", "split"))
    files.write_stage(df, str(tmp_path), "split", ("plant_id", "split"))
    back = files.read_stage(spark, str(tmp_path), "split").select(*df.columns)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def payload(**changes):
    hourly = {"time": ["2020-05-15T00:00", "2020-05-15T01:00"], **{v: [1.0, 2.0] for v in files.WEATHER_VARIABLES}}
    body = {"timezone": "Asia/Kolkata", "utc_offset_seconds": 19800, "hourly": hourly, **changes}
    return body


def test_payload_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(payload(), indent=1))
    out = weather.hourly_rows(weather.require_good(weather.read_payloads(spark, {2: f"{tmp_path}/p.json"}))).orderBy("date_time")
    rows = out.collect()
    assert [r.date_time for r in rows] == [T(2020, 5, 15), T(2020, 5, 15, 1)]
    assert [r.om_cloud_cover for r in rows] == [1.0, 2.0]
    assert (rows[0].plant_no, rows[0].latitude, rows[0].open_meteo_utc_offset_seconds) == (2, 19.997, 19800)
    with pytest.raises(ValueError, match="unknown plant 3"):
        weather.read_payloads(spark, {3: f"{tmp_path}/p.json"})


def test_faulty_payloads(spark):
    cases = {
        "good": payload(), "limit": payload(error=True, reason="limit"), "nameless": payload(error=True),
        "empty": payload(hourly={}), "none": {"timezone": "x"},
        "gap": payload(hourly={k: v for k, v in payload()["hourly"].items() if k != "cloud_cover"}),
        "short": payload(hourly={**payload()["hourly"], "precipitation": [1.0]}),
    }
    df = spark.createDataFrame([(1, k, json.dumps(v)) for k, v in cases.items()], "plant_no int, name string, body string")
    parsed = weather.parse_payloads(df, "body")
    faults = {r.name: r.fault for r in weather.bad_payloads(parsed).collect()}
    assert faults == {
        "limit": "limit", "nameless": "weather service error", "empty": "no hourly time", "none": "no hourly time",
        "gap": "missing variable: cloud_cover", "short": "wrong length: precipitation",
    }
    assert weather.hourly_rows(parsed).count() == 2
    with pytest.raises(PySparkException, match="missing variable: cloud_cover"):
        weather.require_good(parsed.filter("name = 'gap'")).collect()


def test_small_side_check(spark):
    df = spark.range(10)
    same, n = checked_small(df, 9)
    assert n is None and same is df
    local, n = checked_small(df, 10)
    assert n == 10 and local.count() == 10
    for limit in (5, BROADCAST_ROWS):
        joined = join_side(spark.range(20), df.withColumnRenamed("id", "k").selectExpr("k as id", "k * 2 as v"), ["id"], limit=limit)
        assert joined.filter("v is not null").count() == 10 and joined.count() == 20
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (limit > 5)


def test_one_scan_for_files_of_many_layouts(spark, tmp_path):
    head = "DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER"
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.csv").write_text(f"{head}\n15-05-2020 00:15,1,dev,1.5,2.5\n\n15-05-2020 00:30,1,\"de,v\",3.5,\n")
    (tmp_path / "a b" / "y.csv").write_text("AC_POWER,date_time,SOURCE_KEY,EXTRA\n7,15-05-2020 00:45,other,note\n")
    (tmp_path / "two.csv").write_text(f"{head}\n2020-05-15 00:15:00,2,dev,4,5\n")
    paths = {1: f"{tmp_path}/a b", 2: f"{tmp_path}/two.csv", **{k: f"{tmp_path}/tw*.csv" for k in range(3, 9)}}
    df = files.read_generation(spark, paths)
    rows = {(r.plant_id, r.source_key, r.date_time): (r.dc_power, r.ac_power, r.extra) for r in df.collect()}
    want = {(1, "dev", T(2020, 5, 15, 0, 15)): (1.5, 2.5, None), (1, "de,v", T(2020, 5, 15, 0, 30)): (3.5, None, None), (1, "other", T(2020, 5, 15, 0, 45)): (None, 7.0, "note")}
    assert rows == want | {(k, "dev", T(2020, 5, 15, 0, 15)): (4.0, 5.0, None) for k in range(2, 9)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    (tmp_path / "bare.csv").write_text("2020-05-15 00:15:00,2,dev,4,5\n")
    with pytest.raises(PySparkException, match="no header in .*bare.csv"):
        files.read_generation(spark, {1: f"{tmp_path}/two.csv", 2: f"{tmp_path}/bare.csv"}).collect()


def test_two_writers_of_the_board_both_keep_their_rows(spark, tmp_path):
    path = str(tmp_path / "board")

    def rows(*models):
        return spark.createDataFrame([("Plant 1", m, None, *[1.0] * 8) for m in models], files.BOARD_SCHEMA)

    files.add_to_board(rows("A", "B"), path)
    with ThreadPool(4) as pool:
        pool.map(lambda k: files.add_to_board(rows(f"M{k}", "B"), path), range(4), chunksize=1)
    assert sorted(r.model for r in files.read_board(spark, path).collect()) == ["A", "B", "M0", "M1", "M2", "M3"]
    assert [n for n, _ in publish.published(spark, path)] == [5, 4, 3, 2, 1]


def test_a_manifest_is_made_by_one_writer(spark, tmp_path):
    path = str(tmp_path / "_manifest" / "000000000001")
    with ThreadPool(8) as pool:
        made = pool.map(lambda k: publish.create_if_absent(spark, path, f"{k}\n"), range(16), chunksize=1)
    assert sum(made) == 1 and (tmp_path / "_manifest" / "000000000001").read_text() == f"{made.index(True)}\n"
    assert [p.name for p in (tmp_path / "_manifest").iterdir()] == ["000000000001"]


def test_a_killed_write_leaves_the_old_stage(spark, tmp_path):
    folder = str(tmp_path)
    files.write_stage(spark.range(3).withColumn("plant_id", F.lit(1)), folder, "s")
    began = files.read_stage(spark, folder, "s")
    broken = spark.range(9).withColumn("plant_id", F.when(F.col("id") > 5, F.raise_error(F.lit("killed"))).otherwise(F.lit(1)).cast("int"))
    with pytest.raises(PySparkException, match="killed"):
        files.write_stage(broken, folder, "s")
    assert files.read_stage(spark, folder, "s").count() == 3
    # A stage may be replaced by what is read from it, and readers go on with what they began.
    files.write_stage(files.read_stage(spark, folder, "s").filter("id > 0"), folder, "s")
    assert files.read_stage(spark, folder, "s").count() == 2 and began.count() == 3
    for _ in range(4):
        files.write_stage(files.read_stage(spark, folder, "s"), folder, "s")
    assert len([p for p in (tmp_path / "s").glob("_data-*") if any(p.glob("_SUCCESS"))]) == files.KEPT_STAGES
