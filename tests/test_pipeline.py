import datetime as dt
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.regression import DecisionTreeRegressor

from pvspark.operators import learn
from pvspark.plans import pipeline
from pvspark.sources import files


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """Thirty days of hourly readings of two plants with three devices each, in the input file formats."""
    folder = tmp_path_factory.mktemp("in")
    rng = random.Random(1)
    paths = {"generation": {}, "sensor": {}, "weather": {}}
    for plant in (1, 2):
        fmt = "%d-%m-%Y %H:%M" if plant == 1 else "%Y-%m-%d %H:%M:%S"
        gen = ["DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER,DAILY_YIELD,TOTAL_YIELD"]
        sensor = ["DATE_TIME,PLANT_ID,SOURCE_KEY,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE,IRRADIATION"]
        weather = ["PLANT_NO,DATE_TIME," + ",".join(f"OM_{v.upper()}" for v in files.WEATHER_VARIABLES) + ",LATITUDE"]
        for i in range(30 * 24):
            t = dt.datetime(2020, 5, 15) + dt.timedelta(hours=i)
            irr = max(0.0, math.sin((t.hour - 6) / 12 * math.pi)) * rng.uniform(0.5, 1)
            for d in "ABC":
                gen.append(f"{t.strftime(fmt)},{plant},{d},{irr * 10000},{irr * 1000 * plant},0,0")
            if i % 7:
                sensor.append(f"{t},{plant},S,{20 + 5 * irr},{22 + 30 * irr},{irr}")
            weather.append(f"{plant},{t}," + ",".join(str(rng.uniform(1, 9)) for _ in files.WEATHER_VARIABLES) + ",1.5")
        for kind, lines in (("generation", gen), ("sensor", sensor), ("weather", weather)):
            path = folder / f"{kind}_{plant}.csv"
            path.write_text("\n".join(lines))
            paths[kind][plant] = str(path)
    return pipeline.Inputs(**paths)


def test_from_files_to_leaderboard(spark, inputs, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(files.MissingStage):
        pipeline.feature_step(spark, folder)
    rows = pipeline.run(spark, inputs, folder, ["linear_regression", "decision_tree"])
    assert rows.count() == 4 and all(r.test_r2 > 0.8 for r in rows.collect())
    cleaned = files.read_stage(spark, folder, "cleaned")
    assert cleaned.count() == 2 * 30 * 24 * 3 and "latitude" not in cleaned.columns
    assert cleaned.filter("irradiation is null or om_cloud_cover is null").count() == 0
    assert files.read_stage(spark, folder, "split").filter("split = 'test'").count() == 2 * 3 * 24 * 3
    profile = {p.name for p in (tmp_path / "profile").iterdir()}
    assert {"hist_ac", "correlation", "wind_binned", "humidity_trend", "yield"} <= profile
    assert spark.read.parquet(f"{folder}/forecast_curve").select("plant_id").distinct().count() == 2
    assert {r.n_skipped for r in spark.read.parquet(f"{folder}/skipped_rows").collect()} == {0}
    assert (tmp_path / "models" / "plant_2_decision_tree").exists()

    pipeline.model_step(spark, folder, ["decision_tree"], {"decision_tree": {"maxDepth": 2}}, author="me")
    board = {(r.plant, r.model): r.author for r in files.read_board(spark, f"{folder}/board").collect()}
    assert len(board) == 4 and board["Plant 1", "Decision Tree"] == "me" and board["Plant 1", "Linear Regression"] is None

    assert spark.read.parquet(f"{folder}/importances").filter("importance > 0").count() > 0

    own = {"My Tree": DecisionTreeRegressor(featuresCol=learn.VECTOR, labelCol="_label", predictionCol=learn.PREDICTION, maxDepth=3)}
    best = pipeline.tuned(spark, folder, "decision_tree", [{"maxDepth": 1}, {"maxDepth": 6}], 2, "Tuned Tree")
    rows = pipeline.model_step(spark, folder, ["ridge"], estimators=own, extra=best)
    assert {(r.plant, r.model) for r in rows.collect()} == {(f"Plant {k}", m) for k in (1, 2) for m in ("Ridge", "My Tree", "Tuned Tree")}
    assert all(r.test_r2 > 0.8 for r in rows.collect()) and files.read_board(spark, f"{folder}/board").count() == 10

    newest = max((tmp_path / "board").glob("version=*"), key=lambda p: int(p.name.partition("=")[2]))
    for part in newest.glob("*.parquet"):
        part.write_bytes(b"damaged")
    assert files.read_board(spark, f"{folder}/board").count() == 4  # the version before



def payload(hours, **more):
    times = [f"2020-05-15T{h:02d}:00" for h in range(hours)]
    hourly = {"time": times, **{v: [float(h + k) for h in range(hours)] for k, v in enumerate(files.WEATHER_VARIABLES)}}
    return {"timezone": "Asia/Kolkata", "utc_offset_seconds": 19800, "hourly": {**hourly, **more}}


def test_from_payload_to_grid(spark, tmp_path):
    paths = {}
    for plant in (1, 7):
        paths[plant] = str(tmp_path / f"{plant}.json")
        (tmp_path / f"{plant}.json").write_text(json.dumps(payload(5)))
    folder, span = str(tmp_path / "out"), ("2020-05-15 00:00:00", "2020-05-15 04:00:00")
    with pytest.raises(ValueError, match="unknown plant 7"):
        pipeline.weather_step(spark, paths, folder, *span)
    pipeline.weather_step(spark, paths, folder, *span, coordinates={1: (14.8, 78.3), 7: (1.0, 2.0)})
    rows = files.read_stage(spark, folder, "weather").filter("plant_no = 7").orderBy("date_time").collect()
    assert len(rows) == 17 and rows[1].om_temperature_2m == 0.25 and rows[16].om_sunshine_duration == 18.0
    assert {(r.latitude, r.longitude, r.open_meteo_utc_offset_seconds) for r in rows} == {(1.0, 2.0, 19800)}
    (tmp_path / "1.json").write_text(json.dumps(payload(5, time=["never"] * 5)))
    with pytest.raises(PySparkException, match="unreadable date_time"):
        pipeline.weather_step(spark, {1: paths[1]}, folder, *span)
    (tmp_path / "1.json").write_text(json.dumps(payload(5, cloud_cover=[1.0])))
    with pytest.raises(PySparkException, match="wrong length: cloud_cover"):
        pipeline.weather_step(spark, {1: paths[1]}, folder, *span)


def test_day_ahead_step(spark, tmp_path):
    start = dt.datetime(2020, 5, 15)
    rows = [(1, s, start + dt.timedelta(minutes=15 * i), float(i % 96), split) for split, n in (("train", 330), ("val", 290)) for i in range(n) for s in "ab"]
    df = spark.createDataFrame(rows, "plant_id int, source_key string, date_time timestamp_ntz, ac_power double, split string")
    files.write_stage(df, str(tmp_path), "split", ("plant_id", "split"))
    scores = pipeline.day_ahead_step(spark, str(tmp_path), maxIter=3, maxDepth=3).collect()
    assert [(r.plant_id, r.split) for r in scores] == [(1, "val")] and scores[0].r2 > 0.5
