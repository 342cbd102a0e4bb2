import datetime as dt

import pytest

from pvspark.functions import physics
from pvspark.operators import metrics as mt
from pvspark.operators import profile
from pvspark.sources import files

T0 = dt.datetime(2024, 1, 1)


def scores(spark, y, p):
    df = spark.createDataFrame([(1, a, b) for a, b in zip(y, p, strict=True)], "plant_id int, y double, p double")
    return mt.evaluate(df, "y", "p").first()


def test_golden_scores(spark):
    r = scores(spark, [10.0, 0.0, 20.0], [9.0, 1.0, 25.0])
    assert (r.r2, r.mae, r.rmse, r.mape) == (pytest.approx(0.865), pytest.approx(7 / 3), pytest.approx(3.0), pytest.approx(17.5))
    r = scores(spark, [1.0, 2.0, 4.0], [2.0, 2.0, 3.0])
    assert (r.r2, r.mae, r.rmse) == (pytest.approx(0.571428571), pytest.approx(2 / 3), pytest.approx(0.816497, abs=1e-6))
    assert r.mape == 0.0


def test_scores_of_a_constant_target(spark):
    assert scores(spark, [7.0, 7.0], [7.0, 8.0]).r2 == 0.0
    assert scores(spark, [7.0, 7.0], [7.0, 7.0]).r2 == 1.0
    assert scores(spark, [7.0], [7.0]).r2 is None


def test_limits(spark):
    df = spark.createDataFrame([(0, 5.0), (1, -3.0), (1, 4.0), (0, -1.0)], "is_day int, prediction double")
    assert [r.prediction for r in mt.limit_predictions(df).collect()] == [0.0, 0.0, 4.0, 0.0]
    assert [r.prediction for r in mt.limit_predictions(df, day_flag=None).collect()] == [5.0, 0.0, 4.0, 0.0]


def board(spark, rows):
    return spark.createDataFrame([(p, m, a, *[v] * 8) for p, m, a, v in rows], files.BOARD_SCHEMA)


def test_upsert(spark):
    old = board(spark, [("Plant 1", "A", None, 1.0), ("Plant 1", "B", None, 2.0), ("Plant 2", "A", "x", 3.0)])
    new = board(spark, [("Plant 1", "A", "me", 9.0)])
    once = mt.upsert_board(old, new)
    got = {(r.plant, r.model): (r.author, r.val_r2) for r in once.collect()}
    assert got == {("Plant 1", "A"): ("me", 9.0), ("Plant 1", "B"): (None, 2.0), ("Plant 2", "A"): ("x", 3.0)}
    again = mt.upsert_board(once, new)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_upsert_accepts_columns_of_one_side(spark):
    old = board(spark, [("Plant 1", "A", "x", 1.0)]).drop("author")
    got = mt.upsert_board(old, board(spark, [("Plant 1", "B", "me", 2.0)]))
    assert {r.model: r.author for r in got.collect()} == {"A": None, "B": "me"}


def test_board_versions(spark, tmp_path):
    path = str(tmp_path / "board")
    assert files.read_board(spark, path).count() == 0
    for value in (1.0, 2.0):
        rows = board(spark, [("Plant 1", "A", "me", value)])
        files.write_board(mt.upsert_board(files.read_board(spark, path), rows), path)
    assert [r.val_r2 for r in files.read_board(spark, path).collect()] == [2.0]


def test_an_unreadable_board_counts_as_empty(spark, tmp_path):
    bad = tmp_path / "board" / "version=1"
    bad.mkdir(parents=True)
    (bad / "part.parquet").write_text("not a table")
    assert files.read_board(spark, str(tmp_path / "board")).count() == 0


def test_preferred_model_ignores_scores(spark):
    rows = board(spark, [("Plant 1", "Random Forest", None, 0.1), ("Plant 1", "Linear Regression", None, 0.9),
                         ("Plant 2", "XGBoost", None, 0.0), ("Plant 2", "Random Forest", None, 1.0), ("Plant 3", "Other", None, 1.0)])
    got = {r.plant: r.model for r in mt.preferred_model(rows).collect()}
    assert got == {"Plant 1": "Random Forest", "Plant 2": "XGBoost"}


def test_report_text(spark, tmp_path):
    long = "Random Forest with Optimized Parameters"
    rows = board(spark, [("Plant 10", "B", None, 1.5), ("Plant 2", "B", None, 1.23456), ("Plant 2", "A", None, 2.0), ("Plant 2", long, None, 1234567890.5)])
    files.write_report_text(mt.report_lines(rows, ["B"]), str(tmp_path / "text"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert lines[0] == mt.REPORT_TITLE and lines[1] == "--- PLANT 2 ---" and lines[2].startswith("[EVALUATION ON VALIDATION")
    assert lines[3].split(" | ")[2].strip() == "MAE (kW)"
    assert [x.split(" | ")[0].strip() for x in lines[4:7]] == ["B", "A", long]
    assert lines[4].endswith("1.2346 |       1.23 |        1.23 |      1.23%")
    assert lines[6] == f"{long} | 1234567890.5000 | 1234567890.50 | 1234567890.50 | 1234567890.50%"
    assert lines[12] == "--- PLANT 10 ---" and len(lines) == 19
    files.write_report_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == rows.columns


def test_forecast_curve(spark):
    rows = [(1, s, T0 + dt.timedelta(hours=h), float(h), float(h) + 1) for s, first in (("b", 0), ("a", 1), ("c", 0)) for h in range(first, 80)]
    df = spark.createDataFrame(rows, "plant_id int, source_key string, date_time timestamp_ntz, ac_power double, prediction double")
    out = mt.forecast_curve(df).collect()
    assert {r.source_key for r in out} == {"b"}
    assert len(out) == 73  # both ends of three days
    assert all(r.predicted == r.actual + 1 for r in out)


def test_nan_is_no_daylight(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (0.5, 3), (0.0, 4)], "irradiation double, i int")
    got = {r.i: r.d for r in df.select("i", physics.is_day().alias("d")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
    assert [r.i for r in profile.sunny(df).collect()] == [3]
    assert profile.daylight(df.withColumnRenamed("irradiation", "ac_power")).count() == 0
