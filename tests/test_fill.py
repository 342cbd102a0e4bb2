import datetime as dt

import pytest
from pyspark.sql import functions as F

from pvspark.operators import fill
from pvspark.operators.clean import available, clean, columns_with_prefix, drop_bad_times, join_weather
from pvspark.operators.series import segments

T0 = dt.datetime(2024, 1, 1, 5, 45)
STEP = dt.timedelta(minutes=15)


def line(spark, values, key=1):
    return spark.createDataFrame([(key, T0 + i * STEP, v) for i, v in enumerate(values)], "p int, t timestamp_ntz, v double")


def values(df, order=("p", "t"), col="v"):
    return [r[col] for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("by", ["time", "row"])
def test_golden_interpolation(spark, by):
    df = line(spark, [None, 1.0, None, None, 4.0, None])
    assert values(fill.fill_linear(df, ["p"], ["t"], ["v"], by)) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_all_null_and_empty(spark):
    assert values(fill.fill_linear(line(spark, [None, None]), ["p"], ["t"], ["v"])) == [None, None]
    assert fill.fill_linear(line(spark, [1.0]).filter("false"), ["p"], ["t"], ["v"]).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        fill.fill_linear(line(spark, [1.0]), ["p"], ["t"], ["v"], "column")


def frames(spark, groups, kind="string"):
    rows = [(1, k, T0 + i * STEP, v) for k, vs in groups for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"g int, k {kind}, t timestamp_ntz, v double")


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_golden_carry(spark, max_rows):
    df = frames(spark, [("a", [None, 5.0]), ("b", [None]), ("c", [7.0])])
    cut = fill.fill_edges(segments(df, ["g", "k"], ["t"], max_rows=max_rows), ["v"])
    out = fill.carry_between_series(cut.own_rows(), ["g"], "k", "t", ["v"], max_rows)
    assert values(out, ("k", "t")) == [5.0, 5.0, 5.0, 7.0]


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_carry_over_numeric_keys_skips_empty_series(spark, max_rows):
    df = frames(spark, [(9, [None]), (10, [1.0, None]), (11, [None]), (100, [None, None]), (101, [3.0])], "long")
    cut = fill.fill_edges(segments(df, ["g", "k"], ["t"], max_rows=max_rows), ["v"])
    out = fill.carry_between_series(cut.own_rows(), ["g"], "k", "t", ["v"], max_rows)
    assert values(out, ("k", "t")) == [None, 1.0, 1.0, 1.0, 1.0, 1.0, 3.0]


def test_grid_includes_both_ends_and_drops_readings_off_it(spark):
    spans = spark.createDataFrame([(1, T0, T0 + 4 * STEP)], "p int, a timestamp_ntz, b timestamp_ntz")
    grid = fill.time_grid(spans, ["p"], "a", "b", "t")
    assert grid.count() == 5
    hourly = spark.createDataFrame(
        [(1, T0, 0.0, "z"), (1, T0 + 4 * STEP, 8.0, "z"), (1, T0 + STEP / 2, 99.0, "z")], "p int, t timestamp_ntz, v double, zone string"
    )
    out = fill.align_to_grid(hourly, grid, ["p"], "t", ["v"], ["zone"])
    assert values(out) == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert out.select("zone").distinct().count() == 1


def plant(spark):
    gen = [(1, s, T0 + i * STEP, 10.0 * i, 1.0 * i) for i in range(5) for s in ("x", "y")]
    gen = spark.createDataFrame(gen, "plant_id int, source_key string, date_time timestamp_ntz, dc_power double, ac_power double")
    sensor = spark.createDataFrame(
        [(1, T0, 20.0, 30.0, 0.0), (1, T0 + 4 * STEP, 24.0, 38.0, 0.4)],
        "plant_id int, date_time timestamp_ntz, ambient_temperature double, module_temperature double, irradiation double",
    )
    return gen, sensor


def test_fill_by_time_gives_devices_the_same_weather(spark):
    out = clean(*plant(spark)).collect()
    assert len(out) == 10
    assert all(r.ambient_temperature == pytest.approx(20 + r.ac_power) for r in out)


def test_fill_by_row_counts_joined_rows(spark):
    gen, sensor = plant(spark)
    out = clean(gen, sensor, fill="row").orderBy("date_time", "source_key").collect()
    # Rows 1, 2 and 9, 10 are known; the six between them climb by 4 / 7 each.
    want = [20.0, 20.0] + [20 + 4 * k / 7 for k in range(1, 7)] + [24.0, 24.0]
    assert [r.ambient_temperature for r in out] == pytest.approx(want)


@pytest.mark.parametrize("mode", ["time", "row"])
def test_fill_does_not_depend_on_the_cut(spark, mode):
    gen, sensor = plant(spark)
    a = clean(gen, sensor, fill=mode).orderBy("date_time", "source_key").collect()
    b = clean(gen, sensor, fill=mode, max_rows=2).orderBy("date_time", "source_key").collect()
    assert [r.irradiation for r in a] == pytest.approx([r.irradiation for r in b])


def test_duplicate_sensor_instants_multiply_rows(spark):
    gen, sensor = plant(spark)
    assert join_weather(gen, sensor.union(sensor)).count() == 14


def test_bad_times_and_dynamic_columns(spark):
    gen, _ = plant(spark)
    broken = gen.withColumn("date_time", F.when(F.col("source_key") == "x", F.col("date_time")))
    assert drop_bad_times(broken).count() == 5
    df = spark.createDataFrame([(1, 2, 3)], "OM_A int, b int, om_c int")
    assert columns_with_prefix(df, "om_") == ["OM_A", "om_c"]
    assert available(df, ["om_c", "nope", "b"]) == ["om_c", "b"]
