import datetime as dt
import math
import random
import statistics

import pandas as pd
import pytest

from pvspark.operators import features as ft
from pvspark.operators import sequences as sq
from pvspark.operators.series import segments
from pvspark.operators.split import chrono_split, split_report

T0 = dt.datetime(2024, 1, 1, 5, 45)
STEP = dt.timedelta(minutes=15)
SCHEMA = (
    "plant_id int, source_key string, date_time timestamp_ntz, dc_power double, ac_power double, "
    "ambient_temperature double, module_temperature double, irradiation double"
)


def cleaned(spark, sizes, gaps=0.0, seed=3):
    rng = random.Random(seed)
    rows = []
    for key, n in sizes.items():
        for i in range(n):
            irr = None if rng.random() < gaps else round(max(0.0, math.sin(i / 9)) * rng.random(), 5)
            temp = None if rng.random() < gaps else 20 + rng.random()
            rows.append((1, key, T0 + i * STEP, 10.0 * i, 1.0 * i, temp, None if temp is None else temp + 5, irr))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def expected(pdf, scope):
    """Lags and rolling values from list slices by their definition, then the nearest known value of the device."""
    parts = []
    for _, rows in pdf.sort_values(["source_key", "date_time"]).groupby("source_key"):
        rows = rows.reset_index(drop=True)
        history = {new: [None] * n + rows[col].tolist()[: max(0, len(rows) - n)] for new, col, n in ft.LAGS}
        history = {new: values[: len(rows)] for new, values in history.items()}
        before = [rows["irradiation"].tolist()[max(0, i - 4) : i] for i in range(len(rows))]
        whole = [w if len(w) == 4 and not any(math.isnan(x) for x in w) else None for w in before]
        history[ft.ROLL_MEAN] = [statistics.mean(w) if w else None for w in whole]
        history[ft.ROLL_STD] = [statistics.stdev(w) if w else None for w in whole]
        parts.append(rows.assign(**{c: pd.Series(v, dtype=float) for c, v in history.items()}))
    if scope is not None:
        for c in ft.HISTORY:
            carried = float("nan")
            for rows in parts:
                values = rows[c].tolist()
                later = float("nan")
                for i in reversed(range(len(values))):
                    later = values[i] = values[i] if not math.isnan(values[i]) else later
                earlier = carried if scope == "carry" else float("nan")
                for i in range(len(values)):
                    earlier = values[i] = values[i] if not math.isnan(values[i]) else earlier
                carried = values[-1]
                rows[c] = values
    return pd.concat(parts, ignore_index=True)


def actual(df):
    return df.toPandas().sort_values(["source_key", "date_time"]).reset_index(drop=True)


def same(got, want):
    pd.testing.assert_frame_equal(got[ft.HISTORY], want[ft.HISTORY].astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("max_rows", [8, 1000])
@pytest.mark.parametrize("scope", [None, "group", "carry"])
def test_history_against_pandas(spark, scope, max_rows):
    df = cleaned(spark, {"a": 3, "b": 90, "c": 1, "d": 12}, gaps=0.25)
    out = ft.add_history(df, heads="null" if scope is None else "fill", scope=scope or "group", max_rows=max_rows)
    same(actual(out), expected(df.toPandas(), scope))


def test_golden_rolling(spark):
    rows = [(1, i, float(2**i)) for i in range(6)]
    cut = segments(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], ["t"], before=4)
    out = ft.rolled(cut, "v", 4, "m", "s").own_rows().orderBy("t").collect()
    assert [r.m for r in out] == [None] * 4 + [3.75, 7.5]
    assert [r.s for r in out][4:] == pytest.approx([3.095695936834452, 6.191391873668904])


def test_heads_drop(spark):
    out = ft.add_history(cleaned(spark, {"a": 10, "b": 4}), heads="drop")
    assert out.groupBy("source_key").count().collect() == [("a", 6)]


def test_devices_are_independent_unless_carried(spark):
    df = cleaned(spark, {"a": 8, "b": 2})
    alone = df.filter("source_key = 'b'")
    group = actual(ft.add_history(df).filter("source_key = 'b'"))
    same(group, actual(ft.add_history(alone)))
    carried = actual(ft.add_history(df, scope="carry").filter("source_key = 'b'"))
    assert carried[ft.ROLL_MEAN].notna().all() and group[ft.ROLL_MEAN].isna().all()


def test_row_features_and_night_cap(spark):
    rows = [(1, "a", T0 + i * STEP, 50.0, 5.0, 20.0, 26.0, irr) for i, irr in enumerate([None, 1e-4, 2e-4])]
    df = ft.cap_at_night(ft.add_row_features(spark.createDataFrame(rows, SCHEMA)))
    out = df.orderBy("date_time").collect()
    assert [r.is_day for r in out] == [0, 0, 1]
    assert [r.ac_power for r in out] == [0.0, 0.0, 5.0]
    assert [r.dc_power_raw for r in out] == [50.0] * 3
    assert (out[0].temp_diff, out[0].hour, out[0].minute, out[0].day_of_year) == (6.0, 5, 45, 1)
    assert out[0].hour_sin == pytest.approx(math.sin(2 * math.pi * 5 / 24))
    assert out[0].day_of_year_cos == pytest.approx(math.cos(2 * math.pi / 365.25))


def test_unknown_modes(spark):
    df = cleaned(spark, {"a": 2})
    with pytest.raises(ValueError):
        ft.add_history(df, heads="zero")
    with pytest.raises(ValueError):
        ft.add_history(df, scope="plant")


def test_one_shuffle_per_device_window(spark):
    plan = ft.add_history(cleaned(spark, {"a": 30}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(plant_id") == 1


def test_a_row_without_time_is_in_no_split(spark):
    df = spark.createDataFrame([(1, T0), (1, None), (1, T0 + dt.timedelta(days=40))], "plant_id int, date_time timestamp_ntz")
    assert sorted(str(r.split) for r in chrono_split(df).collect()) == ["None", "test", "train"]


def test_split_is_a_partition_in_time(spark):
    rows = [(p, T0 + dt.timedelta(hours=6 * i + p)) for p in (1, 2) for i in range(4 * 34)]
    df = chrono_split(spark.createDataFrame(rows, "plant_id int, date_time timestamp_ntz"))
    assert df.count() == len(rows)
    report = {(r.plant_id, r.split): r for r in split_report(df).collect()}
    for p in (1, 2):
        start = T0 + dt.timedelta(hours=p)
        assert report[p, "train"].end_time < start + dt.timedelta(days=20) == report[p, "val"].start_time
        assert report[p, "test"].start_time == start + dt.timedelta(days=27)
        assert report[p, "train"].n_rows == 80 and report[p, "val"].n_rows == 28


@pytest.mark.parametrize(("max_rows", "block_rows"), [(1, 1), (20, 13), (1000, 17), (1000, 4096)])
def test_windows_are_runs_of_rows(spark, max_rows, block_rows):
    """Readings of a device are 0, 1, 2, … here, so a window tells by itself whether it is whole and where it begins."""
    sizes = {"a": 60, "b": 11, "c": 12, "d": 13}
    df = cleaned(spark, sizes)
    got = sq.sequence_windows(df, ["source_key"], "date_time", ["ac_power", "irradiation"], lookback=8, horizon=4, max_rows=max_rows, block_rows=block_rows).collect()
    for key, n in sizes.items():
        starts = sorted(r.x[0]["ac_power"] for r in got if r.source_key == key)
        assert starts == list(range(n - 12 + 1))
    for r in got:
        k = int(r.x[0]["ac_power"])
        assert [e["ac_power"] for e in r.x] == list(range(k, k + 8)) and r.y == list(range(k + 8, k + 12))
        assert r.start_time == T0 + k * STEP


def test_blocks_hold_each_reading_twice_at_most(spark):
    df = cleaned(spark, {"a": 400, "b": 5})
    for length, block_rows in ((12, 50), (12, 400), (48, 50)):
        blocks = sq.series_blocks(df, ["source_key"], "date_time", ["irradiation"], "ac_power", length, block_rows).collect()
        size = max(block_rows, length)
        assert {r.source_key for r in blocks} == {"a"} and sum(r.n_starts for r in blocks) == 400 - length + 1
        for r in blocks:
            first = r.block * size
            assert r.targets == list(range(first, min(400, first + size + length - 1))) and len(r.x) == len(r.times) == len(r.targets)
        assert sum(len(r.targets) for r in blocks) <= 400 + (400 // size) * (length - 1)


def test_windows_keep_nulls(spark):
    df = cleaned(spark, {"a": 30}, gaps=0.5)
    out = sq.sequence_windows(df, ["source_key"], "date_time", ["irradiation"], lookback=8, horizon=4)
    assert all(len(r.x) == 8 and len(r.y) == 4 for r in out.collect())


def test_sample_window(spark):
    df = cleaned(spark, {"a": 15, "b": 30})
    rows = sq.sample_window(df, ["source_key"], "date_time", index=6, lookback=8, horizon=4).orderBy("step").collect()
    # Series a has windows 0 … 3, so number 6 is the third one of b.
    assert [r.source_key for r in rows] == ["b"] * 12
    assert [r.ac_power for r in rows] == [float(i) for i in range(2, 14)]
    assert sq.sample_window(df, ["source_key"], "date_time", index=500, lookback=8, horizon=4).count() == 0


def test_steps_of(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0])], "k int, y array<double>, p array<double>")
    assert [tuple(r) for r in sq.steps_of(df).collect()] == [(1, 1, 1.0, 3.0), (1, 2, 2.0, 4.0)]
