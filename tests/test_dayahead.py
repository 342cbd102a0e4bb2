import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.operators import dayahead
from pvspark.operators import sequences as sq

T0 = dt.datetime(2024, 1, 1)
NAMES = ["ac_power", "heat"]
SCHEMA = "plant_id int, split string, date_time timestamp_ntz, ac_power double, heat double"


def readings(sizes, seed=1, gap=None):
    rng = np.random.default_rng(seed)
    for plant, n in sizes.items():
        power, heat = np.zeros(n + 2), rng.normal(20, 3, n + 2)
        for k in range(2, n + 2):
            power[k] = 5 * plant + 0.6 * power[k - 1] - 0.2 * power[k - 2] + 0.3 * heat[k - 1] + rng.normal(0, 0.1)
        for k in range(n):
            yield plant, "train" if k < 3 * n // 4 else "test", T0 + k * dt.timedelta(minutes=15), float(power[k + 2]), None if gap == (plant, k) else float(heat[k + 2])


def blocks(df, lookback, horizon, block_rows):
    return sq.series_blocks(df, ["plant_id", "split"], "date_time", NAMES, "ac_power", lookback + horizon, block_rows)


def windows(rows, plant, split, lookback, horizon):
    mine = [r for r in rows if r[0] == plant and r[1] == split]
    x, y = [], []
    for s in range(len(mine) - lookback - horizon + 1):
        x.append([v for r in mine[s : s + lookback] for v in r[3:]])
        y.append([r[3] for r in mine[s + lookback : s + lookback + horizon]])
    return np.array(x, float), np.array(y, float)


@pytest.mark.parametrize(("alpha", "block_rows", "gap"), [(0.0, 4096, None), (0.0, 7, (1, 50)), (3.0, 20, None)])
def test_weights_equal_numpy(spark, alpha, block_rows, gap):
    rows = list(readings({1: 150, 2: 90}, gap=gap))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = dayahead.fit(blocks(df, 3, 4, block_rows).filter("split = 'train'"), NAMES, lookback=3, horizon=4, alpha=alpha).collect()
    assert sorted((r.plant_id, r.step) for r in found) == [(p, s) for p in (1, 2) for s in range(1, 5)]
    for r in found:
        x, y = windows(rows, r.plant_id, "train", 3, 4)
        known = np.isfinite(x).all(1)
        x, y = x[known], y[known, r.step - 1]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(6), z.T @ (y - y.mean())) / x.std(0)
        assert r.n == len(x) and list(r.weights) == pytest.approx(w.tolist(), rel=1e-6, abs=1e-9) and r.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


def test_forecast_and_score(spark):
    rows = list(readings({1: 300, 2: 300}, seed=3))
    df = spark.createDataFrame(rows, SCHEMA)
    every = blocks(df, 4, 3, 30)
    models = dayahead.fit(every.filter("split = 'train'"), NAMES, lookback=4, horizon=3)
    got = dayahead.predict(every.filter("split = 'test'"), models, NAMES, ["plant_id", "split"], lookback=4, horizon=3).collect()
    for plant in (1, 2):
        x, y = windows(rows, plant, "test", 4, 3)
        mine = sorted((r for r in got if r.plant_id == plant), key=lambda r: r.start_time)
        ms = sorted((m for m in models.collect() if m.plant_id == plant), key=lambda m: m.step)
        want = np.stack([m.intercept + x @ np.array(m.weights) for m in ms], axis=1)
        assert np.allclose([r.p for r in mine], want) and np.allclose([r.y for r in mine], y)
        assert mine[0].start_time == T0 + 225 * dt.timedelta(minutes=15)
        # The process is linear, so the first step is nearly exact and beats the last reading.
        assert np.abs(want[:, 0] - y[:, 0]).mean() < 0.15 < 0.5 * np.abs(x[:, -2] - y[:, 0]).mean()


def test_constant_inputs_and_too_short_series(spark):
    rows = [(1, "train", T0 + k * dt.timedelta(minutes=15), float(k % 5), 7.0) for k in range(40)] + [(2, "train", T0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = dayahead.fit(blocks(df, 5, 2, 10), NAMES, lookback=5, horizon=2).collect()
    assert {r.plant_id for r in found} == {1}
    for r in found:
        assert all(w == 0 for w in r.weights[1::2])
    out = dayahead.predict(blocks(df, 5, 2, 10), spark.createDataFrame(found), NAMES, ["plant_id"], lookback=5, horizon=2)
    assert all(r.p == pytest.approx(r.y, abs=1e-6) for r in out.collect())


def test_no_matter_how_long_the_history_readings_are_shuffled_once(spark):
    """Each task's sums grow with the history; the readings do not."""
    df = spark.createDataFrame(list(readings({1: 400})), SCHEMA)
    count = [blocks(df, n, 4, 200).select(F.sum(F.size("x"))).first()[0] for n in (4, 40)]
    assert count[1] <= count[0] + 2 * 36
