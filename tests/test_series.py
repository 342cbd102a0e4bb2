import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvspark.operators import series as S
from pvspark.operators.fill import fill_forward, fill_linear

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """Three series; one holds most rows, some of them in a burst; values have gaps."""
    rng = random.Random(7)
    rows = []
    for key, n in (("a", 400), ("b", 9), ("c", 1)):
        at = 0
        for i in range(n):
            at += 1 if 100 < i < 300 else rng.randint(20, 4000)
            rows.append((key, T0 + dt.timedelta(seconds=at), i, None if rng.random() < 0.6 else round(rng.random() * 100, 3)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, v double")


@pytest.mark.parametrize("max_rows", [3, 7, 50, 1000])
def test_row_index(skewed, max_rows):
    out = S.row_index(skewed, ["k"], ["t"], "n", max_rows).collect()
    assert len(out) == 410
    assert all(r.n == r.i + 1 for r in out)


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_row_index_over_crowded_instants(spark, max_rows):
    rows = [(1, T0 + dt.timedelta(hours=h), f"dev{d:03d}") for h, devices in ((0, 3), (1, 60), (2, 1), (3, 40)) for d in range(devices)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, dev string").repartition(5)
    out = S.row_index(df, ["k"], ["t", "dev"], "n", max_rows).orderBy("n").collect()
    assert [(r.t, r.dev) for r in out] == [(t, d) for _, t, d in sorted(rows)]
    assert [r.n for r in out] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("max_rows", [5, 64, 1000])
def test_segments_see_the_rows_around_them(skewed, max_rows):
    cut = S.segments(skewed, ["k"], ["t"], before=3, after=5, max_rows=max_rows)
    cut = cut.with_columns({"back": f"lag(i, 3) {cut.over()}", "ahead": f"lead(i, 5) {cut.over()}"})
    sizes = {"a": 400, "b": 9, "c": 1}
    out = cut.own_rows().collect()
    assert len(out) == 410
    for r in out:
        assert r.back == (r.i - 3 if r.i >= 3 else None)
        assert r.ahead == (r.i + 5 if r.i + 5 < sizes[r.k] else None)


def test_a_long_series_is_spread_over_segments(skewed):
    cut = S.segments(skewed, ["k"], ["t"], max_rows=50)
    largest = cut.frame.groupBy("k", S.SEG).count().agg(F.max("count")).first()[0]
    assert cut.cut and largest == 50


@pytest.mark.parametrize("max_rows", [1, 6, 33, 1000])
@pytest.mark.parametrize("by", ["time", "row"])
def test_linear_fill_against_pandas(skewed, by, max_rows):
    got = fill_linear(skewed, ["k"], ["t"], ["v"], by, max_rows).toPandas().sort_values(["k", "i"])
    want = []
    for _, g in skewed.toPandas().sort_values(["k", "i"]).groupby("k"):
        s = pd.Series(g["v"].to_numpy(), index=g["t"])
        want += list(s.interpolate(method="time" if by == "time" else "linear").bfill().ffill())
    pd.testing.assert_series_equal(got["v"].reset_index(drop=True), pd.Series(want, name="v"), rtol=1e-9)


def test_running_sum_of_a_column(skewed):
    df = skewed.withColumn("w", F.col("i") * 2)
    got = S.running_sum(df, ["k"], ["t"], "w", "total", 10).collect()
    assert all(r.total == r.i * (r.i + 1) for r in got)


AWKWARD = {
    "outlier": [dt.datetime(1970, 1, 1)] + [T0 + dt.timedelta(minutes=15 * i) for i in range(3000)],
    "burst": sorted([T0 + dt.timedelta(days=i) for i in range(50)] + [T0 + dt.timedelta(days=3, microseconds=i) for i in range(1, 2950)]),
    "prefix": [f"inverter_number_{i:06d}" for i in range(3000)],
    "large": [2**60 + i for i in range(3000)],
    "ties": sorted([T0 + dt.timedelta(hours=i % 7) for i in range(3000)]),
}


@pytest.mark.parametrize("name", AWKWARD)
def test_slices_are_cut_by_rank(spark, name):
    values, limit = AWKWARD[name], 300
    kind = {str: "string", int: "long"}.get(type(values[0]), "timestamp_ntz")
    rows = list(zip(["a"] * len(values), values, range(len(values)), strict=True))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), f"k string, t {kind}, i long")
    largest = S.sliced(df, ["k"], ["t", "i"], len(rows), limit).groupBy(S._SLICE).count().agg(F.max("count")).first()[0]
    assert largest <= limit
    assert all(r.n == r.i + 1 for r in S.row_index(df, ["k"], ["t", "i"], "n", limit).collect())


@pytest.mark.parametrize("name", ["prefix", "large"])
def test_edges_of_segments_with_keys_that_look_alike(spark, name):
    values = AWKWARD[name][:200]
    kind = "string" if name == "prefix" else "long"
    df = spark.createDataFrame([("a", v, float(i) if i % 17 == 3 else None) for i, v in enumerate(values)], f"k string, t {kind}, v double")
    cut = fill_forward(S.segments(df, ["k"], ["t"], max_rows=10), ["v"]).own_rows().orderBy("t").collect()
    whole = fill_forward(S.segments(df, ["k"], ["t"], max_rows=1000), ["v"]).own_rows().orderBy("t").collect()
    assert [r.v for r in cut] == [r.v for r in whole]


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_rows_without_order_value_come_first(spark, max_rows):
    df = spark.createDataFrame([("a", None)] + [("a", i) for i in range(9)] + [("b", 5)] * 1, "k string, t int")
    out = {(r.k, r.t): r.n for r in S.row_index(df, ["k"], ["t"], "n", max_rows).collect()}
    assert out["a", None] == 1 and all(out["a", i] == i + 2 for i in range(9)) and out["b", 5] == 1
