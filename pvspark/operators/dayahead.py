"""The next day's steps at once: least squares with one response per step ahead, over all readings of the history.

Inputs are the values of every feature at every step of the history. All responses share one matrix of sums of products, which each task adds up over
the blocks of series it holds; windows are views of a block's arrays and are never written out. All plants are fitted in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators.clean import PLANT
from pvspark.operators.sequences import HORIZON, LOOKBACK

#: Windows that are multiplied at once, and numbers of sums that a task holds before it hands them on.
_WINDOWS, _HELD = 2048, 1 << 25


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)


def _flat(blocks: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Blocks with their features as one array, reading by reading; null counts as NaN."""
    nan = F.lit(float("nan"))
    values = F.flatten(F.transform("x", lambda e: F.array(*[F.coalesce(e[f].cast("double"), nan) for f in features])))
    return blocks.select(*by, "times", values.alias("x"), F.transform("targets", lambda v: F.coalesce(v.cast("double"), nan)).alias("targets"), "n_starts")


def _windows(x: np.ndarray, targets: np.ndarray, n: int, lookback: int, horizon: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Inputs and responses of a block's windows, some at a time, and the number of the first one."""
    width = len(x) // len(targets) if len(targets) else 0
    inputs = np.lib.stride_tricks.sliding_window_view(x, lookback * width)[:: max(width, 1)]
    after = np.lib.stride_tricks.sliding_window_view(targets[lookback:], horizon)
    for k in range(0, n, _WINDOWS):
        stop = min(n, k + _WINDOWS)
        yield k, inputs[k:stop], after[k:stop]


def _moments(by: list[str], lookback: int, horizon: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                row = [pa.array([v] * len(sums), t) for v, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*row, pa.array(np.arange(len(sums))), pa.array(list(sums), pa.list_(pa.float64()))], [*by, "i", "sums"])
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in by]
            keys = list(zip(*[batch.column(k).to_pylist() for k in by], strict=True))
            for key, x, targets, n in zip(keys, batch.column("x"), batch.column("targets"), batch.column("n_starts").to_pylist(), strict=True):
                for _, a, y in _windows(x.values.to_numpy(zero_copy_only=False), targets.values.to_numpy(zero_copy_only=False), n, lookback, horizon):
                    known = np.isfinite(a).all(axis=1) & np.isfinite(y).all(axis=1)
                    a = np.c_[np.ones(known.sum()), a[known]]
                    if key not in held:
                        if (len(held) + 1) * a.shape[1] * (a.shape[1] + horizon) > _HELD:
                            yield from out()
                        held[key] = np.zeros((a.shape[1], a.shape[1] + horizon))
                    held[key] += a.T @ np.c_[a, y[known]]
        yield from out()

    return run


def _added(by: list[str]):
    """Sums of equal rows, which follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, kinds = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip(last, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total], pa.list_(pa.float64()))], [*by, "i", "sums"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in [*by, "i"]]
            for key, sums in zip(zip(*[batch.column(k).to_pylist() for k in [*by, "i"]], strict=True), batch.column("sums"), strict=True):
                if key != last:
                    if last is not None:
                        yield out()
                    last, total = key, np.zeros(len(sums))
                total = total + sums.values.to_numpy()
        if last is not None:
            yield out()

    return run


def moments(blocks: DataFrame, features: list[str], by: tuple[str, ...] = (PLANT,), lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """Per group and input `i` (0 is the constant 1) the sums of its products with all inputs and all responses, over windows without gaps."""
    by = list(by)
    schema = f"{_kinds(blocks, by)}, i long, sums array<double>"
    parts = _flat(blocks, features, by).select(*by, "x", "targets", "n_starts").mapInArrow(_moments(by, lookback, horizon), schema)
    # As many rows per group as there are inputs, from each task.
    return parts.repartition(*by, "i").sortWithinPartitions(*by, "i").mapInArrow(_added(by), schema)


def _solve(by: list[str], alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sums = np.array([r["sums"] for r in batch.column("rows")[k].as_py()])
                p = len(sums)
                n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
                centred = sums[1:, 1:] - n * np.outer(mean[: p - 1], mean)
                # A feature that doesn't vary but for rounding has no weight.
                spread = np.sqrt(np.maximum(np.diag(centred[:, : p - 1]), 0) / n)
                scale = np.where(spread > 1e-9 * (1 + np.abs(mean[: p - 1])), spread, np.inf)
                gram = centred[:, : p - 1] / np.outer(scale, scale) + alpha * np.eye(p - 1)
                weights = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ (centred[:, p - 1 :] / scale[:, None]) / scale[:, None]
                intercept = mean[p - 1 :] - mean[: p - 1] @ weights
                columns = [batch.column(c).take(pa.array([k] * len(intercept))) for c in by]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.arange(1, len(intercept) + 1)), pa.array([int(n)] * len(intercept)), pa.array(intercept), pa.array(list(weights.T), pa.list_(pa.float64()))],
                    [*by, "step", "n", "intercept", "weights"],
                )

    return run


def fit(
    blocks: DataFrame, features: list[str], by: tuple[str, ...] = (PLANT,), lookback: int = LOOKBACK, horizon: int = HORIZON, alpha: float = 0.0
) -> DataFrame:
    """Group, step, n (windows), intercept, weights: one linear (alpha 0) or ridge model per step ahead; ridge weighs inputs by their deviation.

    Weights are in the order of the history, the features of each reading together. What one task solves is as large as the model, not as the data.
    """
    by = list(by)
    sums = moments(blocks, features, tuple(by), lookback, horizon)
    whole = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "sums"))).alias("rows")).filter(F.col("rows")[0]["sums"][0] > 0)
    return whole.mapInArrow(_solve(by, alpha), f"{_kinds(blocks, by)}, step long, n long, intercept double, weights array<double>")


def _predict(names: list[str], lookback: int, horizon: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                model = np.array(one.column("model")[0].as_py())
                x, targets = (one.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("x", "targets"))
                times = one.column("times")[0].values
                for start, a, y in _windows(x, targets, one.column("n_starts")[0].as_py(), lookback, horizon):
                    rows = len(a)
                    found = a @ model[:, 1:].T + model[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [*[one.column(c).take(pa.array([0] * rows)) for c in names], times.slice(start, rows), pa.array(list(y), pa.list_(pa.float64())), pa.array(list(found), pa.list_(pa.float64()))],
                        [*names, "start_time", "y", "p"],
                    )

    return run


def predict(
    blocks: DataFrame, models: DataFrame, features: list[str], keys: list[str], by: tuple[str, ...] = (PLANT,), lookback: int = LOOKBACK, horizon: int = HORIZON
) -> DataFrame:
    """`keys`, start_time, `y` and `p`: what came and what is forecast for each window of `blocks`; NaN where a reading is missing."""
    model = F.concat(F.array("intercept"), F.col("weights"))
    whole = models.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", model.alias("m")))), lambda e: e["m"]).alias("model"))
    rows = _flat(blocks, features, keys).join(whole, list(by))
    kind = blocks.schema["times"].dataType.elementType.simpleString()
    return rows.mapInArrow(_predict(keys, lookback, horizon), f"{_kinds(blocks, keys)}, start_time {kind}, y array<double>, p array<double>")
