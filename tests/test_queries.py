"""Every registered query with an SQL twin, compared on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from pvspark.operators.series import MAX_ROWS_CONF  # noqa: E402
from pvspark.operators.small import BROADCAST_ROWS_CONF  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

SLOW = {"fit_forest", "fit_boosted", "importance_topk", "forecast_day_ahead"}  # minutes each; their settings are checked in test_learn


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# The training-data queries have tests of their own.
OWN = sorted(n for n in oracle_sql() if not n.startswith("op") and n != "pipeline")
ROWS_ONLY = sorted(n for n in set(queries()) - set(oracle_sql()) - SLOW if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, con, name):
    result = compare(spark, con, SF, name)
    assert result.startswith("ok"), result


@pytest.fixture
def tight(spark):
    """Nothing may be broadcast, and every series longer than 20 rows is cut."""
    limits = {BROADCAST_ROWS_CONF: "0", MAX_ROWS_CONF: "20", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name", ["clean_join", "clean_fill_row", "feat_filled", "feat_filled_carry", "hist_ac", "kde_ac", "chrono_split", "yield_gap", "skipped_rows"]
)
def test_equals_sql_without_broadcasts_and_with_cut_series(tight, con, name):
    result = compare(tight, con, SF, name)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
