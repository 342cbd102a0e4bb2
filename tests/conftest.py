import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pvspark import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session.build("local[4]", shuffle_partitions=4)
    yield spark
    spark.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""

    def read(df, *cols):
        return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())

    return read
