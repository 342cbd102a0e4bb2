"""Places that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from pvspark.session import ship  # noqa: F401

_own: str | None = None


def root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder, which goes with the process.
    """
    global _own
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="pvspark-llm-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of an operator. It is made by whoever writes into it first."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """`folder` as a path of the file system, for files that are mapped into memory."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder}: mapped files need a folder mounted on every machine; pass one")
    return url.path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: no lost executor replays the plan behind it."""
    spark, schema = df.sparkSession, df.schema
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)
