"""Session settings and lineage cuts shared by every plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings of a session built here; a session built elsewhere is left as it is, and results do not depend on them.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join key is split even where the rows are grouped by it afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # call-site capture costs more than building these plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "fleetfootprint", **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, which goes when Python ends; a cluster without the
    setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="fleetfootprint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/fleetfootprint/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was settled inside: for work whose result has been written by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Delete everything this application has settled; results that read it must be written before."""
    _delete(spark, own_folder(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one settled path that nothing reads any more."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute after an executor is lost, later branches all see the same
    rows, and Catalyst knows its true size, so a join with it broadcasts only when it really is small.
    The files stay until ``cleanup`` or the end of a surrounding ``scratch``, for Spark reads them when the result
    is used, which may be any time later.
    """
    return settle_as(df, fresh_path(df.sparkSession, label))


def settle_as(df: DataFrame, path: str) -> DataFrame:
    """``settle`` to a path from ``fresh_path`` that the caller may ``discard``."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
