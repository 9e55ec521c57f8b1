"""A session with the settings that the library is written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import uuid

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``.

    A temporary folder of this machine serves where that is unset and the session runs on this machine; on a
    cluster the setting is needed, as executors don't see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or tempfile.mkdtemp(prefix="barloom-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan ends there, and lost executors don't matter."""
    path = shared_folder(df.sparkSession, name)
    if partitions:  # few files a partition where it is small, more where it is large
        df.hint("rebalance", *partitions).write.partitionBy(*partitions).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, unless they find it on their own path."""
    root = Path(__file__).resolve().parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and Path(p).resolve() == root.parent for p in paths):
        return
    archive = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def get_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
