"""Keyed Parquet tables with upserts, audit rows and snapshots.

There is no table format here that merges in place, so an upsert reads the affected partitions,
anti-joins them with the new rows, and rewrites those partitions alone. A table is never overwritten
while it is read: the merged rows go to a staging folder first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR_VALUES = ["open", "high", "low", "close", "volume", "adj_close", "div_cash", "split_factor"]


def merge_update(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """On conflict do update: the new row replaces the old one. ``new`` has unique keys."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows of equal keys the one with the least values, compared in the order of the columns: reruns agree."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_least")).select(*keys, "_least.*").select(*rows.columns)


def merge_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """On conflict do nothing: the rows of ``new`` to append. Of equal keys in ``new`` the least row is taken."""
    return one_per_key(new, keys).join(existing.select(*keys), list(keys), "left_anti")


class Table:
    """A Parquet folder with a key and, if given, partition columns."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()):
        self.spark, self.path, self.keys, self.partition_by = spark, path.rstrip("/"), list(keys), list(partition_by)

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs()
        return fs.exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def rewrite(self, rows: DataFrame) -> None:
        """The table, or those partitions that ``rows`` are in, with ``rows`` instead; they may be made from it."""
        staged = f"{self.path}.staging-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        self._write(self.spark.read.schema(rows.schema).parquet(staged), "overwrite")
        self._drop(staged)

    def _drop(self, path: str) -> None:
        fs, _ = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """``rows`` as they are now, computed once and counted from the files' own figures after."""
        path = f"{self.path}.given-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def upsert(self, rows: DataFrame) -> int:
        """Insert or update; returns the rows given. Only the partitions of the new rows are rewritten."""
        given, path = self._staged(rows)
        count = given.count()
        if not self.exists():
            self._write(given, "overwrite")
        else:
            old = self.read()
            if self.partition_by:
                old = old.join(given.select(*self.partition_by).distinct(), self.partition_by, "left_semi")
            self.rewrite(merge_update(old, given.select(*old.columns), self.keys))
        self._drop(path)
        return count

    def insert_new(self, rows: DataFrame) -> int:
        """Insert what has no row of its key yet; returns the rows given."""
        given, path = self._staged(rows)
        count = given.count()
        self.append(merge_ignore(self.read(), given, self.keys) if self.exists() else one_per_key(given, self.keys))
        self._drop(path)
        return count


def upsert_bars(table: Table, bars: DataFrame) -> int:
    return table.upsert(bars.select("symbol", "ts", *BAR_VALUES))


def upsert_news(table: Table, news: DataFrame) -> int:
    """News never change: the first row of (symbol, item_id, content_hash) stays."""
    return table.insert_new(news)


def high_water(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("symbol").agg(F.max(column).alias("high_water"))


def audit(spark: SparkSession, run_id: int, kind: str, status: str, message: str | None = None) -> DataFrame:
    """One row of an append-only audit log."""
    row = (run_id, kind, status, message, datetime.now(UTC).replace(tzinfo=None))
    return spark.createDataFrame([row], "run_id long, kind string, status string, message string, at timestamp_ntz")


def audit_rows(events: DataFrame, kind: str) -> DataFrame:
    """Rows of an audit log from ``events(run_id, status, message, at)``; events without a status are none."""
    return events.where("status is not null").select(
        F.col("run_id").cast("long").alias("run_id"), F.lit(kind).alias("kind"), "status", F.col("message").cast("string").alias("message"), F.col("at").cast("timestamp_ntz").alias("at")
    )


def latest_status(log: DataFrame) -> DataFrame:
    """The last state of every run of an audit log."""
    newest = W.partitionBy("run_id").orderBy(F.desc("at"), F.desc(F.expr("array_position(array('queued','running','completed','failed'), status)")))
    return log.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def newest(rows: DataFrame, *by: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(*[F.desc(c) for c in by])
    return out.limit(limit) if limit else out


def latest_day(rows: DataFrame, column: str, within: Sequence[str] = ()) -> DataFrame:
    """The rows of the last value of ``column``, for each ``within`` or overall."""
    if within:
        last = rows.groupBy(*within).agg(F.max(column).alias(column))
        return rows.join(last, [*within, column], "left_semi")
    return rows.join(rows.agg(F.max(column).alias(column)), [column], "left_semi")


def finite(value: Column) -> Column:
    """For JSON: NaN and minus infinity are 0, infinity is 1e9."""
    return (
        F.when(F.isnan(value) | (value == float("-inf")), 0.0).when(value == float("inf"), 1e9).otherwise(value)
    )


def sanitize(value: object) -> object:
    """The same for results held on the driver."""
    if isinstance(value, dict):
        return {k: sanitize(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [sanitize(v) for v in value]
    if isinstance(value, float):
        return 0.0 if value != value or value == float("-inf") else 1e9 if value == float("inf") else value
    return value


def model_id(metadata: dict) -> str:
    """The first 16 hex digits of the SHA-256 of a model's metadata."""
    import hashlib

    return hashlib.sha256(json.dumps(metadata, sort_keys=True, default=str).encode()).hexdigest()[:16]
