"""What the corpus operators share: the work folder, written intermediates, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space that separates words: the space and U+0009 to U+000D.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[DataFrame]] = []


class Tidy:
    """Deletes at its end what was materialized inside it, but for what is kept; that falls to the scope around it.

    Only what no later plan reads may go, so a result is kept with all the written frames that its plan reads.
    """

    def __enter__(self) -> Tidy:
        self.kept: set[str] = set()
        _SCOPES.append([])
        return self

    def keep(self, *frames: DataFrame) -> None:
        self.kept |= {f._barloom_path for f in frames}

    def __exit__(self, *_: object) -> None:
        for frame in _SCOPES.pop():
            if frame._barloom_path not in self.kept:
                discard(frame)
            elif _SCOPES:
                _SCOPES[-1].append(frame)


#: Largest table that a written step may broadcast, by the planner's estimate. That is the size of compressed files, and
#: rows that are exploded from them don't count, so the driver may have to hold a hundred times as much.
BROADCAST_BYTES = 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile broadcasts nothing that is estimated above ``BROADCAST_BYTES``; hints stay."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    allowed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(key, min(allowed, BROADCAST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with small_broadcasts(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path  # for discard()
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path, spark = getattr(df, "_barloom_path", None), df.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of ``rows``, so that what is made of a slice stays small; freed memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


@contextmanager
def batch_rows(spark: SparkSession, rows: int, files: bool = False) -> Iterator[None]:
    """Arrow batches of what runs meanwhile hold so many rows at most: for rows that are large themselves.

    With ``files``, so do the batches in which Parquet files are read.
    """
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", *["spark.sql.parquet.columnarReaderBatchSize"] * files]
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        for key in keys:
            spark.conf.set(key, before[key])


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(u, v)`` as ``(node, root)``; root is the smallest node.

    Alternates large-star and small-star rounds until the edges no longer change. Every round is a
    grouped minimum and an equi-join, so a hub is pre-aggregated and its join side can be split.
    Nodes without edges don't appear.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        # Large star: every larger neighbour of u hangs on u's smallest neighbour.
        around = _both_ways(now)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = materialize(large.where("u <> v").distinct(), "large")
        # Small star: u and its smaller neighbours hang on the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "small")
        discard(large)
        discard(now)
        now, before = after, seen
        seen = _fingerprint(now)
        if seen == before:
            break
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
