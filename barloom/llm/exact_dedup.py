"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is first
reduced to one row per digest (partial aggregation, so that a text with a third of all rows costs one
row per task), then anti-joined with the index by sort-merge, and what is new is appended. The index is
read by its buckets, so only a batch's digests are shuffled.

A whole table is dealt into batches of falling doc_id, each of which goes through the index: the row that
is indexed first for a text is then the one with its largest doc_id.

Defined cases: a null text counts as empty; letters A-Z alone are folded; among rows with equal texts
the one with the largest doc_id stays, a null doc_id being the smallest; of repeated rows (same doc_id
and text) one stays. Against an index that was filled before, the indexed row stays, also where its doc_id
is smaller. doc_ids that aren't numbers make one batch. An empty table gives an empty result. Other columns
are never looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import discard, fresh_names, is_empty, materialize, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES = 2


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, row)`` of every row of ``docs``, written."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """A table ``(digest, keep_id, keep_row, batch)``, bucketed and sorted by digest, that grows by batches.

    keep_row tells equal doc_ids of one batch apart and means nothing beyond it. On a cluster the warehouse
    that holds the table is shared.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_width(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def add_digests(self, rows: DataFrame) -> str:
        """Append the texts of ``rows(doc_id, digest, row)`` that are new, one row each; the batch's name."""
        batch = uuid.uuid4().hex
        if not self.exists():
            self._append(rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(batch).alias("batch")).limit(0))
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"))
        known = self.spark.table(self.name).select("digest")
        fresh = groups.hint("merge").join(known, "digest", "left_anti")
        self._append(
            fresh.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.lit(batch).alias("batch"))
        )
        return batch

    def decided(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """``rows`` with what the index says of their texts: keep_id, group_size (of ``rows``), known and kept.

        ``batches`` are the names of those that ``rows`` came in; what an older one holds is known.
        """
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        said = sizes.hint("merge").join(self.spark.table(self.name), "digest").select(
            "digest", "group_size", "keep_id", "keep_row", (~F.col("batch").isin(batches)).alias("known")
        )
        return rows.join(said, "digest").select(
            "doc_id", "digest", "keep_id", "group_size", "known",
            (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and itself, and append what is new.

        Returns one row per input row: doc_id, digest, keep_id, group_size (rows of this batch with
        that text), known (indexed before this batch) and kept.
        """
        rows = digests(docs, id_col, text_col)
        return self.decided(rows, [self.add_digests(rows)])


def _falling(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` in batches of falling doc_id; nulls are in the last."""
    if batches < 2 or not isinstance(rows.schema["doc_id"].dataType, NumericType):
        return [rows]
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
    parts, above = [], None
    for cut in sorted({int(c) for c in cuts}, reverse=True):
        part = rows.where(F.col("doc_id") > cut)
        parts.append(part if above is None else part.where(F.col("doc_id") <= above))
        above = cut
    return [*parts, rows if above is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") <= above))]


def mark_duplicates(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """Every row of ``docs`` with the row that stays for its text, by way of ``index`` or of one made for it."""
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = digests(docs)
    names = [index.add_digests(part) for part in _falling(rows, batches)]
    marked = index.decided(rows, names)
    if own:
        marked = materialize(marked, "marked")
        index.drop()
        discard(rows)
    return marked


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = mark_duplicates(docs, index)
    if index is not None:
        marked = materialize(marked, "marked")
    gone_id, mixed_id, stay_id, digest, stay_digest = fresh_names(docs, "gone_id", "mixed_id", "stay_id", "digest", "stay_digest")
    per_id = marked.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    gone = per_id.where("not some").select(F.col("doc_id").alias(gone_id))
    # By sort-merge at every size: the list of what goes grows with the documents.
    out = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    mixed = materialize(per_id.where("some and not every").select(F.col("doc_id").alias(mixed_id)), "mixed")
    if is_empty(mixed):
        discard(mixed)
        return out
    # A doc_id that stays with one text and goes with another, or that is repeated.
    same = F.col("doc_id").eqNullSafe(F.col(mixed_id))
    stays = marked.where("kept").select(F.col("doc_id").alias(stay_id), F.col("digest").alias(stay_digest))
    some = docs.join(mixed, same, "left_semi").withColumn(digest, text_digest(F.col("text")))
    some = some.join(
        stays, F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(digest) == F.col(stay_digest)), "left_semi"
    ).dropDuplicates(["doc_id", digest])
    return out.join(mixed, same, "left_anti").unionByName(some.drop(digest))
