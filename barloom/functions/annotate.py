"""Annotations of news: a deterministic stub, and validation of what a model returns."""

from __future__ import annotations

import time
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event types that an annotation may have.
EVENT_TYPES = [
    "earnings", "guidance", "analyst_rating", "ma", "legal_regulatory", "product", "management_change", "macro", "other"
]
PROMPT_VERSION = "v1"
STUB_OUTPUT_TOKENS = 32


def stub_annotations(news: DataFrame, prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """An annotation per distinct content hash whose numbers are read off the hash itself."""
    seed = F.conv(F.substring("content_hash", 1, 8), 16, 10).cast("long")
    chars = F.length("headline") + F.length("body")
    distinct = news.groupBy("content_hash").agg(F.min("headline").alias("headline"), F.min("body").alias("body"))
    return distinct.select(
        "content_hash", F.lit(prompt_version).alias("prompt_version"),
        ((seed % 2001 - 1000) / 1000.0).alias("sentiment"), (seed % 1001 / 1000.0).alias("relevance"),
        F.element_at(F.array(*map(F.lit, EVENT_TYPES)), (seed % len(EVENT_TYPES) + 1).cast("int")).alias("event_type"),
        F.greatest(F.lit(1), F.floor(chars / 4)).cast("long").alias("input_tokens"),
        F.lit(STUB_OUTPUT_TOKENS).cast("long").alias("output_tokens"), F.lit("small").alias("model"),
        F.when(seed % 17 == 0, "failed").otherwise("ok").alias("status"),
    )


class AnnotationPort(Protocol):
    """Who annotates, in two phases: a batch of requests is submitted, and its results are collected later."""

    def submit(self, requests: DataFrame) -> str:
        """Take ``requests(content_hash, headline, body)``; the batch's name."""

    def collect(self, batch: str) -> DataFrame | None:
        """The results of a batch, failed ones among them, or None while it runs."""


def wait_for(port: AnnotationPort, batch: str, every: float = 1.0, at_most: float = 86_400.0) -> DataFrame:
    """A batch's results, asked for every so many seconds, TimeoutError after ``at_most`` of them."""
    until = time.monotonic() + at_most
    while (found := port.collect(batch)) is None:
        if time.monotonic() >= until:
            raise TimeoutError(f"batch {batch} isn't done")
        time.sleep(every)
    return found


class StubAnnotator:
    """Annotations read off the hashes, by way of the shared folder. A batch runs for ``polls`` collects."""

    def __init__(self, spark: SparkSession, folder: str, polls: int = 0):
        self.spark, self.folder, self.left = spark, folder.rstrip("/"), {}
        self.polls = polls

    def submit(self, requests: DataFrame) -> str:
        batch = f"batch-{uuid.uuid4().hex}"
        requests.select("content_hash", "headline", "body").write.parquet(f"{self.folder}/{batch}")
        self.left[batch] = self.polls
        return batch

    def collect(self, batch: str) -> DataFrame | None:
        if batch not in self.left:
            raise KeyError(f"unknown batch: {batch}")
        if self.left[batch]:
            self.left[batch] -= 1
            return None
        return stub_annotations(self.spark.read.parquet(f"{self.folder}/{batch}"))


def annotation_requests(news: DataFrame, annotations: DataFrame | None, limit: int | None = None, prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """``(content_hash, headline, body)`` of news without an annotation of this prompt, one a hash, by first item."""
    order = F.col("item_id").cast("long")
    item = F.struct(order.alias("item"), "headline", "body")
    wanted = news.groupBy("content_hash").agg(F.min_by(item, order).alias("first"))
    if annotations is not None:
        done = annotations.where(F.col("prompt_version") == prompt_version).select("content_hash")
        wanted = wanted.join(done, "content_hash", "left_anti")
    wanted = wanted.orderBy("first.item").limit(limit) if limit is not None else wanted
    return wanted.select("content_hash", "first.headline", "first.body")


def parse_annotation(reply: Column) -> Column:
    """A model's JSON reply as a struct, clamped to its ranges; null if a field is missing or unusable."""
    r = F.from_json(reply, "sentiment string, relevance string, event_type string, rationale string")
    sentiment, relevance = r["sentiment"].try_cast("double"), r["relevance"].try_cast("double")
    ok = (
        sentiment.isNotNull() & relevance.isNotNull() & r["rationale"].isNotNull()
        & r["event_type"].isin(EVENT_TYPES) & ~F.isnan(sentiment) & ~F.isnan(relevance)
    )
    clamp = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    return F.when(
        ok,
        F.struct(
            clamp(sentiment, -1.0).alias("sentiment"), clamp(relevance, 0.0).alias("relevance"),
            r["event_type"].alias("event_type"), r["rationale"].alias("rationale"),
        ),
    )


def cache_key(content_hash: Column, prompt_version: str = PROMPT_VERSION) -> Column:
    return F.concat(content_hash, F.lit(f":{prompt_version}"))


def client_order_id(deployment: Column, day: Column, symbol: Column, side: Column) -> Column:
    return F.concat(F.lit("dep"), deployment.cast("string"), F.lit("-"), day.cast("string"), F.lit("-"), symbol, F.lit("-"), side)
