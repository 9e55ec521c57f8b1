"""Scans of news: normalised frames with a publish and a first-seen instant."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import SourceError, _safe_symbol

NEWS_COLUMNS = ["item_id", "symbol", "published_at", "first_seen_at", "headline", "body", "source", "url"]
SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
NEWS_JSON = "item_id string, published_at string, first_seen_at string, headline string, body string, source string, url string"
#: A news vendor's field names.
VENDOR_NEWS = "array<struct<id:string,publishedDate:string,crawlDate:string,title:string,description:string,source:string,url:string>>"


def content_hash(headline: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.encode(headline, "UTF-8"), F.lit(b"\x00"), F.encode(body, "UTF-8")), 256)


def canonical_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News derived from ``documents``: spread over the bars' years, seen up to three days later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seconds = (F.col("doc_id") * 7919 % 2490) * 86400 + F.col("doc_id") * 104729 % 86400
    published = F.timestamp_seconds(F.lit(789004800) + seconds)  # from 1995-01-02
    body = F.coalesce("text", F.lit(""))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("doc_id") % 6 + 1).cast("int"))
    news = docs.select(
        F.col("doc_id").cast("string").alias("item_id"), symbol.alias("symbol"), published.alias("published_at"),
        F.timestamp_seconds(F.lit(789004800) + seconds + F.col("doc_id") % 72 * 3600).alias("first_seen_at"),
        F.substring(body, 1, 60).alias("headline"), body.alias("body"), F.coalesce("source", F.lit("")).alias("source"),
        F.lit("").alias("url"),
    )
    return news.withColumn("content_hash", content_hash(F.col("headline"), F.col("body")))


def normalize_news(records: DataFrame, symbol: Column) -> DataFrame:
    """Raw records to a news frame: ids and publish times are required, first-seen falls back to publish.

    A record without them raises when its row is read. Times without a zone are UTC.
    """
    def required(name: str) -> Column:
        given = F.nullif(F.trim(name), F.lit(""))
        return F.coalesce(given, F.raise_error(F.lit(f"a news record has no {name}")))

    published = required("published_at")
    seen = F.coalesce(F.nullif(F.trim("first_seen_at"), F.lit("")), published)
    return records.select(
        required("item_id").alias("item_id"), symbol.alias("symbol"), F.to_timestamp(published).alias("published_at"),
        F.to_timestamp(seen).alias("first_seen_at"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("headline", "body", "source", "url")],
    )


def empty_news(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "item_id string, symbol string, published_at timestamp, first_seen_at timestamp, headline string, body string, source string, url string"
    )


class OfflineNewsProvider:
    """News from ``<folder>/<symbol>.json``, a JSON list; no file is no news."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def fetch_news(self, symbol: str, start: date, end: date) -> DataFrame:
        path = f"{self.folder}/{_safe_symbol(symbol)}.json"
        try:
            raw = self.spark.read.schema(NEWS_JSON).option("mode", "FAILFAST").json(path, multiLine=True)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return empty_news(self.spark)
            raise SourceError(str(e)) from e
        day = F.to_date("published_at")
        return normalize_news(raw, F.lit(symbol)).where(day.between(F.lit(start), F.lit(end)))


def make_news_provider(spark: SparkSession, folder: str, api_key: str | None = None) -> OfflineNewsProvider:
    """The offline provider; with a key, the caller fetches payloads and uses parse_vendor_news()."""
    if api_key:
        raise SourceError("no network provider is built in: fetch payloads and use parse_vendor_news()")
    return OfflineNewsProvider(spark, folder)


def parse_vendor_news(payloads: DataFrame) -> DataFrame:
    """``payloads(symbol, body)`` of a news vendor's JSON lists to news frames; crawl time is first seen."""
    rows = payloads.select(F.col("symbol").alias("for"), F.explode(F.from_json("body", VENDOR_NEWS)).alias("n"))
    raw = rows.select(
        "for", F.col("n.id").alias("item_id"), F.col("n.publishedDate").alias("published_at"),
        F.col("n.crawlDate").alias("first_seen_at"), F.col("n.title").alias("headline"),
        F.col("n.description").alias("body"), F.col("n.source").alias("source"), F.col("n.url").alias("url"),
    )
    return normalize_news(raw, F.col("for"))
