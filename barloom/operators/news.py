"""Point-in-time news features.

An annotation is available when it was both published and seen. It reaches the first bar whose cutoff, the
session close ``embargo`` bars before, is not earlier. Arrival is an interval join on a symbol's lagged
cutoffs, bucketed by month so that it is an equality join with a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .indicators import by_symbol
from .recurrence import linear_scan, number_bars

CLOSE_ZONE, CLOSE_HOUR = "America/New_York", 16
CAP, HALF_LIFE, TRAIL, EVENT_BARS, EVENT_RELEVANCE = 50, 5.0, 20, 5, 0.5
NEWS_FEATURES = ["n_has_news", "n_days_since", "n_decayed", "n_mean_20", "n_volume_z", "n_event"]


def session_close_utc(ts: Column) -> Column:
    local = F.to_date(ts).cast("timestamp_ntz") + F.expr(f"INTERVAL {CLOSE_HOUR} HOURS")
    return F.to_utc_timestamp(local.cast("timestamp"), CLOSE_ZONE)


def bar_cutoffs(bars: DataFrame, embargo: int = 1) -> DataFrame:
    """``(symbol, ts, bar_idx, cutoff, after)``: news in (after, cutoff] reach this bar."""
    if embargo < 1:
        raise ValueError("the embargo is one bar at least")
    close = F.lag(session_close_utc(F.col("ts")), embargo).over(by_symbol())
    cut = bars.select("symbol", "ts", (F.row_number().over(by_symbol()) - 1).alias("bar_idx"), close.alias("cutoff"))
    return cut.withColumn("after", F.lag("cutoff").over(by_symbol()))


def arrivals(bars: DataFrame, annotated: DataFrame, embargo: int = 1) -> DataFrame:
    """``annotated`` rows with the ``bar_idx`` and ``ts`` that they reach; rows after the last cutoff go."""
    cut = bar_cutoffs(bars, embargo).where("cutoff is not null")
    # A bar's interval may span months; before the first cutoff it is open.
    first = F.coalesce(F.date_trunc("month", "after"), F.lit(None).cast("timestamp"))
    months = F.sequence(first, F.date_trunc("month", "cutoff"), F.expr("interval 1 month"))
    bounded = cut.where("after is not null").withColumn("month", F.explode(months))
    news = annotated.withColumn("available", F.greatest("published_at", "first_seen_at"))
    n = news.withColumn("month", F.date_trunc("month", "available"))
    inside = n.join(bounded.drop("ts").withColumn("bar_ts", F.lit(None)).drop("bar_ts"), ["symbol", "month"]).where(
        (F.col("available") > F.col("after")) & (F.col("available") <= F.col("cutoff"))
    )
    opening = news.join(cut.where("after is null").drop("ts"), "symbol").where(F.col("available") <= F.col("cutoff"))
    cols = [*news.columns, "bar_idx"]
    return inside.select(*cols).unionByName(opening.select(*cols))


def arrivals_per_bar(bars: DataFrame, annotated: DataFrame, embargo: int = 1, relevance: float = 0.0) -> DataFrame:
    """Bars with the number, summed sentiment and number of highly relevant news that reach them."""
    reached = arrivals(bars, annotated.where(F.col("relevance") >= relevance), embargo).groupBy("symbol", "bar_idx").agg(
        F.count("*").alias("n_news"), F.sum("sentiment").alias("sentiment_sum"),
        F.count_if(F.col("relevance") >= EVENT_RELEVANCE).alias("n_events"),
    )
    indexed = bars.withColumn("bar_idx", F.row_number().over(by_symbol()) - 1)
    return indexed.join(reached, ["symbol", "bar_idx"], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_news", "n_events")}
        | {"sentiment_sum": F.coalesce("sentiment_sum", F.lit(0.0))}
    )


def add_news_features(bars: DataFrame, annotated: DataFrame, embargo: int = 1, relevance: float = 0.0) -> DataFrame:
    """The six news features of each bar; never null."""
    return features_of_counts(arrivals_per_bar(bars, annotated, embargo, relevance))


def features_of_counts(counted: DataFrame) -> DataFrame:
    """The six news features from ``(symbol, ts, bar_idx, n_news, sentiment_sum, n_events)`` of every bar."""
    last = F.last(F.when(F.col("n_news") > 0, F.col("bar_idx")), ignorenulls=True).over(
        by_symbol().rowsBetween(W.unboundedPreceding, 0)
    )
    trail = by_symbol().rowsBetween(-(TRAIL - 1), 0)
    total, sentiment = F.sum("n_news").over(trail), F.sum("sentiment_sum").over(trail)
    spread = F.stddev_pop("n_news").over(trail)
    decay = 0.5 ** (1 / HALF_LIFE)
    counted = linear_scan(number_bars(counted), {"_decayed": (decay, F.col("sentiment_sum"))}, fold=True).drop("_pos", "_block", "_k")
    return counted.withColumns(
        {
            "n_has_news": (F.col("n_news") > 0).cast("double"),
            "n_days_since": F.coalesce(F.least(F.lit(CAP), F.col("bar_idx") - last) / F.lit(float(CAP)), F.lit(1.0)),
            "n_decayed": F.col("_decayed"),
            "n_mean_20": F.when(total > 0, sentiment / total).otherwise(0.0),
            "n_volume_z": F.when(spread > 0, (F.col("n_news") - F.avg("n_news").over(trail)) / spread).otherwise(0.0),
            "n_event": (F.sum("n_events").over(by_symbol().rowsBetween(-(EVENT_BARS - 1), 0)) > 0).cast("double"),
        }
    ).drop("_decayed")
