"""Performance measures of equity curves and fills, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252


def _keys(keys: tuple[str, ...]) -> list[str]:
    return list(keys)


def equity_stats(curve: DataFrame, initial: float | Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Total and annualised return, drawdown, Sharpe, Sortino and exposure of each curve, in percent where named so."""
    start = F.lit(float(initial)) if not isinstance(initial, Column) else initial
    by = W.partitionBy(*keys).orderBy("ts")
    before = F.lag("equity").over(by)
    peak = F.max("equity").over(by.rowsBetween(W.unboundedPreceding, 0))
    steps = curve.withColumns(
        {
            "_ret": F.when(before != 0, (F.col("equity") - before) / before),
            "_down": F.when(peak > 0, F.col("equity") / peak - 1).otherwise(0.0), "_start": start,
        }
    )
    out = steps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by("equity", "ts").alias("final_equity"), F.max("_start").alias("initial"),
        F.greatest(F.lit(0.0), -F.min("_down") * 100).alias("max_drawdown_pct"),
        F.count("_ret").alias("n_ret"), F.avg("_ret").alias("mean"), F.stddev_samp("_ret").alias("std"),
        F.sum(F.when(F.col("_ret") < 0, F.col("_ret") * F.col("_ret"))).alias("down_sq"),
        (F.count_if(F.col("position_value") > 0) / F.count("*") * 100).alias("exposure_pct"),
    )
    years = F.greatest((F.col("n") - 1) / float(YEAR), F.lit(1.0))
    grown = (F.col("n") > 1) & (F.col("initial") > 0) & (F.col("final_equity") > 0)
    root = F.sqrt(F.lit(float(YEAR)))
    down = F.sqrt(F.col("down_sq") / F.col("n_ret"))
    return out.select(
        *keys, "n", "final_equity",
        F.when(F.col("initial") != 0, (F.col("final_equity") - F.col("initial")) / F.col("initial") * 100).otherwise(0.0).alias("total_return_pct"),
        F.when(grown, (F.pow(F.col("final_equity") / F.nullif("initial", F.lit(0.0)), 1 / years) - 1) * 100).otherwise(0.0).alias("annualised_return_pct"),
        F.coalesce("max_drawdown_pct", F.lit(0.0)).alias("max_drawdown_pct"),
        F.when((F.col("n_ret") >= 2) & (F.col("std") > 0), F.try_divide(F.col("mean"), F.col("std")) * root).otherwise(0.0).alias("sharpe"),
        F.when((F.col("n_ret") >= 2) & (down > 0), F.try_divide(F.col("mean"), down) * root).otherwise(0.0).alias("sortino"),
        "exposure_pct",
    )


def round_trips(fills: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each SELL with the BUY before it: profit after fees, and days held."""
    by = W.partitionBy(*keys).orderBy("seq")
    prev = F.lag(F.struct("side", "gross_value", "fee", "ts")).over(by)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return fills.withColumn("_buy", prev).where("side = 'SELL' and _buy.side = 'BUY'").select(
        *keys, "seq", F.col("_buy.ts").alias("entry_ts"), F.col("ts").alias("exit_ts"),
        (F.col("gross_value") - F.col("fee") - (F.col("_buy.gross_value") + F.col("_buy.fee"))).alias("pnl"),
        ((seconds(F.col("ts")) - seconds(F.col("_buy.ts"))) / 86400).alias("holding_days"), "reason",
    )


def round_trip_stats(trips: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    p = F.col("pnl")
    won, lost = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0))
    return trips.groupBy(*keys).agg(
        F.count("*").alias("num_trades"), (F.count_if(p > 0) / F.count("*") * 100).alias("win_rate_pct"),
        F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
        F.avg("holding_days").alias("avg_holding_days"), F.sum("pnl").alias("realised_pnl"),
    )


def run_metrics(curve: DataFrame, fills: DataFrame, initial: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """All measures of each run. ``num_trades`` are round trips, ``num_fills`` fills."""
    stats = equity_stats(curve, initial, keys)
    trips = round_trip_stats(round_trips(fills, keys), keys)
    filled = fills.groupBy(*keys).agg(F.count("*").alias("num_fills"), F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage"))
    out = stats.join(trips, _keys(keys), "left").join(filled, _keys(keys), "left")
    # Nulls alone become zero: a NaN is a measure of a run that bought at a price of zero.
    return out.select(*[F.col(c) if c in keys else F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in out.dtypes])


def turnover(fills: DataFrame, curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Traded value over mean equity, a year."""
    traded = fills.groupBy(*keys).agg(F.sum(F.abs("gross_value")).alias("traded"))
    mean = curve.groupBy(*keys).agg(F.avg("equity").alias("mean_equity"), F.count("*").alias("n"))
    ok = (F.col("mean_equity") > 0) & (F.col("n") > 0)
    return mean.join(traded, _keys(keys), "left").select(
        *keys,
        F.when(ok, F.try_divide(F.try_divide(F.coalesce("traded", F.lit(0.0)), F.col("mean_equity")), F.col("n") / float(YEAR))).otherwise(0.0).alias("turnover"),
    )


def bar_returns(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return of every bar but the first; 0 after a bar of no equity."""
    before = F.lag("equity").over(W.partitionBy(*keys).orderBy("ts"))
    idx = F.row_number().over(W.partitionBy(*keys).orderBy("ts")) - 2
    ret = F.when(before == 0, 0.0).otherwise((F.col("equity") - before) / before)
    return curve.select(*keys, "ts", idx.alias("obs_idx"), ret.alias("ret")).where("ret is not null")


def compound(value: Column) -> Column:
    """Aggregate of percent returns: their compounded return as a fraction."""
    return F.product(1 + value / 100) - 1


def by_symbol(trips: DataFrame, initial: float) -> DataFrame:
    """Profit, share of the initial capital, trips and win rate of each symbol of a basket."""
    return trips.groupBy("symbol").agg(
        F.sum("pnl").alias("realised_pnl"), (F.sum("pnl") / initial * 100).alias("contribution_pct"),
        F.count("*").alias("trips"), (F.count_if(F.col("pnl") > 0) / F.count("*") * 100).alias("win_rate_pct"),
    )


def dominance(parts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The symbol behind most of the positive contribution, and whether it is more than ``threshold`` of it."""
    gain = F.greatest(F.col("contribution_pct"), F.lit(0.0))
    share = F.try_divide(F.max(gain), F.sum(gain))
    return parts.agg(
        F.max_by("symbol", F.struct(gain, F.col("symbol"))).alias("symbol"), F.coalesce(share, F.lit(0.0)).alias("share"),
        F.coalesce(share > threshold, F.lit(False)).alias("dominant"),
    )


#: Ranges of scores that ranks are summed over first; a range's distinct scores are sorted by one task.
SCORE_RANGES = 4096


def roc_auc_and_brier(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AUC by rank sums with average ranks, and Brier score, of probabilities ``(p, label)``; null AUC for one class.

    Ranks are prefix sums: over ranges of scores, a bounded number of rows, and inside each range.
    """
    part = F.greatest(F.lit(0), F.least(F.lit(SCORE_RANGES - 1), F.floor(F.col("p") * SCORE_RANGES))).cast("int")
    ties = scored.groupBy(*keys, part.alias("_range"), "p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    by = [*keys, "_range"]
    ranges = ties.groupBy(*by).agg(F.sum("n").alias("_in"))
    along = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(*by, F.coalesce(F.sum("_in").over(along), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*by).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    below = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    same = F.lit(True)
    named = starts.withColumnsRenamed({c: f"_own_{c}" for c in by})
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    ranked = ties.join(named, same).withColumn("rank", below + (F.col("n") + 1) / 2)
    pos, total = F.sum("pos"), F.sum("n")
    auc = F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * (total - pos))
    out = ranked.groupBy(*keys).agg(auc.alias("auc"), total.alias("n"))
    brier = scored.groupBy(*keys).agg(F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"))
    return out.join(brier, list(keys)) if keys else out.crossJoin(brier)
