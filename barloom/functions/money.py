"""Fees, slippage, exits and metered costs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million input, output, cache-read and cache-write tokens, by model tier.
RATES = {"small": (1.0, 5.0, 0.1, 1.25), "medium": (3.0, 15.0, 0.3, 3.75)}
TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
BATCH_FACTOR = 0.5


def fee(notional: Column, bps: float) -> Column:
    return F.abs(notional) * bps / 10_000.0


def slipped(price: Column, side: Column, bps: float) -> Column:
    side = F.upper(side)
    return (
        F.when(side == "BUY", price * (1 + bps / 10_000.0)).when(side == "SELL", price * (1 - bps / 10_000.0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("null")))).cast("double"))
    )


def exit_signal(entry: Column, close: Column, stop: float | None, target: float | None) -> Column:
    """STOP or TARGET if the close has reached that level; the stop wins; null for unusable prices."""
    usable = (entry > 0) & ~F.isnan(entry) & (entry < float("inf")) & ~F.isnan(close)
    out = F.lit(None).cast("string")
    if target and target > 0:
        out = F.when(close >= entry * (1 + target), "TARGET")
    if stop and stop > 0:
        out = F.when(close <= entry * (1 - stop), "STOP").otherwise(out)
    return F.when(usable, out)


def drawdown_breached(peak: Column, equity: Column, threshold: float) -> Column:
    return F.coalesce((peak > 0) & ((peak - equity) / peak >= threshold), F.lit(False))


def metered_cost(usage: DataFrame, batch: bool = True, rates: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """``usage`` (model and any of the token columns) with ``cost_usd``; a model without rates raises."""
    table = F.create_map(
        *[F.lit(x) for model, prices in (rates or RATES).items() for x in (model, F.array(*map(F.lit, map(float, prices))))]
    )
    price = F.try_element_at(table, F.col("model"))
    spent = sum(
        (F.coalesce(F.col(c), F.lit(0)) * price[i] for i, c in enumerate(TOKEN_COLUMNS) if c in usage.columns), F.lit(0.0)
    )
    unknown = F.raise_error(F.concat(F.lit("no rates for model: "), F.coalesce("model", F.lit("null")))).cast("double")
    return usage.withColumn("cost_usd", F.when(price.isNull(), unknown).otherwise(spent / 1e6 * (BATCH_FACTOR if batch else 1.0)))
