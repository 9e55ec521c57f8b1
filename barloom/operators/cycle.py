"""The simulated account's daily passes: submit before the open, reconcile after the close, and what was expected.

Decisions, attribution, reconciliation and snapshots are DataFrames over keyed tables; what meets the broker is
one basket's orders of one day. Every pass can be run again: ids repeat, and a day's rows are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.snapshots import SnapshotTable
from .basket import HALT, BasketConfig, replay_basket
from .indicators import add_sizing
from .metrics import equity_stats
from .paper import SimulatedBroker, attribute_fills, modeled_opens, plan_cycle, portfolio_snapshot, reconcile, running_peak, skip_reason

ORDERS = "client_order_id string, deployment_id long, day string, symbol string, side string, quantity double, notional double, reference_price double, reason string, status string, filled_quantity double"
BROKER_ORDERS = "client_order_id string, status string, filled_quantity double"
BROKER_FILLS = "client_order_id string, fill_id string, symbol string, side string, quantity double, price double"
HELD = "symbol string, quantity double, entry_price double"


@dataclass(frozen=True)
class Deployment:
    """A strategy that trades a basket in a simulated account."""

    id: int
    symbols: tuple[str, ...]
    strategy: object
    capital: float = 100_000.0
    config: BasketConfig = BasketConfig()
    enabled: bool = True
    halted: bool = False


@dataclass(frozen=True)
class CycleResult:
    skipped: str | None = None
    orders: int = 0
    fills: int = 0
    reconciliations: int = 0
    halted: bool = False


class CycleStore:
    """The tables of the cycle under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        table = lambda name, *keys, by=(): SnapshotTable(spark, f"{folder}/{name}", keys, by)
        self.spark = spark
        self.orders = table("orders", "client_order_id")
        self.fills = table("fills", "client_order_id", "fill_id")
        self.snapshots = table("snapshots", "deployment_id", "day", by=("deployment_id", "day"))
        self.positions = table("positions", "deployment_id", "day", "symbol", by=("deployment_id", "day"))
        self.divergences = table("reconciliations", "deployment_id", "day", "kind", "symbol", "detail")

    def peak(self, deployment: Deployment) -> float:
        """The highest equity of earlier snapshots, else the capital."""
        if not self.snapshots.exists():
            return deployment.capital
        own = self.snapshots.read().where(F.col("deployment_id") == deployment.id)
        row = running_peak(own, deployment.capital).first()
        return row["peak"] if row else deployment.capital

    def replace_day(self, table: SnapshotTable, rows: DataFrame, deployment: Deployment, day: str) -> None:
        """The rows of one deployment's day, which are a partition of their own, instead of those that are there."""
        table.replace(rows, {"deployment_id": deployment.id, "day": day})


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _held(spark: SparkSession, broker: SimulatedBroker) -> DataFrame:
    return _frame(spark, [(s, q, e) for s, (q, e) in broker.positions.items()], HELD)


def _snapshots(store: CycleStore, broker: SimulatedBroker, deployment: Deployment, bars: DataFrame, day: str, peak: float) -> None:
    spark = store.spark
    held, marks = _held(spark, broker), bars.where(F.to_date("ts") <= F.lit(day).cast("date")).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    tag = {"deployment_id": F.lit(deployment.id).cast("long"), "day": F.lit(day)}
    valued = held.join(marks, "symbol", "left").withColumn("market_value", F.col("quantity") * F.coalesce("close", "entry_price"))
    store.replace_day(store.positions, valued.withColumns(tag), deployment, day)
    store.replace_day(store.snapshots, portfolio_snapshot(held, marks, broker.cash, peak).withColumns(tag), deployment, day)


def submit_pass(store: CycleStore, broker: SimulatedBroker, deployment: Deployment, frame: DataFrame, day: str, kill_switch: bool = False, market_open: bool = True) -> tuple[CycleResult, Deployment]:
    """Decide on the bars before ``day``, place orders for its open and record them; the deployment as it is after.

    ``frame`` has the indicators that the strategy needs, for more symbols or not.
    """
    why = skip_reason(deployment.enabled, deployment.halted, kill_switch, market_open)
    own = frame.where(F.col("symbol").isin(*deployment.symbols))
    if why is None and not own.take(1):
        why = "no data"
    if why:
        return CycleResult(skipped=why, halted=deployment.halted), deployment
    spark, cfg = store.spark, deployment.config
    decided = add_sizing(deployment.strategy.apply(own), cfg.target_vol, cfg.vol_lookback, cfg.max_position_pct)
    peak = store.peak(deployment)
    planned = plan_cycle(decided, _held(spark, broker), broker.cash, day, deployment.id, cfg, peak).collect()
    opens = {r["symbol"]: r["modeled"] for r in modeled_opens(own, day).collect()}
    rows = []
    for o in planned:
        done = broker.submit(o["client_order_id"], o["symbol"], o["side"], o["quantity"], opens.get(o["symbol"], o["reference_price"]))
        rows.append((o["client_order_id"], deployment.id, day, *[o[c] for c in ("symbol", "side", "quantity", "notional", "reference_price", "reason")], done["status"], done["filled_quantity"]))
    if rows:
        store.orders.upsert(_frame(spark, rows, ORDERS))
    _snapshots(store, broker, deployment, own, day, peak)
    halted = any(o["reason"] == HALT for o in planned)
    return CycleResult(orders=len(rows), halted=halted), replace(deployment, halted=deployment.halted or halted)


def reconcile_pass(store: CycleStore, broker: SimulatedBroker, deployment: Deployment, frame: DataFrame, day: str, kill_switch: bool = False) -> CycleResult:
    """Record the day's fills with their slippage, refresh its orders, note divergences and take the final snapshots.

    Runs again without harm: fills keep their ids, and a later run corrects what they are measured against.
    """
    why = skip_reason(deployment.enabled, False, kill_switch, True)
    if why:
        return CycleResult(skipped=why, halted=deployment.halted)
    spark, own = store.spark, frame.where(F.col("symbol").isin(*deployment.symbols))
    if not store.orders.exists():
        orders = _frame(spark, [], ORDERS)
    else:
        orders = written(store.orders.read().where((F.col("deployment_id") == deployment.id) & (F.col("day") == day)), "orders")
    tag = {"deployment_id": F.lit(deployment.id).cast("long"), "day": F.lit(day)}
    at_broker = _frame(spark, [(o["client_order_id"], o["status"], o["filled_quantity"]) for o in broker.orders.values()], BROKER_ORDERS)
    filled = _frame(spark, [tuple(f[c] for c in ("client_order_id", "fill_id", "symbol", "side", "quantity", "price")) for f in broker.fills], BROKER_FILLS)
    fills = attribute_fills(filled, orders, modeled_opens(own, day)).withColumns(tag)
    n_fills = store.fills.upsert(fills)
    now = at_broker.withColumnsRenamed({"status": "_status", "filled_quantity": "_filled"})
    fresh = orders.join(now, "client_order_id", "left").withColumns(
        {"status": F.coalesce("_status", "status"), "filled_quantity": F.coalesce("_filled", "filled_quantity")}
    ).drop("_status", "_filled")
    n_orders = orders.count()
    if n_orders:
        store.orders.upsert(fresh)
    basket = _frame(spark, [(s,) for s in deployment.symbols], "symbol string")
    noted = reconcile(orders, at_broker, _held(spark, broker), basket).withColumns(tag)
    store.replace_day(store.divergences, noted, deployment, day)
    _snapshots(store, broker, deployment, own, day, store.peak(deployment))
    return CycleResult(orders=n_orders, fills=n_fills, reconciliations=noted.count(), halted=deployment.halted)


def run_cycle(store: CycleStore, broker: SimulatedBroker, deployment: Deployment, frame: DataFrame, day: str, kill_switch: bool = False, market_open: bool = True) -> tuple[CycleResult, Deployment]:
    """Both passes of a day, one after the other."""
    first, after = submit_pass(store, broker, deployment, frame, day, kill_switch, market_open)
    if first.skipped:
        return first, after
    second = reconcile_pass(store, broker, after, frame, day, kill_switch)
    return replace(second, orders=first.orders, halted=after.halted), after


def expectation(deployment: Deployment, frame: DataFrame) -> DataFrame:
    """Measures of the deployment's configuration replayed over stored history; no row without data."""
    own = frame.where(F.col("symbol").isin(*deployment.symbols))
    curve = replay_basket(own, deployment.strategy, replace(deployment.config, initial_capital=deployment.capital)).where("kind = 'equity'")
    return equity_stats(curve.withColumn("deployment_id", F.lit(deployment.id).cast("long")).select("deployment_id", "ts", "equity", "position_value"), deployment.capital, ("deployment_id",))


def expected_and_live(deployment: Deployment, frame: DataFrame, store: CycleStore) -> DataFrame:
    """The replay's measures beside those of the account's own snapshots."""
    live = store.snapshots.read().where(F.col("deployment_id") == deployment.id).select(
        "deployment_id", F.col("day").cast("timestamp_ntz").alias("ts"), "equity", "position_value"
    )
    shown = equity_stats(live, deployment.capital, ("deployment_id",))
    names = [c for c in shown.columns if c != "deployment_id"]
    both = expectation(deployment, frame).withColumnsRenamed({c: f"expected_{c}" for c in names})
    return both.join(shown.withColumnsRenamed({c: f"live_{c}" for c in names}), "deployment_id", "full_outer")
