"""Linear recurrences ``y = a y + b`` along a symbol's bars, as window columns over blocks of bars.

A run of bars maps the value before it to the value after it by ``y -> A y + B``, and such pairs compose. Bars are numbered
and cut into blocks of ``BLOCK``; inside a block the running B of a constant a is ``a^k sum(b a^-k)``, a window sum. The
blocks' pairs, one row a block, are composed in order into each block's start, which is applied back to its bars. So a
symbol's bars are spread over tasks, and what one task sees of a whole symbol is a row for ``BLOCK`` bars.

A start looks back as far as powers of a differ from 0 in a double, so the result is that of the plain recursion but
for rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

BLOCK = 256  # bars; a^-BLOCK must be a double: a of 0.07 or more
BUCKET_DAYS = 366  # for numbering only: the bars of a bucket are sorted together
_SMALLEST = 745.2  # exp(-745.2) is 0 in doubles


def number_bars(bars: DataFrame, *before: str) -> DataFrame:
    """``bars`` with ``_pos``, a bar's place in its symbol from 0, ``_block`` and ``_k`` (from 1), its place in the block.

    For each column of ``before`` the value of the bar before comes along as ``_before_<column>``. Numbers inside buckets of
    dates are added to the sizes of the buckets before, so no task sorts a symbol's bars.
    """
    bucket = F.floor(F.unix_date(F.col("ts").cast("date")) / BUCKET_DAYS)
    inside = W.partitionBy("symbol", "_bucket").orderBy("ts")
    cut = bars.withColumn("_bucket", bucket)
    sizes = cut.groupBy("symbol", "_bucket").agg(
        F.count("*").alias("_n"), *[F.max_by(c, "ts").alias(f"_last_{c}") for c in before]
    )
    along = W.partitionBy("symbol").orderBy("_bucket")
    starts = sizes.select(
        F.col("symbol").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        *[F.lag(f"_last_{c}").over(along).alias(f"_carried_{c}") for c in before],
    )
    placed = cut.withColumns(
        {"_row": F.row_number().over(inside) - 1} | {f"_before_{c}": F.lag(c).over(inside) for c in before}
    ).join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    pos = F.col("_start") + F.col("_row")
    return placed.select(
        *bars.columns, pos.alias("_pos"), F.floor(pos / BLOCK).alias("_block"), (pos % BLOCK + 1).alias("_k"),
        *[F.when(F.col("_row") > 0, F.col(f"_before_{c}")).otherwise(F.col(f"_carried_{c}")).alias(f"_before_{c}") for c in before],
    )


def blocks_back(a: float) -> int:
    """How many blocks back a value still counts."""
    return 1 if a <= 0 else max(1, math.ceil(_SMALLEST / -math.log(a) / BLOCK) + 1)


def linear_scan(numbered: DataFrame, steps: dict[str, tuple[float, Column]], fold: bool = False) -> DataFrame:
    """``numbered`` bars with a column for each of ``steps``: its factor a (0.07 to below 1) and the added b of a bar.

    The value before the first bar is 0: a recurrence that starts with a value adds it, and 0 before. With ``fold`` a
    block's bars are folded one after the other, which rounds as the plain recursion does, at ``BLOCK / 2`` steps a bar.
    """
    if any(not 0.07 <= a < 1 for a, _ in steps.values()):
        raise ValueError("factors are between 0.07 and 1")
    inside = W.partitionBy("symbol", "_block").orderBy("_pos")
    power = lambda a, k: F.pow(F.lit(a), k)

    def folded(added: Column, a: float, start: Column) -> Column:
        return F.aggregate(F.collect_list(added).over(inside.rowsBetween(W.unboundedPreceding, 0)), start, lambda y, x: y * a + x)

    # Both the blocks' ends and their bars read what is written here, so the bars are made once.
    own = written(numbered.withColumns(
        {f"_own_{name}": folded(b, a, F.lit(0.0)) for name, (a, b) in steps.items()} if fold else {f"_own_{name}": F.sum(b * power(a, -F.col("_k"))).over(inside) * power(a, F.col("_k")) for name, (a, b) in steps.items()}
    ), "scan")
    ends = own.groupBy("symbol", "_block").agg(
        F.max("_k").alias("_n"), *[F.max_by(f"_own_{name}", "_pos").alias(f"_end_{name}") for name in steps]
    )

    def start(name: str, a: float) -> Column:
        pairs = F.collect_list(F.struct(power(a, F.col("_n")).alias("a"), F.col(f"_end_{name}").alias("b")))
        before = pairs.over(W.partitionBy("symbol").orderBy("_block").rowsBetween(-blocks_back(a), -1))
        return F.aggregate(before, F.lit(0.0), lambda y, p: y * p["a"] + p["b"]).alias(f"_start_{name}")

    starts = ends.select(F.col("symbol").alias("_s"), F.col("_block").alias("_b"), *[start(n, a) for n, (a, _) in steps.items()])
    joined = own.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    if fold:
        return joined.select(*numbered.columns, *[folded(b, a, F.col(f"_start_{n}")).alias(n) for n, (a, b) in steps.items()])
    return joined.select(
        *numbered.columns,
        *[(F.col(f"_own_{n}") + power(a, F.col("_k")) * F.col(f"_start_{n}")).alias(n) for n, (a, _) in steps.items()],
    )
