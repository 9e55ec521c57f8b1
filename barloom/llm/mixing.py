"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source the keys are cut into ranges of about equal
size; sums of the ranges give each range's place in the source (a distributed prefix sum), and a window
inside each small range gives each document's place. A source's budget then covers a number of whole
epochs and a prefix of one more, cut inside a document where the budget ends.

Defined cases: a null text has no words; documents without words take nothing; a null source is a
source of its own, after all others; repeated rows are separate documents; an empty table gives an empty
result. Only doc_id, source and text are looked at; other columns are carried by mix_documents().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialize, shuffle_width

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space unchanged."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``sizes(source, source_size, n)`` with each source's weight and target.

    Weights repeat over the sources by code point. Targets share ``share`` of all sizes by weight and
    stop at ``most`` times the source's size; the excess goes to the others by weight until none is
    above. With the sources in order of size over weight, those that stop are a prefix, so one pass of
    prefix sums finds the common rate of the rest. There is a row a source here, not a document.
    """
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(cycle, ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    )
    rising = W.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything)
    rated = ranked.withColumn(
        "rate",
        (total * share - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    ).withColumn("place", F.row_number().over(rising))
    free = F.col("rate") * F.col("weight") <= most * F.col("source_size")
    rate = F.min(F.when(free, F.struct("place", "rate"))).over(everything)["rate"]
    cap = most * F.col("source_size")
    return rated.withColumn("common", rate).select(
        "source", "sid", "weight", "source_size", "n",
        F.coalesce(F.least(cap, F.col("common") * F.col("weight")), cap).alias("target"),
    )


def _planned(
    docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: str, carry: bool
) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs if carry else docs.select("doc_id", "source", "text")
    keyed = keyed.withColumns(
        {
            "_mix_size": word_count(F.col("text")),
            "_mix_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    )
    if carry:
        sized = keyed.select("source", "_mix_size")
    else:
        sized = keyed = materialize(keyed.drop("text"), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count("*").alias("n"))
    targets = materialize(source_targets(materialize(sizes, "sources"), weights, share, most), "targets")
    # About three ranges for every shuffle partition, in proportion to the sources' documents.
    total = targets.agg(F.sum("n")).first()[0] or 0
    width = max(1, -(-total // (3 * shuffle_width(spark))))
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    plan = targets.select(
        F.col("source").alias("_mix_source"), F.col("sid").alias("_mix_sid"),
        F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
        F.ceil(F.col("n") / width).alias("_mix_ranges"), whole.alias("_mix_epochs"),
        (budget - whole * F.col("source_size")).alias("_mix_rest"),
    )
    unit = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("double") / 4294967296.0
    keyed = keyed.join(plan, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn(
        "_mix_range", F.floor(unit * F.col("_mix_ranges")).cast("long")
    )
    ranges = keyed.groupBy("_mix_sid", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"))
    along = W.partitionBy("_mix_sid").orderBy("_mix_range").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(
        ranges.select(
            F.col("_mix_sid").alias("_mix_sid2"), F.col("_mix_range").alias("_mix_range2"),
            F.coalesce(F.sum("_mix_sum").over(along), F.lit(0)).alias("_mix_start"),
        ),
        "starts",
    )
    inside = W.partitionBy("_mix_sid", "_mix_range").orderBy("_mix_key", "doc_id", "_mix_size")
    earlier = F.coalesce(F.sum("_mix_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(
        starts,
        (F.col("_mix_sid") == F.col("_mix_sid2")) & (F.col("_mix_range") == F.col("_mix_range2")),
    ).withColumn("_mix_before", F.col("_mix_start") + earlier)
    part = F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_rest") - F.col("_mix_before")))
    return placed.withColumn("_mix_taken", (F.col("_mix_epochs") * F.col("_mix_size") + part).cast("long"))


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED
) -> DataFrame:
    """How many words of each document the mix takes; see the module for the defined cases."""
    return _planned(docs, weights, share, most, seed, carry=False).select(
        "doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"),
    )


def mix_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED
) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, its last one cut where the budget ends."""
    # Further columns travel in a struct, so that none of their names can clash.
    more = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    packed = docs.select("doc_id", "source", "text", F.struct(*more, F.lit(0)).alias("_mix_more"))
    planned = _planned(packed, weights, share, most, seed, carry=True)
    size, taken = F.col("_mix_size"), F.col("_mix_taken")
    rows = planned.where(taken > 0).withColumn(
        "_mix_epoch", F.explode(F.sequence(F.lit(0), (F.ceil(taken / size) - 1).cast("int")))
    )
    words = F.least(size, taken - F.col("_mix_epoch") * size)
    text = F.when(words < size, first_words(F.col("text"), words)).otherwise(F.col("text"))
    rows = rows.withColumn("_mix_text", text)
    own = {c: F.col(c) for c in ("doc_id", "source")} | {"text": F.col("_mix_text")}
    own |= {c: F.col(f"_mix_more.`{c}`") for c in more}
    if "n_chars" in more:
        own["n_chars"] = F.length("_mix_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own[c].alias(c) for c in docs.columns])
