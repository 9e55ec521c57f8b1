"""Personal data by rules and by bootstrapped contexts, with DataFrame functions only.

The base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers; a further one finds
keys of 32 hexadecimal digits or more, which are secrets. Their finds are seeds; what a rule matches and then
refuses (a card of a wrong check digit, an address with a part over 255) are counterexamples. Tokens with a digit
or an at sign are instances, without the quotes and brackets around them and without a key before ``=`` or ``:``.
Four lexical patterns are induced from where an instance stands: the two words before it and the two after it
(within ``CONTEXT_CHARS`` code points, on its side of the next match), its key, and its own shape. Patterns
that introduce fewer than ``MIN_SEEDS`` different instances could never be accepted and are left out. The others
make a weighted graph with their instances whose scores Spark computes in rounds: a pattern is as good as the
instances that it introduces, and to it an instance is as good as the best of the other sorts of pattern makes it, so
that no pattern vouches for itself; seeds stay at one, counterexamples at zero. Patterns above ``ACCEPT`` with enough different instances of that score behind them, seeds or found,
mark the tokens that no rule found; a token that patterns of several kinds mark goes to the kind of the best.

Offsets are code points. They come from the lengths of what a split leaves and of what matched, and both
walk the same matches, in blocks whose offsets are added up after. The rules are written so that no text makes
them backtrack: repetitions are possessive, and runs are entered at their start or where the last match ended.

Defined cases: a null text counts as empty; a text without finds has zero counts and empty lists; repeated
rows each get their own result; equal starts are ordered by kind. An empty table gives an empty result.
Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tidy, is_empty, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that rules find. Secrets aren't personal data and have columns of their own.
RULED = (*KINDS, "secret")
#: The rules, as patterns that match what the plain ones match, in time linear in the text.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_SPACE = r"\x20\x09-\x0D"
FIRST_WORDS = rf"^[{_SPACE}]*[^{_SPACE}]+(?:[{_SPACE}]+[^{_SPACE}]+)?"
TOKEN = rf"(?<![^{_SPACE}])(?=[^{_SPACE}]*[0-9@])[^{_SPACE}]+"
LAST_WORDS = rf"(?:[^{_SPACE}]+[{_SPACE}]+)?[^{_SPACE}]+[{_SPACE}]*$"
#: Code points before and after a token in which its context is looked for.
CONTEXT_CHARS = 80
ROUNDS, ACCEPT, MIN_SEEDS, PRIOR = 8, 0.8, 5, 1.0
#: The sorts of pattern.
SORTS = ("left", "right", "key", "shape")
#: Letters and digits of this length are of one shape by their alphabet; others by their runs.
LONG_VALUE = 12
#: Matches whose offsets are added up in one go.
BLOCK = 128
_KEY = r"^[A-Za-z][A-Za-z_-]*+[=:]+[\"'(\[{<]*"
_LEAD, _TAIL = r"^[\"'(\[{<]+", r"[.,;:!?)\]}>'\"#*]+$"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, r"[^0-9]", "")
    if kind == "ip":
        return found.rlike(IP_PARTS)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        place = F.sequence(F.lit(1), F.length(digits))

        def worth(i: Column) -> Column:
            digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
            twice = digit * 2
            return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

        total = F.aggregate(F.transform(place, worth), F.lit(0), lambda a, b: a + b)
        return F.length(digits).between(16, 19) & (total % 10 == 0)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Fa-f]")
    return F.lit(True)


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["found"])


def _refuser(kind: str) -> Callable[[Column], Column]:
    return lambda x: ~_valid(kind, x["found"])


SPAN = "struct<start:int,stop:int,found:string,before:string,after:string>"
#: What a rule matched and refused, as (kind, start, stop, found, after).
RULED_SPAN = "struct<kind:string,start:int,stop:int,found:string,after:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def shape(value: Column) -> Column:
    """What a lower-cased token is made of: a long one its alphabet, others runs of letters and each digit."""
    long = F.length(value) >= LONG_VALUE
    both = value.rlike("[0-9]") & value.rlike("[a-z]")
    runs = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")
    return (
        F.when(long & both & value.rlike("^[0-9a-f]+$"), "hexadecimal").when(long & both & value.rlike("^[0-9a-z]+$"), "letters and digits")
        .otherwise(F.when(F.length(runs) <= CONTEXT_CHARS, runs).otherwise(F.sha2(runs, 256)))
    )


def spans(text: Column, pattern: str) -> Column:
    """All matches with their offsets and the ends of what stands between each and its neighbours, as an array."""
    pieces = F.split(text, pattern, -1)
    steps = _let(pieces, lambda between: F.arrays_zip(
        between.alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.slice(between, F.lit(2), F.size(between)).alias("next"),
    ))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        stop = start + F.length(x["found"])
        span = F.struct(
            start.alias("start"), stop.alias("stop"), x["found"].alias("found"),
            F.right(x["between"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["next"], F.lit(CONTEXT_CHARS)).alias("after"),
        )
        more = F.concat(acc["spans"], F.array(span))
        return F.struct(
            F.coalesce(stop, start).alias("at"), F.when(x["found"].isNull(), acc["spans"]).otherwise(more).alias("spans")
        )

    def ends(blocks: Column) -> Column:
        """Where each block starts: the sum of the lengths before it."""
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            blocks, empty,
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"],
        )

    def moved(block: Column, by: Column) -> Column:
        return F.transform(
            block["spans"],
            lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after")),
        )

    def all_blocks(s: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(s), F.lit(BLOCK))
        return F.transform(firsts, lambda at: F.aggregate(F.slice(s, at, F.lit(BLOCK)), none, step))

    joined = lambda blocks: F.flatten(F.zip_with(blocks, ends(blocks), moved))
    return _let(steps, lambda s: _let(all_blocks(s), joined))


def _guarded(kind: str, text: Column) -> Column:
    """A cheap test that lets most texts through without looking for spans."""
    if kind == "email":
        return F.instr(text, "@") > 0
    if kind == "phone":
        return F.instr(text, "+") > 0
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "secret":
        return text.rlike("[0-9A-Fa-f]{32}")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")


def scan(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, email, ip, card, phone, secret, refused, tokens)`` of every row, written.

    The kinds hold base spans, refused what their rules matched in vain, tokens the candidates.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast(f"array<{SPAN}>")
    found = {kind: F.when(_guarded(kind, text), spans(text, RULES[kind])).otherwise(empty) for kind in RULED}
    tokens = F.when(text.rlike("[0-9@]"), spans(text, TOKEN)).otherwise(empty)
    rows = docs.select("doc_id", *[c.alias(k) for k, c in found.items()], tokens.alias("tokens"))
    matched = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    # Only the written matches are looked at twice.
    refused = F.concat(*[_found(k, F.filter(k, _refuser(k))) for k in RULED])
    return matched.select(
        "row", "doc_id", *[F.filter(k, _validator(k)).alias(k) for k in RULED],
        F.coalesce(refused, F.array().cast(f"array<{RULED_SPAN}>")).alias("refused"), "tokens",
    )


def _found(kind: str, matches: Column) -> Column:
    return F.transform(
        matches,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lower(x["found"]).alias("found"),
            x["after"].alias("after"),
        ),
    )


def ruled_spans(scanned: DataFrame) -> DataFrame:
    """``(row, kind, start, stop, found, after, seed)``: what the rules found, seed 1, and what they refused, seed 0."""
    kept = scanned.select("row", F.explode(F.concat(*[_found(k, F.col(k)) for k in RULED])).alias("s"), F.lit(1.0).alias("seed"))
    refused = scanned.select("row", F.explode("refused").alias("s"), F.lit(0.0).alias("seed"))
    return kept.unionByName(refused).select("row", "s.*", "seed")


def _words(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)), rf"[{_SPACE}]+", " "))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """``(row, start, stop, instance, patterns, kind, seed)``: tokens outside ruled spans, and ruled spans where a token starts."""
    bare = F.regexp_replace("t.found", _LEAD, "")
    tokens = scanned.select("row", F.explode("tokens").alias("t")).select(
        "row", "t", F.length(F.regexp_extract("t.found", _LEAD, 0)).alias("lead"), bare.alias("bare"), F.regexp_extract(bare, _KEY, 0).alias("key"),
    ).withColumn("value", F.substring(F.col("bare"), F.length("key") + 1, F.length("bare"))).select(
        "row", (F.col("t.start") + F.col("lead") + F.length("key")).alias("start"),
        (F.col("t.stop") - F.length(F.regexp_extract("value", _TAIL, 0))).alias("stop"), F.col("t.stop").alias("whole_stop"),
        F.lower(F.regexp_replace("value", _TAIL, "")).alias("instance"), F.lower("key").alias("key"),
        _words(F.col("t.before"), LAST_WORDS).alias("left"), F.col("t.after").alias("after"),
    )
    ruled = ruled_spans(scanned)
    # Of spans with one start a find goes before a refusal.
    first = ruled.groupBy("row", "start").agg(
        F.min(F.struct((-F.col("seed")).alias("order"), "kind", "found", "after", "seed")).alias("base")
    )
    joined = tokens.join(first, ["row", "start"], "left")
    # A ruled span that doesn't start with its token (a bracket before it, say) still covers the token.
    blank = [F.lit(None).cast(t).alias(c) for c, t in joined.dtypes if c not in ("row", "start")]
    ends = ruled.select("row", "start", *blank, F.col("stop").alias("cover"))
    events = joined.withColumn("cover", F.lit(None).cast("int")).unionByName(ends)
    by_row = W.partitionBy("row").orderBy("start", F.col("cover").isNull())
    ahead = F.min(F.when(F.col("cover").isNotNull(), F.col("start"))).over(by_row.rowsBetween(0, W.unboundedFollowing))
    events = events.withColumn("covered", F.max("cover").over(by_row)).withColumn("next_base", ahead)
    clear = F.coalesce(F.col("covered") <= F.col("start"), F.lit(True)) & F.coalesce(
        F.col("next_base") >= F.col("whole_stop"), F.lit(True)
    )
    instance = F.coalesce("base.found", "instance")
    right = _words(F.coalesce("base.after", "after"), FIRST_WORDS)
    said = {"left": F.col("left"), "right": right, "key": F.col("key"), "shape": shape(instance)}
    patterns = F.array(*[F.struct(F.lit(of).alias("of"), what.alias("said")) for of, what in said.items()])
    return events.where(F.col("instance").isNotNull() & (F.col("base").isNotNull() | clear)).select(
        "row", "start", "stop", instance.alias("instance"), F.filter(patterns, lambda p: p["said"] != "").alias("patterns"),
        F.col("base.kind").alias("kind"), F.col("base.seed").alias("seed"),
    ).where("instance <> ''")


def discover(scanned: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``(row, kind, start, stop)`` of tokens that only their contexts and shapes give away."""
    seen = materialize(_occurrences(scanned), "occurrences")
    seeds = materialize(
        seen.where("kind is not null").groupBy("instance", "kind").agg(F.max("seed").alias("seed")), "seeds"
    )
    if is_empty(seeds.where("seed > 0")):
        return scanned.select("row", F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    met = seen.select("instance", F.explode("patterns").alias("pattern"))
    all_edges = materialize(met.groupBy("pattern", "instance").agg(F.count("*").cast("double").alias("n")), "all-edges")
    # A pattern of fewer instances can't be accepted.
    weight = materialize(
        all_edges.groupBy("pattern").agg(F.sum("n").alias("pattern_n"), F.count("*").alias("instances"))
        .where(F.col("instances") >= min_seeds).drop("instances"), "pattern-weights"
    )
    edges = materialize(all_edges.join(weight, "pattern", "left_semi"), "edges")
    of = F.col("pattern.of")
    degree = materialize(edges.groupBy("instance").agg(*[F.sum(F.when(of == t, F.col("n"))).alias(f"n_{t}") for t in SORTS]), "instance-weights")
    scores = seeds.select("instance", "kind", *[F.col("seed").alias(f"to_{t}") for t in SORTS])
    worth = F.coalesce(*[F.when(of == t, F.col(f"to_{t}")) for t in SORTS])
    for _ in range(rounds):
        patterns = (
            edges.join(scores, "instance").groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * worth).alias("mass"))
            .join(weight, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("pattern_n") + PRIOR)).alias("score"))
        )
        patterns = materialize(patterns, "patterns")
        said = {t: F.coalesce(F.col(f"mass_{t}") / F.col(f"n_{t}"), F.lit(0.0)) for t in SORTS}
        spread = (
            edges.join(patterns, "pattern").groupBy("instance", "kind")
            .agg(*[F.sum(F.when(of == t, F.col("n") * F.col("score"))).alias(f"mass_{t}") for t in SORTS])
            .join(degree, "instance")
            .select("instance", "kind", *[F.greatest(*[said[u] for u in SORTS if u != t]).alias(f"to_{t}") for t in SORTS])
        )
        scores = materialize(
            spread.join(seeds, ["instance", "kind"], "full_outer")
            .select("instance", "kind", *[F.coalesce("seed", f"to_{t}").alias(f"to_{t}") for t in SORTS]),
            "scores",
        )
    backing = (
        edges.join(scores, "instance").where(worth >= accept).groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
        .where(F.col("seeds") >= min_seeds)
    )
    good = patterns.where(F.col("score") >= accept).join(backing, ["pattern", "kind"]).select(
        "pattern", F.struct("score", "kind").alias("said")
    )
    good = materialize(good, "good-patterns")
    marked = seen.where("kind is null").select("row", "start", "stop", F.explode("patterns").alias("pattern")).join(good, "pattern")
    return marked.groupBy("row", "start", "stop").agg(F.max("said").alias("said")).select(
        "row", F.col("said.kind").alias("kind"), "start", "stop"
    )


def find_personal_data(docs: DataFrame, bootstrap: bool = True) -> DataFrame:
    """A row per document: doc_id, arrays of ruled spans by kind, and discovered spans (kind, start, stop)."""
    scanned = scan(docs)
    spans_type = "array<struct<kind:string,start:int,stop:int>>"
    bare = scanned.select("row", "doc_id", *RULED)
    if not bootstrap:
        return bare.withColumn("discovered", F.array().cast(spans_type)).drop("row")
    with Tidy() as tidy:
        found = materialize(discover(scanned), "discovered")
        tidy.keep(found)
    more = found.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("discovered"))
    return bare.join(more, "row", "left").withColumn(
        "discovered", F.coalesce(F.col("discovered"), F.array().cast(spans_type))
    ).drop("row")


def span_list(found: Column) -> Column:
    """kind:start:end of an array of (kind, start, stop), comma-joined in its order."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def tagged(kind: str) -> Column:
    return F.transform(
        F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    )


def all_spans(kinds: tuple[str, ...] = KINDS) -> Column:
    """Ruled and discovered spans by kind in the order of ``kinds``, then by start."""
    of = lambda kind: F.filter("discovered", lambda x: x["kind"] == kind)
    return F.concat(*[F.array_sort(F.concat(tagged(kind), of(kind))) for kind in kinds])
