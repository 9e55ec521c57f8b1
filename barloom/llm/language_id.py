"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it has a binary classifier, a log-odds model over hashed
n-grams of the lower-cased letters. A text's bits are decoded by loss: the languages' exponential losses
are weighted by how well each bit separates that language in training, and the nearest codeword wins. A
small lead over the next language flags the prediction as ambiguous.

Training reads a bounded sample of labelled rows: at most about ``SAMPLE_PER_LANGUAGE`` for each
language, chosen by a hash of doc_id, whole texts. The ``MOST_LANGUAGES`` most frequent labels are learned, equal
counts by name; so what reaches the driver and a task is bounded also where labels are dirty. Prediction reads every row and whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if there
is nothing to learn from. Rows with a null doc_id count as held out. Repeated rows are predicted alike.
An empty table gives an empty result. Only doc_id, text and, for training, lang are looked at.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
SAMPLE_PER_LANGUAGE = 3000
MOST_LANGUAGES = 256
FOLDS = 5
#: A lead of less than this over the next language's score makes a prediction ambiguous.
AMBIGUOUS_LEAD = 0.05
UNKNOWN = "und"

_SPACED = bytes(
    c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def hashed_ngrams(text: str, features: int = FEATURES) -> np.ndarray:
    """Slots of all 2-, 3- and 4-grams of the lower-cased UTF-8 bytes; runs of non-letters are one space."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", "u1").astype("u4")
    grams, out = data, []
    for n in (2, 3, 4):
        grams = (grams[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        out.append((grams * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - int(math.log2(features))))
    return np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: exhaustive for few, else random with wide distances."""
    if n <= 1:
        return np.ones((n, 1), "f4")
    if n <= 6:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, "f4").T
    width, pick, best, apart = 4 * math.ceil(math.log2(n)) + 8, random.Random(n), None, -1
    for _ in range(50):
        code = np.array([[pick.choice((-1, 1)) for _ in range(width)] for _ in range(n)], "f4")
        least = int(((width - code @ code.T) / 2 + np.eye(n) * width).min())
        if least > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits: log odds of each n-gram
    scale: np.ndarray  # bits: the margin that training texts have on average
    trust: np.ndarray  # languages x bits: how far that language's margin stands out, summing to 1

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the next language is as near."""
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, False
        grams = hashed_ngrams(text)
        margin = np.zeros(self.weights.shape[1], "f8")
        for at in range(0, len(grams), 65536):
            margin += self.weights[grams[at : at + 65536]].sum(0, dtype="f8")
        margin = np.clip(margin / len(grams) / self.scale, -4, 4)
        loss = (self.trust * np.exp(-self.code * margin)).sum(1)
        odds = np.exp(-3 * (loss - loss.min()))
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        lead = odds[order[0]] - (odds[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(odds[order[0]]), bool(lead < AMBIGUOUS_LEAD)


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` outside the held-out fold.

    What reaches the driver is the model: a count for each language and n-gram slot.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counted_langs = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counted_langs.collect()}
    if not counts:
        return Model([], codewords(0), np.zeros((FEATURES, 1), "f4"), np.ones(1), np.ones((0, 1)))
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    sample = labelled.where((unit < rates[F.col("lang")]) & F.col("text").isNotNull()).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = hashed_ngrams(text.as_py())
                total = sums.setdefault(lang, np.zeros(FEATURES, "i8"))
                total += np.bincount(grams, minlength=FEATURES)
        for lang, total in sums.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots])],
                ["lang", "slot", "n"],
            )

    rows = (
        sample.mapInArrow(counted, "lang string, slot int, n long")
        .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(rows["lang"].unique())
    grams = np.zeros((len(languages), FEATURES), "f8")
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        grams[i, own["slot"].to_numpy()] = own["n"].to_numpy()
    return train(languages, grams)


def train(languages: list[str], grams: np.ndarray) -> Model:
    """The model from n-gram counts by language (languages x slots)."""
    share = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * grams.shape[1]) if languages else grams
    code = codewords(len(languages))
    if len(languages) < 2:
        ones = np.ones((len(languages), 1))
        return Model(languages, code, np.zeros((grams.shape[1], 1), "f4"), np.ones(1), ones)
    weights = np.stack(
        [np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)) for bit in code.T], axis=1
    )
    margin = (share @ weights) * code  # how far each language's texts stand on the right side, bit by bit
    scale = np.maximum(np.abs(margin).mean(0), 1e-6)
    trust = np.maximum(margin / scale, 0.05)
    return Model(languages, code, weights.astype("f4"), scale, trust / trust.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row; the model is a few MB at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            langs, scores, unsure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        named, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def identify(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict every row."""
    return predict(docs, fit(docs, sample_per_language)).withColumn("held_out", held_out(F.col("doc_id")))


def drop_unidentified(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, with all their columns.

    The text is judged where its row is read: nothing is joined back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_per_language))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in found], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
