"""Training and judging a classifier on the pooled panel, under purged walk-forward.

The estimator is a leaf-wise booster on histograms (boosting.py), stopped early by the AUC on the calibration fold, with a
calibration on that fold and thresholds chosen on a third. Another estimator goes through the same folds.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written
from ..sources.tables import model_id as name_of
from .boosting import BoosterConfig, Forest, fit_booster
from .evaluation import time_folds
from .features import FEATURES, finite, learnable
from .metrics import roc_auc_and_brier
from .news import NEWS_FEATURES

FEATURE_VERSION, NEWS_FEATURE_VERSION = "v1", "v1"
LOGISTIC_ITERATIONS, PARALLEL_SPLITS = 1000, 8


class TrainingError(ValueError):
    """Data that no model can be learned from."""


class VersionError(ValueError):
    """A model of other features than these."""


class IntegrityError(ValueError):
    """A saved model that isn't what was saved."""


#: Trees where there is no watch fold to stop the boosting early.
UNWATCHED_TREES = 100
ROWS_A_TASK = 100_000


@dataclass(frozen=True)
class TrainingConfig:
    """``estimator`` makes another learner than the boosted trees; it is fitted without weights.

    ``calibration`` is isotonic, sigmoid or none. With ``stop_early`` the calibration fold is the watch set:
    boosting ends when its AUC hasn't risen for ``stop_rounds`` trees, and the trees after the best are dropped.
    """

    horizon: int = 5
    fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)
    trees: int = 400
    depth: int = 4
    leaves: int = 15
    rate: float = 0.03
    min_rows: int = 30
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    calibration: str = "isotonic"
    stop_early: bool = True
    stop_rounds: int = 50
    min_calibration: int = 10
    cost_bps: float = 10.0
    enter_lo: float = 0.5
    enter_hi: float = 0.7
    enter_step: float = 0.02
    min_selected: int = 20
    hysteresis: float = 0.05
    seed: int = 42
    estimator: Callable[[TrainingConfig, int], list] | None = None

    def __post_init__(self) -> None:
        if self.calibration not in ("isotonic", "sigmoid", "none"):
            raise TrainingError(f"unknown calibration: {self.calibration}")


@dataclass
class TrainedModel:
    learner: PipelineModel | Forest
    calibration: object
    enter: float
    leave: float
    metadata: dict
    provenance: dict = field(default_factory=dict)

    def score(self, rows: DataFrame, column: str = "p_up") -> DataFrame:
        """``rows`` with the probability of the up class; null where a feature is null, infinite or NaN."""
        raw = _raw_scores(self.learner, rows.withColumn("_ready", finite(self.metadata["features"])), self.metadata["features"])
        p = F.col("_p")
        if self.calibration is not None:
            raw = self.calibration.transform(raw)
            p = vector_to_array("_sigmoid")[1] if "_sigmoid" in raw.columns else F.col("_calibrated")
        return raw.select(*rows.columns, F.when(F.col("_ready"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias(column))

    @property
    def id(self) -> str:
        return name_of(self.metadata)


def _raw_scores(learner: PipelineModel | Forest, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the learner's probability ``_p``, before any calibration; features that are no finite number count as 0."""
    if isinstance(learner, Forest):
        return rows.withColumn("_p", learner.probability())
    own = [F.col(c).alias(f"_own_{c}") for c in features]
    filled = rows.select("*", *own).withColumns({c: F.when(finite([c]), F.col(c)).otherwise(0.0) for c in features})
    scored = learner.transform(filled).withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*[F.col(f"_own_{c}").alias(c) if c in features else F.col(c) for c in rows.columns], "_p")


def booster_config(cfg: TrainingConfig, watched: bool) -> BoosterConfig:
    """Trees that nothing watches are fewer."""
    trees = cfg.trees if watched or not cfg.stop_early else min(cfg.trees, UNWATCHED_TREES)
    return BoosterConfig(
        trees=trees, rate=cfg.rate, leaves=cfg.leaves, depth=cfg.depth, min_rows=cfg.min_rows, row_share=cfg.row_share,
        column_share=cfg.column_share, l2=cfg.l2, stop_rounds=cfg.stop_rounds, seed=cfg.seed,
    )


def logistic_stages(cfg: TrainingConfig, n: int) -> list:
    """Stages of a scaled logistic regression for ``n`` rows: the simplest learner to beat. Penalty one over n."""
    return [
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True),
        LogisticRegression(
            featuresCol="_scaled", labelCol="label", regParam=1 / max(1, n), maxIter=LOGISTIC_ITERATIONS, standardization=False
        ),
    ]


def _calibration(kind: str, fold: DataFrame):
    """A fitted map from ``_p`` to ``_calibrated``; rows count alike."""
    if kind == "isotonic":
        return IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(fold)
    stages = [
        VectorAssembler(inputCols=["_p"], outputCol="_score"),
        LogisticRegression(
            featuresCol="_score", labelCol="label", maxIter=LOGISTIC_ITERATIONS, rawPredictionCol="_margin",
            probabilityCol="_sigmoid", predictionCol="_side",
        ),
    ]
    return Pipeline(stages=stages).fit(fold)


def train_until(panel: DataFrame, train_end: date | str | None = None) -> DataFrame:
    """Panel rows decided on the day ``train_end`` or before it; all without one."""
    if train_end is None:
        return panel
    kept = panel.where(F.col("decision_ts") < F.date_add(F.lit(str(train_end)).cast("date"), 1))
    if not kept.take(1):
        raise TrainingError(f"no panel rows until {train_end}")
    return kept


def train_model(panel: DataFrame, cfg: TrainingConfig | None = None, features: list[str] | None = None) -> TrainedModel:
    """Fit, calibrate and choose thresholds on three folds by date, each purged against the next. All rows are ``learnable``."""
    cfg, features = cfg or TrainingConfig(), features or FEATURES
    folds = time_folds(panel, cfg.fractions).withColumn("_watch", F.col("fold") == 1).cache()
    try:
        sizes = {r["fold"]: r for r in folds.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes"), F.max("decision_ts").alias("last")).collect()}
        if 0 not in sizes or sizes[0]["classes"] < 2:
            raise TrainingError("the fit fold has one class only")
        # Every pass over a fold is a job: small folds are read by few tasks.
        of = lambda *own: folds.where(F.col("fold").isin(*own)).coalesce(max(1, -(-sum(sizes[i]["n"] for i in own if i in sizes) // ROWS_A_TASK)))
        two_sided = 1 in sizes and sizes[1]["classes"] == 2
        if cfg.estimator:
            vector = VectorAssembler(inputCols=features, outputCol="_features")
            learner = Pipeline(stages=[vector, *cfg.estimator(cfg, sizes[0]["n"])]).fit(of(0))
        else:
            watched = two_sided and cfg.stop_early
            learner = fit_booster(of(0, 1) if watched else of(0), features, booster_config(cfg, two_sided), "_watch" if watched else None, ("symbol", "decision_ts"))
        calibration = None
        if cfg.calibration != "none" and two_sided and sizes[1]["n"] >= cfg.min_calibration:
            calibration = _calibration(cfg.calibration, _raw_scores(learner, of(1), features).select("_p", "label"))
        # What was learned, without the names that every fit draws anew, so that equal models have equal ids.
        described = learner.described() if isinstance(learner, Forest) else str(getattr(learner.stages[-1], "coefficients", ""))
        settings = asdict(cfg) | {"estimator": getattr(cfg.estimator, "__name__", None)}
        meta = {
            "features": features, "feature_version": FEATURE_VERSION, "versions": component_versions(features), "config": settings,
            "n": {str(k): v["n"] for k, v in sorted(sizes.items())},
            "train_end": str(max(v["last"] for v in sizes.values())),
            "calibrated": cfg.calibration if calibration is not None else None,
            "learned_sha256": hashlib.sha256(described.encode()).hexdigest(),
        }
        model = TrainedModel(learner, calibration, cfg.enter_lo, max(0.0, cfg.enter_lo - cfg.hysteresis), meta)
        scored = model.score(of(2)).withColumnRenamed("p_up", "p")
        best = select_threshold(scored, cfg).first()
        if best is not None and best["enter"] is not None:
            model.enter, model.leave = best["enter"], best["leave"]
        meta["enter"], meta["leave"] = model.enter, model.leave
        return model
    finally:
        folds.unpersist()


def threshold_scores(scored: DataFrame, cfg: TrainingConfig) -> DataFrame:
    """Weighted, annualised, cost-aware score of each candidate threshold over ``(p, fwd_return, weight)``."""
    steps = int(math.floor((cfg.enter_hi + 1e-9 - cfg.enter_lo) / cfg.enter_step)) + 1
    grid = F.array(*[F.lit(round(cfg.enter_lo + i * cfg.enter_step, 10)) for i in range(steps)])
    net = F.col("fwd_return") - 2 * cfg.cost_bps / 1e4
    rows = scored.select("p", net.alias("x"), F.col("weight").alias("w")).withColumn("enter", F.explode(grid)).where("p >= enter")
    sums = rows.groupBy("enter").agg(
        F.count("*").alias("n_selected"), F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sq"),
    )
    var = F.greatest(F.lit(0.0), F.col("sq") / F.col("w") - F.col("mean") ** 2)
    score = F.when(var > 1e-18, F.col("mean") * math.sqrt(252 / cfg.horizon) / F.sqrt(var)).otherwise(F.col("mean"))
    return sums.where((F.col("n_selected") >= cfg.min_selected) & (F.col("w") > 0)).select("enter", "n_selected", score.alias("score"))


def select_threshold(scored: DataFrame, cfg: TrainingConfig) -> DataFrame:
    """The threshold with the best score, the lowest on ties; one row, nulls if none selects enough."""
    order = F.struct(F.col("score"), -F.col("enter"))
    return threshold_scores(scored, cfg).agg(
        F.max_by("enter", order).alias("enter"), F.max_by("n_selected", order).alias("n_selected"), F.max("score").alias("score")
    ).withColumn("leave", F.greatest(F.lit(0.0), F.col("enter") - cfg.hysteresis))


def fit_logistic(train: DataFrame, features: list[str] | None = None) -> PipelineModel:
    """A scaled logistic regression on all rows of ``train``."""
    vector = VectorAssembler(inputCols=features or FEATURES, outputCol="_features")
    return Pipeline(stages=[vector, *logistic_stages(TrainingConfig(), train.count())]).fit(train)


def logistic_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows``, which have no null features, with the probability ``p`` of the up class."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def logistic_floor(train: DataFrame, test: DataFrame, features: list[str] | None = None) -> DataFrame:
    return logistic_scores(fit_logistic(train, features), test)


def each_split(splits: list[int], train: Callable[[int], None]) -> list[tuple[int, str]]:
    """Run ``train`` for each split, a few at a time; the splits that can't be trained, and why.

    Every split trains distributed models, so the threads only keep the cluster busy between small jobs.
    """
    def one(split: int) -> tuple[int, str] | None:
        try:
            train(split)
        except TrainingError as e:
            return split, str(e)
        return None

    with ThreadPoolExecutor(PARALLEL_SPLITS) as pool:
        return [x for x in pool.map(inheritable_thread_target(SparkSession.active())(one), splits) if x]


def walk_forward_scores(rows: DataFrame, cfg: TrainingConfig | None = None, features: list[str] | None = None) -> DataFrame:
    """Out-of-sample probabilities ``p`` of a model trained for each split of purged rows (split, role, panel columns).

    Splits that can't be trained have no rows.
    """
    features = features or FEATURES
    spark = rows.sparkSession
    rows = written(learnable(rows, features), "purged", "split")
    folder = shared_folder(spark, "scores")
    splits = sorted(r["split"] for r in rows.select("split").distinct().collect())
    schema = None

    def train(split: int) -> None:
        nonlocal schema
        own = rows.where(F.col("split") == split)
        model = train_model(own.where("role = 'train'"), cfg, features)
        scored = model.score(own.where("role = 'test'"), "p").withColumns({"enter": F.lit(model.enter), "leave": F.lit(model.leave)})
        scored.write.parquet(f"{folder}/part={split}")
        schema = scored.schema

    skipped = each_split(splits, train)
    if schema is None:
        raise TrainingError("no split could be trained: " + "; ".join(why for _, why in skipped))
    return spark.read.schema(schema).parquet(f"{folder}/part=*")


def diagnostics(scored: DataFrame) -> DataFrame:
    return roc_auc_and_brier(scored, ("split",))


def artifact_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the names and digests of a saved model's files, its metadata left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    name = F.regexp_extract("path", f"{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/(.*)$", 1)
    own = files.select(name.alias("name"), F.sha2("content", 256).alias("digest")).where("name not like 'metadata/%' and name not rlike '(^|/)[._]'")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "digest"))), "\n")
    return own.agg(F.sha2(lines, 256).alias("d")).first()["d"]  # a model's files are few


def save_model(model: TrainedModel, folder: str, provenance: dict | None = None) -> str:
    """Write the fitted stages and, last, the metadata: a model without metadata isn't listed.

    The metadata records a digest of what was written and where the model comes from: ``provenance`` holds what the
    caller knows, such as the source of the bars and the run that trained it.
    """
    own = f"{folder}/{model.id}"
    spark = SparkSession.active()
    if isinstance(model.learner, Forest):
        spark.createDataFrame([(model.learner.to_json(),)], "value string").write.mode("overwrite").text(f"{own}/forest")
    else:
        model.learner.write().overwrite().save(f"{own}/pipeline")
    if model.calibration is not None:
        model.calibration.write().overwrite().save(f"{own}/calibration")
    meta = model.metadata | {"artifact_sha256": artifact_digest(spark, own), "provenance": provenance or {}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{own}/metadata")
    return model.id


def load_model(spark: SparkSession, folder: str, model_id: str) -> TrainedModel:
    """A saved model; one whose features are of another version, or whose files have changed, is refused."""
    own = f"{folder}/{model_id}"
    meta = json.loads(spark.read.text(f"{own}/metadata").first()["value"])
    check_version(meta)
    recorded, provenance = meta.pop("artifact_sha256", None), meta.pop("provenance", {})
    if recorded != artifact_digest(spark, own):
        raise IntegrityError(f"the files of model {model_id} aren't those that were saved")
    if name_of(meta) != model_id:
        raise IntegrityError(f"the metadata of model {model_id} isn't what was saved")
    kinds = {"isotonic": IsotonicRegressionModel, "sigmoid": PipelineModel, None: None}
    kind = kinds[meta["calibrated"]]
    calibration = kind.load(f"{own}/calibration") if kind else None
    if meta["config"]["estimator"]:
        learner = PipelineModel.load(f"{own}/pipeline")
    else:
        learner = Forest.from_json(spark.read.text(f"{own}/forest").first()["value"])
    return TrainedModel(learner, calibration, meta["enter"], meta["leave"], meta, provenance)


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """``(model_id, train_end, feature_version, enter, leave, artifact_sha256, provenance)`` of the saved models, newest first."""
    meta = F.from_json(
        "value", "train_end string, feature_version string, enter double, leave double, artifact_sha256 string, provenance map<string,string>"
    ).alias("m")
    path = F.regexp_extract("_metadata.file_path", r"([0-9a-f]{16})/metadata/[^/]*$", 1).alias("model_id")
    found = spark.read.text(f"{folder}/*/metadata").select(path, meta).select("model_id", "m.*")
    return found.orderBy(F.desc("train_end"), F.desc("model_id"))


def component_versions(features: list[str]) -> dict[str, str]:
    """The versions of the feature families that a model uses."""
    news = set(features) & set(NEWS_FEATURES)
    return ({"price": FEATURE_VERSION} if set(features) - news else {}) | ({"news": NEWS_FEATURE_VERSION} if news else {})


def check_version(metadata: dict) -> None:
    """Refuse a model whose features, of any family, aren't those of this code."""
    live = {"price": FEATURE_VERSION, "news": NEWS_FEATURE_VERSION}
    for family, version in (metadata.get("versions") or {"price": metadata.get("feature_version")}).items():
        if live.get(family) != version:
            raise VersionError(f"the model has {family} features {version}, this code {live.get(family)}")


def default_trials(thresholds: int = 11, switches: int = 16, learner_settings: int = 16, horizons: int = 2, dead_bands: int = 3) -> int:
    """How many configurations a search is taken to have tried."""
    return thresholds * switches * learner_settings * horizons * dead_bands
