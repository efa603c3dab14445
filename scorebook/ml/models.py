"""Training, selection, calibration and scoring with Spark ML.

Functions that fit take training and validation rows only; nothing here can be handed a test row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import Business
from scorebook.ml.explain import TERMS, Additive
from scorebook.operators import economics as X
from scorebook.operators import quality as Q
from scorebook.operators.split import stratified_folds
from scorebook.operators.tables import named_rows
from scorebook.operators.validation import ContractError
from scorebook.session import durable

WEIGHT, SCORE, FOLD = "__weight", "score", "fold"


@dataclass(frozen=True)
class Inputs:
    """What a model reads."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    label: str = "churn"
    id: str = "customer_id"
    amount: str = "monthly_charges"

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


# --- candidates -------------------------------------------------------------------------------------


def preprocessor(inputs: Inputs, *, scale: bool) -> list:
    """Median imputation (and scaling) of numbers, one-hot categories with an unknown one all
    zero; every other column stays out of the feature vector."""
    numbers = [f"__n_{c}" for c in inputs.numeric]
    indexes, hot = [f"__i_{c}" for c in inputs.categorical], [f"__h_{c}" for c in inputs.categorical]
    stages: list = []
    vectors: list[str] = []
    if numbers:
        stages.append(
            SQLTransformer(
                statement="SELECT *, "
                + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `__d_{c}`" for c in inputs.numeric)
                + " FROM __THIS__"
            )
        )
        stages.append(
            Imputer(strategy="median", inputCols=[f"__d_{c}" for c in inputs.numeric], outputCols=numbers)
        )
        stages.append(VectorAssembler(inputCols=numbers, outputCol="__numbers"))
        vectors.append("__numbers")
        if scale:
            stages.append(
                StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True)
            )
            vectors = ["__scaled"]
    if indexes:
        stages.append(
            StringIndexer(
                inputCols=list(inputs.categorical), outputCols=indexes, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        # The kept unknown is the last category, and the last one is dropped.
        stages.append(OneHotEncoder(inputCols=indexes, outputCols=hot, dropLast=True))
        vectors += hot
    stages.append(VectorAssembler(inputCols=vectors, outputCol="features"))
    return stages


def classifier(key: str, label: str, seed: int) -> Estimator:
    shared = {"labelCol": label, "featuresCol": "features", "weightCol": WEIGHT}
    if key == "logistic_regression":
        return LogisticRegression(maxIter=100, standardization=False, **shared)
    if key == "random_forest":
        return RandomForestClassifier(numTrees=100, seed=seed, **shared)
    if key == "hist_gradient_boosting":
        return GBTClassifier(maxIter=50, seed=seed, **shared)
    raise KeyError(f"{key!r} names no candidate of {', '.join(fixed.COMPLEXITY_ORDER)}")


def candidate(key: str, inputs: Inputs, *, seed: int = 42) -> Pipeline:
    """An unfitted ``preprocess -> classifier`` pipeline; only the linear one is scaled."""
    model = classifier(key, inputs.label, seed)
    return Pipeline(stages=[*preprocessor(inputs, scale=key == "logistic_regression"), model])


# Settings tried per candidate, by parameter name.
GRIDS: dict[str, dict[str, list]] = {
    "dummy": {},
    "logistic_regression": {"regParam": [0.0, 0.001, 0.01, 0.1]},
    "random_forest": {"maxDepth": [8, 12], "minInstancesPerNode": [1, 5, 20]},
    "hist_gradient_boosting": {"stepSize": [0.05, 0.1], "maxDepth": [3, 5]},
}


class PriorModel:
    """The baseline: the training rate for everyone, as one stage a pipeline can save."""

    @staticmethod
    def fit(train: DataFrame, label: str) -> PipelineModel:
        rate = train.agg(F.avg(label)).first()[0]
        stage = SQLTransformer(statement=f"SELECT *, CAST({rate!r} AS DOUBLE) AS __prior FROM __THIS__")
        return PipelineModel(stages=[stage])


def scored(model: PipelineModel, df: DataFrame, output: str = SCORE) -> DataFrame:
    """``df`` with the positive score only; a model's working columns are dropped."""
    out = model.transform(df)
    if "__prior" in out.columns:
        p = F.col("__prior")
    else:
        p = vector_to_array("probability").getItem(1)
    keep = [c for c in df.columns if c != output]
    return out.select(*keep, p.alias(output))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights, ``n / (2 * n_class)``, as a column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = row["n"], row["p"]
    if p in (0, n):
        raise ValueError("training rows must hold both classes")
    weight = F.when(F.col(label) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    return df.withColumn(WEIGHT, weight)


# --- search ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    key: str
    model: PipelineModel
    settings: dict
    cv_score: float
    cv_std: float
    folds: int

    @property
    def cv_se(self) -> float:
        return self.cv_std / self.folds**0.5


def fold_rows(train: DataFrame, inputs: Inputs, folds: int, seed: int) -> DataFrame:
    """Training rows with weights and folds, written once: every fit reads them."""
    needed = [inputs.id, inputs.label, inputs.amount, *inputs.columns]
    rows = weighted(train.select(*dict.fromkeys(needed)), inputs.label)
    return durable(
        stratified_folds(rows, id=inputs.id, label=inputs.label, folds=folds, seed=seed, output=FOLD)
    )


def tune(
    key: str,
    rows: DataFrame,
    inputs: Inputs,
    *,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
) -> Candidate:
    """Grid search on shared folds; the mean and spread of average precision of the best setting."""
    if key == fixed.BASELINE:
        # A flat score: its average precision in a fold is the fold's positive rate.
        rates = rows.groupBy(FOLD).agg(F.avg(inputs.label).alias("r")).agg(
            F.avg("r").alias("m"), F.stddev_pop("r").alias("s")
        ).first()
        return Candidate(key, PriorModel.fit(rows, inputs.label), {}, rates["m"], rates["s"], folds)
    pipeline = candidate(key, inputs, seed=seed)
    *prepared, last = pipeline.getStages()
    builder = ParamGridBuilder()
    for name, values in (GRIDS[key] if grid is None else grid).items():
        builder = builder.addGrid(getattr(last, name), list(values))
    maps = builder.build()
    scores = fold_scores(Pipeline(stages=prepared), last, maps, rows, inputs, folds, parallelism)
    means = [sum(per) / folds for per in scores]
    best = max(range(len(maps)), key=lambda i: means[i])
    spread = (sum((s - means[best]) ** 2 for s in scores[best]) / folds) ** 0.5
    settings = {p.name: v for p, v in maps[best].items()}
    return Candidate(key, pipeline.fit(rows, maps[best]), settings, means[best], spread, folds)


def fold_scores(
    prepared: Pipeline,
    last: Estimator,
    maps: Sequence[Mapping],
    rows: DataFrame,
    inputs: Inputs,
    folds: int,
    parallelism: int,
) -> list[list[float]]:
    """Average precision of every setting in every fold.

    What comes before the classifier does not depend on its settings: it is fitted once per fold,
    and the settings share its features.  Held-out scores of all folds are ranked together.
    """
    spark = rows.sparkSession
    columns = [inputs.label, WEIGHT, "features"]
    held = None
    with ThreadPool(min(parallelism, len(maps))) as pool:
        for i in range(folds):
            seen = rows.where(F.col(FOLD) != i)
            ready = prepared.fit(seen)
            data = ready.transform(seen).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)

            def fit(setting: Mapping, data: DataFrame = data) -> Model:
                return last.fit(data, setting)

            # Every task has its own copy of the thread's properties: Spark changes them while a
            # command runs, so two threads must not share one.
            tasks = [
                pool.apply_async(inheritable_thread_target(spark)(fit), (setting,)) for setting in maps
            ]
            models = [task.get() for task in tasks]
            data.unpersist()
            out = ready.transform(rows.where(F.col(FOLD) == i)).select(inputs.label, "features")
            for k, model in enumerate(models):
                p = vector_to_array("probability").getItem(1).alias(f"__p{k}")
                out = model.transform(out).select(*out.columns, p)
            each = [F.struct(F.lit(k).alias("setting"), F.col(f"__p{k}").alias("p")) for k in range(len(maps))]
            part = out.select(F.lit(i).alias(FOLD), F.col(inputs.label).alias("y"), F.inline(F.array(*each)))
            held = part if held is None else held.unionByName(part)
    found = {
        (r["setting"], r[FOLD]): r["average_precision"]
        for r in Q.ranking_metrics(held, score="p", label="y", keys=[FOLD, "setting"]).collect()
    }
    return [[float(found[k, i]) for i in range(folds)] for k in range(len(maps))]


# --- selection ----------------------------------------------------------------------------------------


def candidate_rows(spark, results: Sequence[Candidate]) -> DataFrame:
    rows = [
        (r.key, fixed.DISPLAY_NAMES[r.key], fixed.COMPLEXITY_ORDER.index(r.key), float(r.cv_score), float(r.cv_std), r.folds)
        for r in results
    ]
    return named_rows(
        spark, "key string, model string, complexity int, cv_score double, cv_std double, folds int", rows
    )


def one_se_selection(candidates: DataFrame) -> DataFrame:
    """The one-standard-error rule: everything within one standard error of the leader is tied,
    and the simplest of them is selected.  One row per candidate with its part in the rule."""
    se = F.col("cv_std") / F.sqrt(F.col("folds").cast("double"))
    everything = Window.partitionBy()
    # A handful of candidates: one small table.
    based = candidates.withColumn("cv_se", se)
    lead = F.max(
        F.struct("cv_score", (-F.col("complexity")).alias("c"), "cv_se", "key")
    ).over(everything)
    placed = based.withColumn("__lead", lead).withColumn(
        "cutoff", F.col("__lead.cv_score") - F.col("__lead.cv_se")
    )
    placed = placed.withColumns(
        {
            "leader": F.col("key") == F.col("__lead.key"),
            "eligible": F.col("cv_score") >= F.col("cutoff"),
        }
    ).drop("__lead")
    simplest = F.min(F.when(F.col("eligible"), F.col("complexity"))).over(everything)
    return placed.withColumn("selected", F.col("eligible") & (F.col("complexity") == simplest))


class SelectionError(ValueError):
    """No candidate is better than predicting the prior."""


def selected_key(selection: DataFrame) -> str:
    key = selection.where("selected").first()["key"]
    if key == fixed.BASELINE:
        raise SelectionError(f"{fixed.BASELINE} is within a standard error of every candidate")
    return key


def comparison(selection: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Candidates by cross-validated score, with validation figures beside them."""
    table = selection.select(
        "key", "model", F.col("cv_score").alias("cv_pr_auc"), "cv_std", "cv_se",
        F.col("eligible").alias("within_one_se"), "selected",
    )
    if validation is not None:
        table = table.join(validation, "key", "left")
    return table.orderBy(F.col("cv_pr_auc").desc(), "key").drop("key")


# --- calibration ----------------------------------------------------------------------------------------


@dataclass
class Scorer:
    """A servable score: the mean of one or more (model, calibrator) pairs, clamped."""

    parts: list[tuple[PipelineModel, Model | None]]
    method: str | None
    clamp_rows: int

    def raw(self, df: DataFrame, output: str = SCORE) -> DataFrame:
        """The unclamped score, one projection per part."""
        out, names = df, []
        for i, (model, calibrator) in enumerate(self.parts):
            name = f"__part_{i}"
            out = scored(model, out, name)
            if calibrator is not None:
                out = calibrated(calibrator, out, name, self.method)
            names.append(name)
        total = F.lit(0.0)
        for name in names:
            total = total + F.col(name)
        keep = [c for c in df.columns if c != output]
        return out.select(*keep, (total / len(names)).alias(output))

    def score(self, df: DataFrame, output: str = SCORE) -> DataFrame:
        return self.raw(df, output).withColumn(output, E.clamp(output, self.clamp_rows))

    def additive(self, inputs: Inputs) -> Additive | None:
        """The score as one term per input under the logistic curve; None where it is not, as of
        trees, of several parts or of a calibrated one."""
        (model, calibrator), last = self.parts[0], self.parts[0][0].stages[-1]
        if len(self.parts) > 1 or calibrator is not None or not isinstance(last, LogisticRegressionModel):
            return None
        sizes = [1] * len(inputs.numeric)
        for stage in model.stages:
            if isinstance(stage, StringIndexerModel):
                sizes += [len(known) for known in stage.labelsArray]
        weights = [float(w) for w in last.coefficients]
        if len(weights) != sum(sizes) or len(sizes) != len(inputs.columns):
            return None
        before = PipelineModel(stages=model.stages[:-1])

        def terms(df: DataFrame) -> DataFrame:
            out = before.transform(df).withColumn("__v", vector_to_array("features"))
            parts, start = [], 0
            for size in sizes:
                places = range(start, start + size)
                parts.append(sum((F.get("__v", F.lit(j)) * weights[j] for j in places), F.lit(0.0)))
                start += size
            return out.select(*df.columns, F.array(*parts).alias(TERMS))

        low = E.clamp_margin(self.clamp_rows)

        def link(margin: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return np.clip(1.0 / (1.0 + np.exp(-margin)), low, 1.0 - low)

        return Additive(terms, float(last.intercept), link)


def logit(c: str):
    p = F.greatest(F.least(F.col(c), F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.log(p / (1 - p))


def calibrated(calibrator: Model, df: DataFrame, column: str, method: str) -> DataFrame:
    """``column`` replaced by its calibrated value."""
    if method == "isotonic":
        out = calibrator.transform(df.withColumn("__x", F.col(column)))
        return out.withColumn(column, F.col("__iso")).drop("__x", "__iso")
    out = calibrator.transform(df.withColumn("__x", array_to_vector(F.array(logit(column)))))
    return out.withColumn(column, vector_to_array("__cp").getItem(1)).drop("__x", "__cr", "__cp", "__cq")


def fit_calibrator(held: DataFrame, label: str, method: str) -> Model:
    if method == "isotonic":
        # One weighted row per score has the same solution, and a score that many rows share is one.
        tied = held.groupBy(F.col(SCORE).alias("__x")).agg(
            F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("__w")
        )
        return IsotonicRegression(
            featuresCol="__x", labelCol=label, weightCol="__w", predictionCol="__iso"
        ).fit(tied)
    rows = held.select(label, array_to_vector(F.array(logit(SCORE))).alias("__x"))
    return LogisticRegression(
        featuresCol="__x", labelCol=label, rawPredictionCol="__cr", probabilityCol="__cp", predictionCol="__cq",
        standardization=False,
    ).fit(rows)


def calibrate(
    best: Candidate,
    rows: DataFrame,
    inputs: Inputs,
    *,
    clamp_rows: int,
    method: str = "isotonic",
    seed: int = 42,
) -> Scorer:
    """The whole pipeline refitted per fold, each calibrated on the rows it did not see; the
    served score is the mean of the folds.  ``method`` is ``isotonic``, which wants some hundred
    rows per fold, or ``sigmoid``; the caller chooses, never the size of the table."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"{method!r} is no way to calibrate")
    folds = best.folds
    pipeline = candidate(best.key, inputs, seed=seed)
    last = pipeline.getStages()[-1]
    params = {getattr(last, name): value for name, value in best.settings.items()}
    parts = []
    for i in range(folds):
        model = pipeline.fit(rows.where(F.col(FOLD) != i), params)
        held = scored(model, rows.where(F.col(FOLD) == i).drop(SCORE))
        parts.append((model, fit_calibrator(held, inputs.label, method)))
    return Scorer(parts, method, clamp_rows)


# --- the whole job ------------------------------------------------------------------------------------


@dataclass
class Outcome:
    scorer: Scorer
    selection: DataFrame
    candidates: list[Candidate]
    key: str
    uncalibrated_ece: float
    calibrated_ece: float
    calibration_applied: bool
    sweep: DataFrame
    operating_point: dict
    validation: dict = field(default_factory=dict)


def ece_of(rows: DataFrame, label: str) -> float:
    return float(Q.calibration_error(rows, score=SCORE, label=label).first()["ece"])


def train_all(
    train: DataFrame,
    validation: DataFrame,
    inputs: Inputs,
    *,
    keys: Sequence[str] = fixed.COMPLEXITY_ORDER,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    seed: int = 42,
    business: Business = Business(),
    allow_baseline: bool = False,
    calibration: str = "isotonic",
) -> Outcome:
    """Tune, select, calibrate, clamp, and choose the threshold - from training and validation rows.

    ``allow_baseline`` lets a book without any signal go through with its leader.
    """
    rows = fold_rows(train, inputs, folds, seed)
    n = rows.count()
    results = [
        tune(key, rows, inputs, grid=(grids or {}).get(key), folds=folds, seed=seed) for key in keys
    ]
    selection = one_se_selection(candidate_rows(train.sparkSession, results))
    if allow_baseline:
        real = [r for r in results if r.key != fixed.BASELINE]
        key = max(real, key=lambda r: r.cv_score).key
    else:
        key = selected_key(selection)
    best = next(r for r in results if r.key == key)
    held = durable(validation.select(*dict.fromkeys([inputs.id, inputs.label, inputs.amount, *inputs.columns])))
    plain = Scorer([(best.model, None)], None, n)
    before = ece_of(plain.raw(held), inputs.label)
    fitted = calibrate(best, rows, inputs, clamp_rows=n, method=calibration, seed=seed)
    after = ece_of(fitted.raw(held), inputs.label)
    # Kept only if it measurably helps; judged on unclamped scores.
    applied = after < before
    scorer = fitted if applied else plain
    scores = durable(scorer.score(held))
    sweep = X.priced(
        X.sweep_basis(scores, score=SCORE, label=inputs.label, amount=inputs.amount), business
    )
    point = X.recommended(sweep, business).first().asDict()
    figures = Q.evaluate(scores, score=SCORE, label=inputs.label, threshold=0.5).first().asDict()
    return Outcome(scorer, selection, results, key, before, after, applied, sweep, point, figures)


def score_rows(scorer: Scorer, df: DataFrame, threshold: float, bands=fixed.RISK_BANDS) -> DataFrame:
    """Score, band and flag of every row; duplicates stay, nothing is dropped."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [0, 1], got {threshold!r}")
    return scorer.score(df).withColumns(
        {"risk_band": E.score_band(SCORE, bands), "flagged": F.col(SCORE) >= F.lit(float(threshold))}
    )


def feature_ablation(
    rows: DataFrame,
    best: Candidate,
    variants: Mapping[str, Inputs],
    *,
    seed: int = 42,
) -> DataFrame:
    """The selected family re-scored with each feature decision reversed, on the same folds.

    The first variant is the configuration itself; ``change`` is against it.
    """
    out = []
    for i, (name, inputs) in enumerate(variants.items()):
        fixed_grid = {k: [v] for k, v in best.settings.items()}
        r = tune(best.key, rows, inputs, grid=fixed_grid, folds=best.folds, seed=seed)
        out.append((i, name, len(inputs.columns), float(r.cv_score), float(r.cv_std)))
    table = named_rows(rows.sparkSession, "place int, variant string, features int, cv_score double, cv_std double", out)
    base = F.min_by("cv_score", "place").over(Window.partitionBy())
    return table.withColumn("change", F.col("cv_score") - base).drop("place")


# --- save and load ------------------------------------------------------------------------------------

META = "columns array<string>, numeric array<string>, categorical array<string>, method string, clamp_rows bigint, parts int, threshold double, key string, data_fingerprint string, split_fingerprint string"


def save(scorer: Scorer, path: str, inputs: Inputs, *, threshold: float, key: str, data: str, split: str, spark) -> None:
    """The scorer's parts and one row of metadata, under one new folder."""
    for i, (model, calibrator) in enumerate(scorer.parts):
        model.write().save(f"{path}/model-{i}")
        if calibrator is not None:
            calibrator.write().save(f"{path}/calibrator-{i}")
    row = (inputs.columns, list(inputs.numeric), list(inputs.categorical), scorer.method, scorer.clamp_rows, len(scorer.parts), float(threshold), key, data, split)
    named_rows(spark, META, [row]).write.json(f"{path}/meta", ignoreNullFields=False)


def load(spark, path: str, *, data: str | None = None) -> tuple[Scorer, dict]:
    """The saved scorer, refused when its metadata is incomplete, out of range or of other data."""
    row = spark.read.schema(META).option("mode", "FAILFAST").json(f"{path}/meta").first().asDict()
    missing = [k for k, v in row.items() if v is None and k != "method"]
    if missing:
        raise ContractError(f"the model metadata lacks {missing}")
    if not 0.0 <= row["threshold"] <= 1.0:
        raise ContractError("the model's threshold is no probability")
    if row["key"] not in fixed.COMPLEXITY_ORDER:
        raise ContractError(f"unknown model {row['key']!r}")
    if data is not None and row["data_fingerprint"] != data:
        raise ContractError("the model was trained on other data")
    from pyspark.ml.regression import IsotonicRegressionModel

    kind: Callable | None = {
        "isotonic": IsotonicRegressionModel, "sigmoid": LogisticRegressionModel, None: None
    }[row["method"]]
    parts = [
        (PipelineModel.load(f"{path}/model-{i}"), kind.load(f"{path}/calibrator-{i}") if kind else None)
        for i in range(row["parts"])
    ]
    return Scorer(parts, row["method"], row["clamp_rows"]), row
