"""Model jobs and attributions."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from scorebook.ml import explain as H
from scorebook.ml import models as M
from scorebook.operators.tables import named_rows
from scorebook.operators.validation import ContractError

INPUTS = M.Inputs(numeric=("x",), categorical=("g",), label="y", id="id", amount="m")


@pytest.fixture(scope="module")
def rows(spark):
    import random

    rng = random.Random(2)
    out = []
    for i in range(600):
        g = rng.choice(["a", "b", "c"])
        x = rng.random()
        y = int(rng.random() < 0.1 + 0.5 * x + (0.3 if g == "a" else 0.0))
        out.append((i, x, g, y, 10.0))
    return spark.createDataFrame(out, "id int, x double, g string, y int, m double")


def test_one_standard_error_rule(spark):
    def pick(*scores):
        keys = ("dummy", "logistic_regression", "random_forest")
        table = named_rows(
            spark, "key string, model string, complexity int, cv_score double, cv_std double, folds int",
            [(k, k, i, s, 0.02, 4) for i, (k, s) in enumerate(zip(keys, scores, strict=True))],
        )
        return M.one_se_selection(table)

    tied = {r["key"]: r for r in pick(0.2, 0.665, 0.67).collect()}
    assert tied["random_forest"]["leader"] and tied["logistic_regression"]["selected"]
    assert not tied["dummy"]["eligible"]
    clear = pick(0.2, 0.5, 0.67)
    assert M.selected_key(clear) == "random_forest"
    with pytest.raises(M.SelectionError):
        M.selected_key(pick(0.665, 0.666, 0.67))


def test_training_takes_no_test_rows_and_learns(spark, rows):
    train, held = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    out = M.train_all(
        train, held, INPUTS, keys=("dummy", "logistic_regression"), folds=2,
        grids={"logistic_regression": {"regParam": [0.01]}}, calibration="sigmoid",
    )
    assert out.key == "logistic_regression"
    assert out.validation["roc_auc"] > 0.6
    assert out.calibration_applied == (out.calibrated_ece < out.uncalibrated_ece)
    # Class weights push raw scores up, so a calibration on held-out folds must help here.
    assert out.calibration_applied and out.scorer.method == "sigmoid"
    scored = M.score_rows(out.scorer, held.unionByName(held), 0.5)
    assert scored.count() == 2 * held.count()
    e = 1 / (2 * train.count())
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert e <= low and high <= 1 - e
    with pytest.raises(ValueError):
        M.score_rows(out.scorer, held, float("nan"))


def test_unknown_categories_encode_to_nothing(spark, rows):
    fitted = M.Pipeline(stages=M.preprocessor(INPUTS, scale=False)).fit(rows)
    odd = rows.limit(1).withColumn("g", F.lit("unseen"))
    vector = fitted.transform(odd).first()["features"].toArray()
    assert len(vector) == 4 and list(vector[1:]) == [0.0, 0.0, 0.0]


def test_one_score_shared_by_a_third_of_the_rows_is_one_step(spark):
    rows = [(i % 2, 0.5) for i in range(300)] + [(int(i % 10 < i // 60), i / 600) for i in range(600)]
    df = spark.createDataFrame(rows, f"y int, {M.SCORE} double").repartition(6)
    fitted = M.fit_calibrator(df, "y", "isotonic")
    got = {r[0]: r[1] for r in M.calibrated(fitted, df.select(F.col(M.SCORE).alias("x"), M.SCORE), M.SCORE, "isotonic").distinct().collect()}
    order = sorted(got)
    assert all(got[a] <= got[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))
    mean = sum(y for y, _ in rows) / len(rows)
    assert abs(sum(got[p] for _, p in rows) / len(rows) - mean) < 1e-9


def test_saved_metadata_is_checked(spark, rows, tmp_path):
    prior = M.PriorModel.fit(rows, "y")
    scorer = M.Scorer([(prior, None)], None, 600)
    path = str(tmp_path / "model")
    M.save(scorer, path, INPUTS, threshold=0.3, key="dummy", data="d1", split="s", spark=spark)
    loaded, meta = M.load(spark, path, data="d1")
    assert meta["threshold"] == 0.3 and loaded.score(rows.limit(1)).first()["score"] == pytest.approx(
        rows.agg(F.avg("y")).first()[0]
    )
    with pytest.raises(ContractError):
        M.load(spark, path, data="other")
    bad = str(tmp_path / "bad")
    M.save(scorer, bad, INPUTS, threshold=1.3, key="dummy", data="d1", split="s", spark=spark)
    with pytest.raises(ContractError):
        M.load(spark, bad)


def test_settings_fitted_at_once_share_no_thread_properties(spark, rows, monkeypatch):
    """A command takes its execution out of the properties when it ends; a thread that shares them
    fails on what is missing ("Cannot parse null string")."""
    system, context, seen = spark.sparkContext._jvm.java.lang.System, spark.sparkContext._jsc.sc(), []
    fit = M.LogisticRegression._fit

    def watched(self, dataset):
        seen.append(system.identityHashCode(context.getLocalProperties()))
        return fit(self, dataset)

    monkeypatch.setattr(M.LogisticRegression, "_fit", watched)
    folded = M.fold_rows(rows, INPUTS, 2, 1)
    grid = {"regParam": [0.0, 0.001, 0.01, 0.1]}
    got = M.tune("logistic_regression", folded, INPUTS, grid=grid, folds=2, parallelism=4)
    assert len(seen) == 9 and len(set(seen)) == 9
    # The chosen setting's figures are those of fits of the whole pipeline, fold by fold.
    parts = []
    for i in range(2):
        chosen = M.candidate("logistic_regression", INPUTS)
        chosen.getStages()[-1].setParams(**got.settings)
        held = M.scored(chosen.fit(folded.where(F.col(M.FOLD) != i)), folded.where(F.col(M.FOLD) == i))
        parts.append(M.Q.ranking_metrics(held, score=M.SCORE, label="y").first()["average_precision"])
    assert got.cv_score == pytest.approx(sum(parts) / 2, abs=1e-9)
    assert got.cv_std == pytest.approx(abs(parts[0] - parts[1]) / 2, abs=1e-9)


# --- attributions ----------------------------------------------------------------------------------------


def additive(df):
    """A model whose Shapley values are known: weights times distance from the background mean."""
    bonus = F.when(F.col("g") == "a", 0.25).otherwise(0.0)
    return df.withColumn("score", 0.5 * F.col("x") + bonus)


def test_attributions_of_an_additive_model_are_exact(spark, rows):
    reference = H.background(rows.where("id >= 100"), 50, id="id", seed=1)
    explained = rows.where("id < 20")
    mean_x, share_a = reference.agg(F.avg("x"), F.avg((F.col("g") == "a").cast("double"))).first()
    got = H.attributions(explained, reference, additive, ["x", "g"], id="id", n_orderings=2)
    truth = {(r["id"], "x"): 0.5 * (r["x"] - mean_x) for r in explained.collect()}
    truth |= {(r["id"], "g"): 0.25 * ((r["g"] == "a") - share_a) for r in explained.collect()}
    back = {(r["id"], r["feature"]): r["contribution"] for r in got.collect()}
    assert set(back) == set(truth)
    assert all(back[k] == pytest.approx(truth[k], abs=1e-12) for k in truth)
    check = H.additivity(got, id="id").first()
    assert check["served"] and check["max_gap"] <= 1e-9


def test_attributions_of_an_interaction_are_shared(spark):
    """x AND z against a background of zeros: by symmetry half each, whatever the ordering."""
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id int, x double, z double")
    zero = spark.createDataFrame([(2, 0.0, 0.0)], "id int, x double, z double")
    got = H.attributions(df, zero, lambda d: d.withColumn("score", F.col("x") * F.col("z")), ["x", "z"], id="id", n_orderings=1)
    assert {r["feature"]: r["contribution"] for r in got.collect()} == {"x": 0.5, "z": 0.5}


def test_attributions_by_terms_are_those_of_mixed_rows(spark, rows, monkeypatch):
    folded = M.fold_rows(rows, INPUTS, 2, 1)
    grid = {"regParam": [0.01]}
    best = M.tune("logistic_regression", folded, INPUTS, grid=grid, folds=2)
    scorer = M.Scorer([(best.model, None)], None, 20)
    reference = H.background(rows.where("id >= 100"), 30, id="id", seed=1)
    odd = spark.createDataFrame(
        [(1, None, "a"), (1, 0.5, "b"), (2, 0.9, None), (3, 0.1, "unseen"), (None, 0.2, "c")], "id int, x double, g string"
    )
    explained = rows.where("id >= 10 AND id < 30").select("id", "x", "g").unionByName(odd)
    plain = H.attributions(explained, reference, scorer.score, ["x", "g"], id="id", n_orderings=2)
    want = sorted((r.asDict() for r in plain.collect()), key=lambda r: (r["id"], r["feature"], r["value"] or ""))
    monkeypatch.setattr(H, "hybrid_rows", None)
    fast = H.attributions(
        explained, reference, scorer.score, ["x", "g"], id="id", n_orderings=2, additive=scorer.additive(INPUTS)
    )
    assert fast.columns == plain.columns
    got = sorted((r.asDict() for r in fast.collect()), key=lambda r: (r["id"], r["feature"], r["value"] or ""))
    assert len(got) == len(want) == 48
    for a, b in zip(got, want, strict=True):
        assert (a["id"], a["feature"], a["value"]) == (b["id"], b["feature"], b["value"])
        assert all(a[c] == pytest.approx(b[c], abs=1e-12) for c in ("contribution", "base_value", "score"))


def test_only_a_single_uncalibrated_logistic_score_is_made_of_terms(spark, rows):
    folded = M.fold_rows(rows, INPUTS, 2, 1)
    tree = M.tune("random_forest", folded, INPUTS, grid={"numTrees": [2], "maxDepth": [2]}, folds=2)
    line = M.tune("logistic_regression", folded, INPUTS, grid={"regParam": [0.1]}, folds=2)
    prior = M.tune("dummy", folded, INPUTS, folds=2)
    for parts in ([(tree.model, None)], [(prior.model, None)], [(line.model, None)] * 2, [(line.model, line.model)]):
        assert M.Scorer(parts, None, 20).additive(INPUTS) is None
    assert M.Scorer([(line.model, None)], None, 20).additive(INPUTS) is not None


def test_orderings_are_antithetic_and_seeded():
    walks = H.orderings(["a", "b", "c"], 3, 7)
    assert walks == H.orderings(["a", "b", "c"], 3, 7) and len(walks) == 6
    assert all(walks[i + 1] == walks[i][::-1] for i in range(0, 6, 2))


def test_weights_cancel_inside_and_leave_the_ends():
    weights = H.set_weights(["a", "b", "c"], 2, 0)
    for mask, per in weights.items():
        total = sum(per.values())
        want = -1.0 if mask == 0 else 1.0 if mask == 7 else 0.0
        assert total == pytest.approx(want)


def test_dependence_groups(spark):
    rows = [(i, "x", str(float(i)), 0.1 * i) for i in range(13)]
    table = spark.createDataFrame(rows, "id int, feature string, value string, contribution double")
    got = H.numeric_dependence(table, ["x"]).orderBy("low").collect()
    assert sum(r["customers"] for r in got) == 13
    assert (got[0]["low"], got[0]["customers"]) == (0.0, 2) and got[-1]["high"] == 12.0
    assert all(r["mean"] is None for r in got)
    constant = table.withColumn("value", F.lit("3.0"))
    one = H.numeric_dependence(constant, ["x"]).collect()
    assert len(one) == 1 and one[0]["customers"] == 13 and one[0]["mean"] == pytest.approx(0.6)


def test_a_prior_pipeline_is_savable(spark, rows):
    assert isinstance(M.PriorModel.fit(rows, "y"), PipelineModel)
    assert isinstance(M.PriorModel.fit(rows, "y").stages[0], SQLTransformer)
