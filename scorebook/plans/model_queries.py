"""Queries over model jobs and attributions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorebook.functions import fixed
from scorebook.functions.fixed import Business
from scorebook.ml import explain as H
from scorebook.ml import models as M
from scorebook.operators import segments as S
from scorebook.operators.tables import named_rows
from scorebook.plans import books
from scorebook.plans.registry import book, plain, query, rounded, train, validation
from scorebook.session import durable, scratch_path

INPUTS = M.Inputs(
    numeric=("tenure", "orders", "monthly_charges"), categorical=("segment", "region", "in_debit")
)
FOLDS = 5
# The linear candidate is searched in full; a tree setting costs minutes on any table (README), so
# the registered search takes one small setting of each.
GRIDS = {
    "logistic_regression": M.GRIDS["logistic_regression"],
    "random_forest": {"numTrees": [10], "maxDepth": [4]},
    "hist_gradient_boosting": {"maxIter": [5], "maxDepth": [3]},
}


@query(
    "l1_preprocessor",
    """SELECT customer_id, CAST(15 AS INT) AS width, 3.0e0 AS hot FROM book WHERE partition_name = 'validation'""",
    "book",
)
def preprocessor(spark, folder):
    """Width of the feature vector and how many categories are hot, per row."""
    fitted = Pipeline(stages=M.preprocessor(INPUTS, scale=True)).fit(train(spark, folder))
    out = fitted.transform(validation(spark, folder)).withColumn("v", vector_to_array("features"))
    width = len(INPUTS.numeric)
    return out.select(
        "customer_id",
        F.size("v").alias("width"),
        F.aggregate(F.slice("v", width + 1, 100), F.lit(0.0), lambda a, x: a + x).alias("hot"),
    )


@query("l2_l3_candidates_on_shared_folds")
def candidates_on_folds(spark, folder):
    rows = M.fold_rows(train(spark, folder), INPUTS, FOLDS, 42)
    results = [M.tune(k, rows, INPUTS, grid=GRIDS.get(k), folds=FOLDS) for k in fixed.COMPLEXITY_ORDER]
    return M.candidate_rows(spark, results)


REGION_KEYS = dict(zip(("ASIA", "AFRICA", "AMERICA", "EUROPE"), fixed.COMPLEXITY_ORDER, strict=True))


def region_candidates(spark, folder):
    """Four candidates scored by four regions' rates: a table of the right shape off the data."""
    declared = named_rows(
        spark, "region string, key string, model string, complexity int",
        [(r, k, fixed.DISPLAY_NAMES[k], i) for i, (r, k) in enumerate(REGION_KEYS.items())],
    )
    rates = S.rate_by(train(spark, folder), "region", label="churn")
    return rates.join(declared, "region").select(
        "key", "model", "complexity", F.col("churn_rate").alias("cv_score"),
        F.lit(0.05).alias("cv_std"), F.lit(5).alias("folds"),
    )


SELECTION = """d(region, key, model, complexity) AS (VALUES """ + ", ".join(
    f"('{r}', '{k}', '{fixed.DISPLAY_NAMES[k]}', {i})" for i, (r, k) in enumerate(REGION_KEYS.items())
) + """), c AS (SELECT key, model, complexity, CAST(sum(churn) AS DOUBLE) / count(*) AS cv_score, 0.05e0 / sqrt(5.0e0) AS cv_se
  FROM book JOIN d USING (region) WHERE partition_name = 'train' GROUP BY 1, 2, 3),
k AS (SELECT *, (SELECT cv_score - cv_se FROM c ORDER BY cv_score DESC, complexity LIMIT 1) AS cutoff,
  (SELECT key FROM c ORDER BY cv_score DESC, complexity LIMIT 1) AS lead FROM c)"""


@query(
    "l4_one_se_selection",
    f"""WITH {SELECTION} SELECT key, model, complexity, cv_score, 0.05e0 AS cv_std, CAST(5 AS INT) AS folds, round(cv_se, 9) AS cv_se,
  round(cutoff, 9) AS cutoff, key = lead AS leader, cv_score >= cutoff AS eligible,
  cv_score >= cutoff AND complexity = (SELECT min(complexity) FROM k WHERE cv_score >= cutoff) AS selected FROM k""",
    "book",
)
def one_se_selection(spark, folder):
    return rounded(M.one_se_selection(region_candidates(spark, folder)), 9, "cv_se", "cutoff")


@query(
    "l5_comparison_table",
    f"""WITH {SELECTION} SELECT model, cv_score AS cv_pr_auc, 0.05e0 AS cv_std, round(cv_se, 9) AS cv_se, cv_score >= cutoff AS within_one_se,
  cv_score >= cutoff AND complexity = (SELECT min(complexity) FROM k WHERE cv_score >= cutoff) AS selected FROM k""",
    "book",
)
def comparison_table(spark, folder):
    return rounded(M.comparison(M.one_se_selection(region_candidates(spark, folder))), 9, "cv_se")


@query("l6_l7_train_select_calibrate")
def train_select_calibrate(spark, folder):
    """All four candidates on five folds, the one-standard-error rule, calibration and operating
    point; where the baseline is as good as any, a row that says so and nothing else."""
    schema = "key string, calibrated boolean, method string, ece_before double, ece_after double, threshold double, flagged bigint, roc_auc double"
    try:
        out = M.train_all(
            train(spark, folder), validation(spark, folder), INPUTS,
            grids=GRIDS, folds=FOLDS, business=Business(offer_cost=120000.0),
        )
    except M.SelectionError:
        return named_rows(spark, schema, [(fixed.BASELINE, *[None] * 7)])
    row = (
        out.key, out.calibration_applied, out.scorer.method, round(out.uncalibrated_ece, 6),
        round(out.calibrated_ece, 6), round(out.operating_point["threshold"], 2), out.operating_point["flagged"],
        round(out.validation["roc_auc"], 6),
    )
    return named_rows(spark, schema, [row])


SEARCHED: dict[tuple[str, str], tuple] = {}


def simple_scorer(spark, folder):
    """The linear candidate, searched over its whole grid on all folds: once per application and
    folder, as five queries serve the same model."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in SEARCHED:
        rows = M.fold_rows(train(spark, folder), INPUTS, FOLDS, 42)
        SEARCHED[key] = M.tune("logistic_regression", rows, INPUTS, folds=FOLDS), rows
    return SEARCHED[key]


@query("l8_batch_scoring")
def batch_scoring(spark, folder):
    best, rows = simple_scorer(spark, folder)
    scorer = M.Scorer([(best.model, None)], None, rows.count())
    out = M.score_rows(scorer, book(spark, folder).drop("score"), 0.5)
    return out.select("customer_id", "score", "risk_band", "flagged")


@query("l13_feature_ablation")
def feature_ablation(spark, folder):
    best, rows = simple_scorer(spark, folder)
    slim = M.Inputs(numeric=("tenure", "orders"), categorical=("segment", "region"))
    return M.feature_ablation(rows, best, {"as configured": INPUTS, "without amount and debit": slim})


@query("l14_saved_model_scores_alike", "SELECT CAST(0 AS BIGINT) AS differing, 0.36e0 AS threshold FROM region WHERE r_regionkey = 0")
def saved_model(spark, folder):
    best, rows = simple_scorer(spark, folder)
    scorer = M.calibrate(best, rows, INPUTS, clamp_rows=rows.count())
    path = scratch_path(spark, "model")
    M.save(scorer, path, INPUTS, threshold=0.36, key=best.key, data="d", split="s", spark=spark)
    loaded, meta = M.load(spark, path, data="d")
    held = validation(spark, folder).drop("score")
    both = scorer.score(held).select("customer_id", F.col("score").alias("a")).join(
        loaded.score(held).select("customer_id", F.col("score").alias("b")), "customer_id"
    )
    return both.agg(F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("differing")).withColumn(
        "threshold", F.lit(meta["threshold"])
    )


# --- attributions --------------------------------------------------------------------------------------


def explained_table(spark, folder):
    """Attributions of every validation customer at the published setting: 100 training rows, ten
    orderings and their reverses."""
    best, _ = simple_scorer(spark, folder)
    scorer = M.Scorer([(best.model, None)], None, 10**9)
    reference = durable(
        H.background(train(spark, folder).select("customer_id", *INPUTS.columns), id="customer_id", seed=3)
    )
    rows = durable(validation(spark, folder).select("customer_id", *INPUTS.columns))
    return H.attributions(
        rows, reference, scorer.score, INPUTS.columns, id="customer_id", seed=3, additive=scorer.additive(INPUTS)
    )


@query("l9_c18_attributions")
def attributions(spark, folder):
    return explained_table(spark, folder)


@query("l12_attributions_add_up", "SELECT TRUE AS served FROM region WHERE r_regionkey = 0")
def attributions_add_up(spark, folder):
    return H.additivity(explained_table(spark, folder), id="customer_id").select("served")


def stand_in(spark, folder):
    """A long attribution table with known contributions, for what is read off one."""
    rows = plain(spark, folder)
    parts = [
        ("segment", F.col("segment"), F.col("score") - 0.1),
        ("in_debit", F.col("in_debit"), F.when(F.col("in_debit") == "Yes", 0.25).otherwise(-0.125)),
        ("tenure", F.col("tenure").cast("string"), (F.col("tenure") - 50) / 512.0),
    ]
    out = None
    for name, value, contribution in parts:
        part = rows.select("customer_id", F.lit(name).alias("feature"), value.alias("value"), contribution.alias("contribution"))
        out = part if out is None else out.unionByName(part)
    return out


STAND_IN = """a AS (SELECT customer_id, 'segment' AS feature, segment AS value, score - 0.1e0 AS contribution FROM book
UNION ALL SELECT customer_id, 'in_debit', in_debit, CASE WHEN in_debit = 'Yes' THEN 0.25e0 ELSE -0.125e0 END FROM book
UNION ALL SELECT customer_id, 'tenure', CAST(tenure AS VARCHAR), (tenure - 50) / 512.0e0 FROM book)"""


@query(
    "l10_global_importance",
    f"""WITH {STAND_IN}, m AS (SELECT feature, avg(abs(contribution)) AS m FROM a GROUP BY 1)
SELECT feature, CASE feature WHEN 'in_debit' THEN 'In debit' ELSE feature END AS label, round(m, 9) AS mean_abs, round(m / sum(m) OVER (), 9) AS share FROM m""",
    "book",
)
def global_importance(spark, folder):
    table = H.global_importance(stand_in(spark, folder), {"in_debit": "In debit"})
    return rounded(table, 9, "mean_abs", "share")


@query(
    "h8_top_contributions",
    f"""WITH {STAND_IN}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, feature) AS rank FROM a)
SELECT customer_id, feature, value, contribution, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""",
    "book",
)
def top_contributions(spark, folder):
    return H.top_contributions(stand_in(spark, folder), 2, id="customer_id")


@query(
    "l11_dependence_by_category",
    f"""WITH {STAND_IN}, d(feature, category, position) AS (VALUES ('in_debit', 'No', 0), ('in_debit', 'Yes', 1), ('in_debit', 'Unknown', 2)),
m AS (SELECT feature, value AS category, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(avg(contribution), 6) END AS mean FROM a GROUP BY 1, 2)
SELECT feature, category, position, coalesce(n, 0) AS customers, mean FROM d LEFT JOIN m USING (feature, category)""",
    "book",
)
def dependence_by_category(spark, folder):
    return H.categorical_dependence(stand_in(spark, folder), {"in_debit": ("No", "Yes", "Unknown")})


INDEX = " + ".join(f"CAST(x > lo + (hi - lo) / 12 * {i} AS INT)" for i in range(1, 12))


@query(
    "l11_dependence_by_number",
    f"""WITH {STAND_IN}, t AS (SELECT CAST(value AS DOUBLE) AS x, contribution FROM a WHERE feature = 'tenure'),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM t), b AS (SELECT {INDEX} AS bin, lo, hi, x, contribution FROM t, e)
SELECT 'tenure' AS feature, lo + (hi - lo) / 12 * bin AS low, CASE WHEN bin = 11 THEN hi ELSE lo + (hi - lo) / 12 * (bin + 1) END AS high,
  count(*) AS customers, CASE WHEN count(*) >= 5 THEN round(avg(contribution), 6) END AS mean FROM b GROUP BY bin, lo, hi""",
    "book",
)
def dependence_by_number(spark, folder):
    return H.numeric_dependence(stand_in(spark, folder), ["tenure"])


@query(
    "k8_narrated_attributions",
    """SELECT customer_id, 'In debit (' || in_debit || ') ' || CASE WHEN in_debit = 'Yes' THEN 'raises the estimated risk by 25.0'
  ELSE 'lowers the estimated risk by 12.5' END || ' percentage points, relative to an average customer.' AS sentence FROM book""",
    "book",
)
def narrated(spark, folder):
    rows = stand_in(spark, folder).where("feature = 'in_debit'")
    return H.narrated(rows, {"in_debit": "In debit"}).select("customer_id", "sentence")
