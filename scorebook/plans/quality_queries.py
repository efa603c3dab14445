"""Queries over score quality and threshold economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import Business
from scorebook.operators import economics as X
from scorebook.operators import quality as Q
from scorebook.operators import segments as S
from scorebook.operators.tables import named_rows
from scorebook.plans.registry import (
    book, plain, docs, keeps_sql, lines, query, ratio_sql, rounded, train, validation, wilson_sql,
)

# --- association ----------------------------------------------------------------------------------


def v_sql(x: str, y: str, source: str) -> str:
    """One number: the corrected V of two columns."""
    return f"""(WITH t AS (SELECT {x} AS x, {y} AS y, count(*) AS o FROM {source} GROUP BY 1, 2),
  m AS (SELECT x, sum(o) AS r FROM t GROUP BY x), k AS (SELECT y, sum(o) AS c FROM t GROUP BY y),
  e AS (SELECT m.x, k.y, CAST(r AS DOUBLE) * c / (SELECT sum(o) FROM t) AS e FROM m CROSS JOIN k),
  s AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi,
    CAST((SELECT sum(o) FROM t) AS DOUBLE) AS n, CAST(count(DISTINCT e.x) AS DOUBLE) AS r,
    CAST(count(DISTINCT e.y) AS DOUBLE) AS k FROM e LEFT JOIN t ON t.x = e.x AND t.y = e.y)
  SELECT CASE WHEN least(r, k) < 2 OR least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) <= 1 THEN 0.0e0
    ELSE sqrt(greatest(0.0e0, chi / n - (r-1)*(k-1)/(n-1)) /
      (least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) - 1)) END FROM s)"""


@query("e1_cramers_v", f"SELECT round({v_sql('source', 'lang', 'docs')}, 9) AS cramers_v", "docs")
def cramers_v(spark, folder):
    return rounded(Q.cramers_v(docs(spark, folder), "source", "lang"), 9, "cramers_v")


@query("e1_cramers_v_of_a_near_copy", f"SELECT round({v_sql('l_linestatus', 'ship_year', 'lines')}, 9) AS cramers_v", "lines")
def cramers_v_lines(spark, folder):
    return rounded(Q.cramers_v(lines(spark, folder), "l_linestatus", "ship_year"), 9, "cramers_v")


@query("e2_point_biserial", "SELECT round(corr(tenure, churn), 9) AS point_biserial FROM book", "book")
def point_biserial(spark, folder):
    return rounded(Q.point_biserial(plain(spark, folder), "tenure", "churn"), 9, "point_biserial")


RANKED_TEXT, RANKED_NUMBERS = ("segment", "region", "nation", "in_debit"), ("tenure", "orders")


def ranking_sql() -> str:
    arms = [
        f"SELECT '{c}' AS feature, 'Cramer''s V' AS measure, round({v_sql(c, 'churn', 'book')}, 9) AS strength, "
        "'n/a (categorical)' AS direction"
        for c in RANKED_TEXT
    ]
    arms += [
        f"SELECT '{c}', 'point-biserial |r|', round(abs(corr({c}, churn)), 9), "
        f"CASE WHEN corr({c}, churn) > 0 THEN 'higher -> more churn' ELSE 'higher -> less churn' END FROM book"
        for c in RANKED_NUMBERS
    ]
    return " UNION ALL ".join(arms)


def ranking(spark, folder):
    return Q.association_ranking(
        plain(spark, folder), categories=RANKED_TEXT, numbers=RANKED_NUMBERS, label="churn"
    )


@query("e3_association_ranking", ranking_sql(), "book")
def association_ranking(spark, folder):
    return rounded(ranking(spark, folder), 9, "strength")


@query(
    "e4_collinearity",
    "SELECT round(corr(total_charges, CAST(tenure AS DOUBLE) * monthly_charges), 9) AS r FROM book",
    "book",
)
def collinearity(spark, folder):
    table = Q.collinearity(
        plain(spark, folder), total="total_charges", tenure="tenure", amount="monthly_charges"
    )
    return rounded(table, 9, "r")


@query(
    "e5_wilson_intervals",
    f"""WITH t AS (SELECT nation, count(*) AS n, CAST(sum(churn) AS BIGINT) AS k FROM book GROUP BY nation)
SELECT nation, n, k, {wilson_sql('k', 'n', 'low')} AS low, {wilson_sql('k', 'n', 'high')} AS high FROM t""",
    "book",
)
def wilson_intervals(spark, folder):
    low, high = E.wilson("k", "n")
    table = (
        plain(spark, folder)
        .groupBy("nation")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("churn").alias("k"))
        .select("nation", "n", "k", low.alias("low"), high.alias("high"))
    )
    return rounded(table, 9, "low", "high")


# --- score against outcome --------------------------------------------------------------------------

CELLS = """count(*) FILTER (NOT hit AND y = 0) AS tn, count(*) FILTER (hit AND y = 0) AS fp,
  count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (hit AND y = 1) AS tp"""

RATES = """CAST(tp + tn AS DOUBLE) / n AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0e0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0e0 END AS recall"""

F1 = "CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 9) ELSE 0.0e0 END AS f1"


def ranking_metrics_sql(source: str, score: str, label: str) -> str:
    """Pairs counted over distinct scores, steps taken from the top."""
    return f"""g AS (SELECT {score} AS p, CAST(sum({label}) AS DOUBLE) AS pos, count(*) - sum({label}) AS neg
    FROM {source} GROUP BY 1),
  a AS (SELECT *, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g),
  auc AS (SELECT round(sum(neg * (tp - 0.5 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc,
    round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision FROM a)"""


def evaluate_sql(source: str, score: str, label: str, threshold: float) -> str:
    return f"""WITH {ranking_metrics_sql(source, score, label)},
t AS (SELECT {score} >= {threshold!r}e0 AS hit, {label} AS y, ({score} - {label}) * ({score} - {label}) AS e FROM {source}),
c AS (SELECT {CELLS}, count(*) AS n, round(avg(e), 9) AS brier FROM t),
r AS (SELECT *, tp + fn AS positives, {RATES} FROM c)
SELECT {threshold!r}e0 AS threshold, n, positives, tn, fp, fn, tp, accuracy, precision, recall, {F1}, brier,
  roc_auc, average_precision FROM r, auc"""


FIGURES = ("f1", "brier", "roc_auc", "average_precision")


@query("e6_confusion_and_rates", evaluate_sql("lines", "score", "returned", 0.4), "lines")
def confusion_and_rates(spark, folder):
    table = Q.evaluate(lines(spark, folder), score="score", label="returned", threshold=0.4)
    return rounded(table, 9, *FIGURES)


@query(
    "e7_e8_ranking_metrics",
    f"""WITH {ranking_metrics_sql('docs', 'score', 'toxic')}
SELECT CAST((SELECT sum(toxic) FROM docs) AS BIGINT) AS positives,
  (SELECT count(*) FROM docs WHERE toxic = 0) AS negatives, roc_auc, average_precision FROM auc""",
    "docs",
)
def ranking_metrics(spark, folder):
    table = Q.ranking_metrics(docs(spark, folder), score="score", label="toxic")
    return rounded(table, 9, "roc_auc", "average_precision")


EDGES = E.reliability_edges()
BIN = " + ".join(f"CAST(score > {e!r}e0 AS INT)" for e in EDGES[1:-1])
LOW = "CASE bin " + " ".join(f"WHEN {i} THEN {e!r}e0" for i, e in enumerate(EDGES[:-1])) + " END"
HIGH = "CASE bin " + " ".join(f"WHEN {i} THEN {e!r}e0" for i, e in enumerate(EDGES[1:])) + " END"


def reliability_sql(source: str, label: str) -> str:
    return f"""b AS (SELECT {BIN} AS bin, count(*) AS "count", avg(score) AS mean_predicted,
    CAST(sum({label}) AS BIGINT) AS churned FROM {source} GROUP BY 1)"""


@query(
    "e9_reliability_table",
    f"""WITH {reliability_sql('lines', 'returned')} SELECT bin, {LOW} AS low, {HIGH} AS high, "count",
  round(mean_predicted, 9) AS mean_predicted, churned, CAST(churned AS DOUBLE) / "count" AS observed_rate,
  round(CAST(churned AS DOUBLE) / "count" - mean_predicted, 9) AS gap FROM b""",
    "lines",
)
def reliability_table(spark, folder):
    table = Q.reliability(lines(spark, folder), score="score", label="returned")
    return rounded(table, 9, "mean_predicted", "gap")


VALID = "valid AS (SELECT * FROM book WHERE partition_name = 'validation')"


@query(
    "e9_reliability_as_published",
    f"""WITH {VALID}, {reliability_sql('valid', 'churn')} SELECT {LOW} AS low, {HIGH} AS high, "count" AS customers,
  round(mean_predicted, 9) AS mean_predicted, CASE WHEN "count" >= 20 THEN churned END AS churned,
  CASE WHEN "count" >= 20 THEN CAST(churned AS DOUBLE) / "count" END AS rate FROM b""",
    "book",
)
def reliability_published(spark, folder):
    table = Q.reliability(validation(spark, folder), score="score", label="churn")
    return rounded(Q.reliability_shown(table), 9, "mean_predicted")


@query(
    "e10_calibration_error",
    f"""WITH {reliability_sql('lines', 'returned')} SELECT
  round(sum("count" * abs(CAST(churned AS DOUBLE) / "count" - mean_predicted)) / sum("count"), 9) AS ece FROM b""",
    "lines",
)
def calibration_error(spark, folder):
    return rounded(Q.calibration_error(lines(spark, folder), score="score", label="returned"), 9, "ece")


def segment_sql(source: str, dims: tuple[str, ...], label: str, threshold: float, minimum: int | None) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, score AS p, {label} AS y, score >= {threshold!r}e0 AS hit FROM {source}"
        for d in dims
    )
    shown = "TRUE" if minimum is None else f"customers >= {minimum}"

    def when(value: str) -> str:
        return f"CASE WHEN {shown} THEN {value} END"

    return f"""l AS ({union}),
c AS (SELECT dimension, segment, {CELLS} FROM l GROUP BY 1, 2),
s AS (SELECT *, tn + fp + fn + tp AS customers, tp + fn AS churners, tp + fp AS flagged FROM c),
g AS (SELECT dimension, segment, p, CAST(sum(y) AS DOUBLE) AS pos, count(*) - sum(y) AS neg FROM l GROUP BY 1, 2, 3),
a AS (SELECT *, sum(pos) OVER (PARTITION BY dimension, segment ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS up FROM g),
u AS (SELECT dimension, segment, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
  THEN round(sum(neg * (up - 0.5 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) END AS roc_auc FROM a GROUP BY 1, 2)
SELECT dimension, segment, customers, flagged, {when('churners')} AS churners,
  {when(ratio_sql('churners', 'customers'))} AS churn_rate, {when(ratio_sql('flagged', 'customers'))} AS flagged_rate,
  {when(ratio_sql('tp', 'flagged'))} AS precision, {when(wilson_sql('tp', 'flagged', 'low'))} AS precision_low,
  {when(wilson_sql('tp', 'flagged', 'high'))} AS precision_high, {when(ratio_sql('tp', 'churners'))} AS recall,
  {when(wilson_sql('tp', 'churners', 'low'))} AS recall_low, {when(wilson_sql('tp', 'churners', 'high'))} AS recall_high,
  {when('roc_auc')} AS roc_auc, {when('flagged = 0 AND churners > 0')} AS unscanned
FROM s JOIN u USING (dimension, segment)"""


SEGMENT_FIGURES = ("precision_low", "precision_high", "recall_low", "recall_high", "roc_auc")


@query(
    "e11_segment_performance",
    "WITH " + segment_sql("docs", ("lang", "source", "size_band"), "toxic", 0.25, None),
    "docs",
)
def segment_performance(spark, folder):
    table = Q.segment_performance(
        docs(spark, folder), ["lang", "source", "size_band"], score="score", label="toxic", threshold=0.25
    )
    return rounded(table, 9, *SEGMENT_FIGURES)


@query(
    "e12_validation_segments",
    f"WITH {VALID}, " + segment_sql("valid", ("segment", "nation", "in_debit"), "churn", 0.2, 20),
    "book",
)
def validation_segments(spark, folder):
    table = Q.segment_performance(
        validation(spark, folder), ["segment", "nation", "in_debit"], score="score", label="churn", threshold=0.2
    )
    return rounded(Q.small_segments_hidden(table), 9, *SEGMENT_FIGURES)


@query(
    "e12_validation_summary",
    f"""WITH {VALID}, {evaluate_sql('valid', 'score', 'churn', 0.2)[5:].replace("SELECT 0.2e0 AS threshold", f", {reliability_sql('valid', 'churn')}, ece AS (SELECT round(sum(CAST(b.count AS DOUBLE) * abs(CAST(churned AS DOUBLE) / b.count - mean_predicted)) / sum(b.count), 9) AS ece FROM b) SELECT 0.2e0 AS threshold")}, ece""".replace(
        "roc_auc, average_precision FROM r, auc",
        "roc_auc, average_precision, ece, CAST(positives AS DOUBLE) / n AS churn_rate, "
        "1 - CAST(positives AS DOUBLE) / n AS no_skill_accuracy FROM r, auc",
    ),
    "book",
)
def validation_summary(spark, folder):
    table = Q.validation_summary(validation(spark, folder), score="score", label="churn", threshold=0.2)
    return rounded(table, 9, *FIGURES, "ece")


CUTS = (0.0, 0.1, 0.15, 0.29, 0.41, 0.57)
INTERVAL = " + ".join(f"CAST(score >= {c!r}e0 AS INT)" for c in CUTS)
CUTS_VALUES = ", ".join(
    f"({i}, {c!r}e0, {(CUTS + (1.0,))[i + 1]!r}e0)" for i, c in enumerate(CUTS)
)


@query(
    "e13_reliability_on_cuts",
    f"""WITH cuts(i, low, high) AS (VALUES {CUTS_VALUES}), t AS (SELECT {INTERVAL} - 1 AS i, count(*) AS customers,
  avg(score) AS m, CAST(sum(returned) AS BIGINT) AS churned FROM lines GROUP BY 1)
SELECT low, high, coalesce(customers, 0) AS customers, round(coalesce(m, low), 9) AS mean_predicted,
  coalesce(churned, 0) AS churned, CASE WHEN customers > 0 THEN CAST(churned AS DOUBLE) / customers END AS rate
FROM cuts LEFT JOIN t USING (i)""",
    "lines",
)
def reliability_on_cuts(spark, folder):
    table = Q.reliability_on(lines(spark, folder), score="score", label="returned", cuts=CUTS)
    return rounded(table, 9, "mean_predicted")


@query(
    "b18_unscanned_segments",
    """WITH l AS (SELECT nation, count(*) FILTER (score >= 0.6) AS flagged, sum(churn) AS churners FROM book GROUP BY nation)
SELECT count(*) AS segments, CAST(coalesce(sum(churners), 0) AS BIGINT) AS churners FROM l
WHERE flagged = 0 AND churners > 0""",
    "book",
)
def unscanned(spark, folder):
    table = Q.segment_performance(
        plain(spark, folder), ["nation"], score="score", label="churn", threshold=0.6
    )
    return Q.unscanned_note(table)


@query(
    "d20_segment_four_cells",
    "WITH l AS ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, returned AS y, score >= 0.4e0 AS hit FROM lines"
        for d in ("l_linestatus", "ship_year", "quantity_band")
    )
    + f") SELECT dimension, segment, {CELLS} FROM l GROUP BY 1, 2",
    "lines",
)
def segment_four_cells(spark, folder):
    return Q.segment_cells(
        lines(spark, folder), ["l_linestatus", "ship_year", "quantity_band"],
        score="score", label="returned", threshold=0.4,
    )


@query(
    "h7_feature_ranks",
    f"""WITH r AS ({ranking_sql()}) SELECT feature,
  CAST(row_number() OVER (ORDER BY strength DESC, feature) AS INT) AS rank FROM r
WHERE feature IN ('segment', 'tenure', 'orders')""",
    "book",
)
def feature_ranks(spark, folder):
    return Q.feature_ranks(rounded(ranking(spark, folder), 9, "strength"), ["segment", "tenure", "orders"])


@query(
    "c12_rank_join",
    f"""WITH r AS ({ranking_sql()}), k AS (SELECT * FROM r WHERE feature IN ('tenure', 'orders', 'region'))
SELECT feature, CAST(row_number() OVER (ORDER BY strength DESC, feature) AS INT) AS association_rank,
  CAST(row_number() OVER (ORDER BY length(feature) DESC, feature) AS INT) AS importance_rank FROM k""",
    "book",
)
def rank_join(spark, folder):
    table = rounded(ranking(spark, folder), 9, "strength")
    importance = table.select("feature", F.length("feature").cast("double").alias("mean_abs"))
    return Q.rank_join(table, importance, ["tenure", "orders", "region"])


@query(
    "j5_requested_columns_that_exist",
    f"""WITH r AS ({ranking_sql()}) SELECT feature FROM r WHERE feature IN ('tenure', 'region')""",
    "book",
)
def requested_columns(spark, folder):
    wanted = named_rows(spark, "feature string", [("tenure",), ("region",), ("absent",)])
    return ranking(spark, folder).select("feature").join(wanted, "feature", "left_semi")


# --- economics -----------------------------------------------------------------------------------------

OFFER = Business(offer_cost=120000.0)


def basis_sql(source: str, label: str, amount: str) -> str:
    """The definition itself: every row against every cut."""
    return f"""grid AS (SELECT CAST(range AS INT) AS cut, range * 0.01e0 AS threshold FROM range(101)),
basis AS (SELECT cut, threshold, count(*) FILTER (score >= threshold AND {label} = 1) AS true_positives,
  count(*) FILTER (score >= threshold AND {label} = 0) AS false_positives,
  count(*) FILTER (score < threshold AND {label} = 1) AS false_negatives,
  coalesce(CAST(sum(CAST({amount} AS DECIMAL(20,4))) FILTER (score >= threshold AND {label} = 1) AS DOUBLE), 0.0e0)
    AS flagged_churner_charges FROM {source}, grid GROUP BY cut, threshold)"""


def priced_sql(offer: Business = OFFER, rate: str | None = None) -> str:
    rate = rate or f"{offer.success_rate!r}e0"
    return f"""priced0 AS (SELECT *, true_positives + false_positives AS flagged,
    max(true_positives + false_positives) OVER () AS n FROM basis),
priced1 AS (SELECT threshold, flagged, flagged / CAST(n AS DOUBLE) AS flagged_share, true_positives, false_positives, false_negatives,
  CASE WHEN flagged > 0 THEN CAST(true_positives AS DOUBLE) / flagged ELSE 0.0e0 END AS precision,
  CASE WHEN true_positives + false_negatives > 0 THEN CAST(true_positives AS DOUBLE) / (true_positives + false_negatives) ELSE 0.0e0 END AS recall,
  flagged * {offer.offer_cost!r}e0 AS intervention_cost,
  flagged_churner_charges * {offer.horizon_months} * {offer.margin!r}e0 * {rate} AS retained_value FROM priced0),
priced AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1,
  retained_value - intervention_cost AS net_benefit FROM priced1)"""


MONEY = ("f1", "intervention_cost", "retained_value", "net_benefit")


def sweep_columns(alias: str = "") -> str:
    return (
        "threshold, flagged, flagged_share, true_positives, false_positives, false_negatives, precision, recall, "
        "round(f1, 4) AS f1, round(intervention_cost, 4) AS intervention_cost, "
        "round(retained_value, 4) AS retained_value, round(net_benefit, 4) AS net_benefit"
    )


BASIS = f"{VALID}, {basis_sql('valid', 'churn', 'monthly_charges')}"


def validation_basis(spark, folder):
    return X.sweep_basis(
        validation(spark, folder), score="score", label="churn", amount="monthly_charges"
    )


@query(
    "f1_customer_value",
    "SELECT customer_id, round(monthly_charges * 12 * 0.65e0, 4) AS value FROM book",
    "book",
)
def customer_value(spark, folder):
    return plain(spark, folder).select(
        "customer_id", F.round(E.customer_value("monthly_charges"), 4).alias("value")
    )


LINE_OFFER = Business(offer_cost=90000.0)


@query(
    "f2_threshold_sweep",
    f"WITH {basis_sql('lines', 'returned', 'amount')}, {priced_sql(LINE_OFFER)} SELECT {sweep_columns()} FROM priced",
    "lines",
)
def threshold_sweep(spark, folder):
    table = X.sweep(lines(spark, folder), LINE_OFFER, score="score", label="returned", amount="amount")
    return rounded(table, 4, *MONEY)


@query(
    "f3_h1_sweep_basis",
    f"WITH {basis_sql('lines', 'returned', 'amount')} SELECT * FROM basis",
    "lines",
)
def sweep_basis(spark, folder):
    return X.sweep_basis(lines(spark, folder), score="score", label="returned", amount="amount")


@query(
    "f3_sweep_basis_per_segment",
    f"""WITH grid AS (SELECT CAST(range AS INT) AS cut, range * 0.01e0 AS threshold FROM range(101))
SELECT quantity_band, cut, threshold, count(*) FILTER (score >= threshold AND returned = 1) AS true_positives,
  count(*) FILTER (score >= threshold AND returned = 0) AS false_positives,
  count(*) FILTER (score < threshold AND returned = 1) AS false_negatives,
  coalesce(CAST(sum(CAST(amount AS DECIMAL(20,4))) FILTER (score >= threshold AND returned = 1) AS DOUBLE), 0.0e0)
    AS flagged_churner_charges FROM lines, grid GROUP BY ALL""",
    "lines",
)
def sweep_basis_per_segment(spark, folder):
    return X.sweep_basis(
        lines(spark, folder), score="score", label="returned", amount="amount", keys=["quantity_band"]
    )


@query("f4_reprice_from_basis", f"WITH {BASIS}, {priced_sql()} SELECT {sweep_columns()} FROM priced", "book")
def reprice(spark, folder):
    return rounded(X.priced(validation_basis(spark, folder), OFFER), 4, *MONEY)


BAND = f"band AS (SELECT * FROM priced WHERE net_benefit >= (SELECT max(net_benefit) FROM priced) - {OFFER.offer_cost!r}e0)"


@query(
    "f5_indifference_band",
    f"WITH {BASIS}, {priced_sql()}, {BAND} SELECT {sweep_columns()} FROM band",
    "book",
)
def indifference_band(spark, folder):
    return rounded(X.indifference_band(X.priced(validation_basis(spark, folder), OFFER), OFFER), 4, *MONEY)


@query(
    "f6_recommendation",
    f"WITH {BASIS}, {priced_sql()}, {BAND} SELECT {sweep_columns()} FROM band ORDER BY threshold DESC LIMIT 1",
    "book",
)
def recommendation(spark, folder):
    return rounded(X.recommended(X.priced(validation_basis(spark, folder), OFFER), OFFER), 4, *MONEY)


@query(
    "f6_peak",
    f"WITH {BASIS}, {priced_sql()} SELECT {sweep_columns()} FROM priced ORDER BY net_benefit DESC, threshold LIMIT 1",
    "book",
)
def peak(spark, folder):
    return rounded(X.peak(X.priced(validation_basis(spark, folder), OFFER)), 4, *MONEY)


def sensitivity_sql() -> str:
    arms = []
    for i, rate in enumerate((0.1, 0.2, 0.3, 0.4, 0.5)):
        chain = priced_sql(OFFER, f"{rate!r}e0") + ", " + BAND
        arms.append(
            f"(WITH {chain} SELECT {rate!r}e0 AS offer_success_rate, threshold, flagged, precision, recall, "
            "round(net_benefit, 4) AS net_benefit FROM band ORDER BY threshold DESC LIMIT 1)"
        )
    return f"WITH {BASIS} " + " UNION ALL ".join(arms)


@query("f7_sensitivity", sensitivity_sql(), "book")
def sensitivity(spark, folder):
    return rounded(X.sensitivity(validation_basis(spark, folder), OFFER), 4, "net_benefit")


@query(
    "f8_economics_block",
    f"""WITH {BASIS}, {priced_sql()}, {BAND}, top AS (SELECT * FROM priced ORDER BY net_benefit DESC, threshold LIMIT 1),
best AS (SELECT * FROM band ORDER BY threshold DESC LIMIT 1)
SELECT (SELECT round(max(net_benefit) - {OFFER.offer_cost!r}e0, 4) FROM priced) AS band_floor,
  (SELECT max(flagged) FROM priced) AS customers, (SELECT max(true_positives + false_negatives) FROM priced) AS churners,
  (SELECT min(threshold) FROM band) AS band_low, (SELECT max(threshold) FROM band) AS band_high,
  best.threshold AS recommended_threshold, round(best.net_benefit, 4) AS recommended_net_benefit,
  top.threshold AS peak_threshold, round(top.net_benefit, 4) AS peak_net_benefit FROM best, top""",
    "book",
)
def economics_block(spark, folder):
    table = X.economics(validation_basis(spark, folder), OFFER)
    return rounded(table, 4, "band_floor", "recommended_net_benefit", "peak_net_benefit")


@query(
    "f9_return_on_spend",
    f"""WITH {BASIS}, {priced_sql()} SELECT threshold,
  CASE WHEN intervention_cost <> 0 THEN round(retained_value / intervention_cost, 9) END AS return_on_spend FROM priced""",
    "book",
)
def return_on_spend(spark, folder):
    table = X.priced(validation_basis(spark, folder), OFFER)
    return table.select(
        "threshold",
        F.round(E.return_on_spend("retained_value", "intervention_cost"), 9).alias("return_on_spend"),
    )


@query(
    "f10_campaign_comparison",
    f"""WITH {BASIS}, {priced_sql()}, {BAND}, top AS (SELECT * FROM priced ORDER BY net_benefit DESC, threshold LIMIT 1),
best AS (SELECT * FROM band ORDER BY threshold DESC LIMIT 1),
served AS (SELECT * FROM priced ORDER BY abs(threshold - 0.204e0), threshold LIMIT 1)
SELECT served.threshold, served.flagged, served.precision, served.recall, round(served.intervention_cost, 4) AS intervention_cost,
  round(served.retained_value, 4) AS retained_value, round(served.net_benefit, 4) AS net_benefit,
  CASE WHEN served.intervention_cost <> 0 THEN round(served.retained_value / served.intervention_cost, 9) END AS return_on_spend,
  top.threshold AS peak_threshold, round(top.net_benefit, 4) AS peak_net_benefit,
  best.threshold AS recommended_threshold, round(top.net_benefit - served.net_benefit, 4) AS peak_gain FROM served, top, best""",
    "book",
)
def campaign_comparison(spark, folder):
    table = X.campaign(validation_basis(spark, folder), 0.204, OFFER)
    return rounded(
        rounded(table, 4, "intervention_cost", "retained_value", "net_benefit", "peak_net_benefit", "peak_gain"),
        9, "return_on_spend",
    )


def metrics_sql(threshold: float) -> str:
    return f"""c AS (SELECT threshold, (SELECT max(true_positives + false_positives) FROM basis) AS n,
  true_positives AS tp, false_positives AS fp, false_negatives AS fn FROM basis WHERE abs(threshold - {threshold!r}e0) < 1e-9),
r AS (SELECT *, n - tp - fp - fn AS tn, tp + fn AS positives FROM c), q AS (SELECT *, {RATES} FROM r)
SELECT threshold, n, positives, tn, fp, fn, tp, accuracy, precision, recall, {F1} FROM q"""


@query("f11_metrics_off_the_basis", f"WITH {BASIS}, {metrics_sql(0.29)}", "book")
def metrics_off_basis(spark, folder):
    return rounded(X.metrics_at(validation_basis(spark, folder), 0.29), 9, "f1")


LOOKUPS = (0.0, 0.113, 0.25, 0.3649, 0.365, 0.9951, 1.0)


@query(
    "c13_nearest_cuts",
    f"""WITH {BASIS}, {priced_sql()}, looks(spot) AS (VALUES {', '.join(f'({x!r}e0)' for x in LOOKUPS)}),
k AS (SELECT spot, priced.*, row_number() OVER (PARTITION BY spot ORDER BY abs(threshold - spot), threshold) AS rn FROM looks, priced)
SELECT spot, threshold, flagged, precision, recall FROM k WHERE rn = 1""",
    "book",
)
def nearest_cuts(spark, folder):
    lookups = named_rows(spark, "spot double", [(x,) for x in LOOKUPS])
    table = X.nearest_cuts(lookups, X.priced(validation_basis(spark, folder), OFFER), at="spot")
    return table.select("spot", "threshold", "flagged", "precision", "recall")


READ_AT = (0.0, 0.29, 0.35, 0.57, 0.58)


@query(
    "c14_basis_at_cuts",
    f"""WITH {BASIS} SELECT basis.* FROM basis JOIN (VALUES {', '.join(f'({x!r}e0)' for x in READ_AT)}) c(t)
ON abs(threshold - t) < 1e-9""",
    "book",
)
def basis_at_cuts(spark, folder):
    return X.at_cuts(validation_basis(spark, folder), READ_AT).select(
        "cut", "threshold", "true_positives", "false_positives", "false_negatives", "flagged_churner_charges"
    )


@query("c14_cuts_not_in_the_basis", "SELECT 0.555e0 AS wanted", "book")
def cuts_not_in_basis(spark, folder):
    return X.missing_cuts(validation_basis(spark, folder), [0.29, 0.555, 0.58])


def candidates(spark, folder):
    """One candidate per segment, scored by its churn rate: a comparison table off the data."""
    table = S.rate_by(train(spark, folder), "segment", label="churn")
    return table.select(
        F.col("segment").alias("model"),
        F.col("churn_rate").alias("cv_pr_auc"),
        (F.col("segment") == "BUILDING").alias("selected"),
    )


@query(
    "c17_leader_gap",
    """WITH t AS (SELECT segment, CAST(sum(churn) AS DOUBLE) / count(*) AS r FROM book WHERE partition_name = 'train' GROUP BY 1)
SELECT (SELECT r FROM t WHERE segment = 'MACHINERY') - (SELECT r FROM t WHERE segment = 'BUILDING') AS gap""",
    "book",
)
def leader_gap(spark, folder):
    return X.leader_gap(candidates(spark, folder), "MACHINERY")


@query(
    "l15_score_validity_gate",
    """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (returned = 1) AS positives,
  count(*) FILTER (returned = 0) AS negatives, TRUE AS valid FROM lines""",
    "lines",
)
def score_validity(spark, folder):
    return Q.score_gate(lines(spark, folder), score="score", label="returned")
