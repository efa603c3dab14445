"""Association statistics and score quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import MIN_CELL
from scorebook.operators.prefix import RANGE, running_totals, with_range
from scorebook.operators.segments import members
from scorebook.operators.tables import beside, named_rows

# --- association -----------------------------------------------------------------------------


def corrected_v(phi2: Column, n: Column, r: Column, k: Column) -> Column:
    """Bergsma's (2013) bias-corrected Cramer's V; 0 for a degenerate table."""
    phi = F.greatest(F.lit(0.0), phi2 - (r - 1) * (k - 1) / (n - 1))
    rows = r - (r - 1) * (r - 1) / (n - 1)
    columns = k - (k - 1) * (k - 1) / (n - 1)
    smaller = F.least(rows - 1, columns - 1)
    return F.when((n > 1) & (F.least(r, k) >= 2) & (smaller > 0), F.sqrt(phi / smaller)).otherwise(
        F.lit(0.0)
    )


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """V between two categories, one row.

    Chi-square over n is the sum of O^2 / (row * column) less one, so cells nobody is in
    need not be made.
    """
    cells = df.dropna(subset=[x, y]).groupBy(x, y).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(x).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(y).agg(F.sum("o").alias("c"))
    o, r, c = (F.col(name).cast("double") for name in ("o", "r", "c"))
    sums = (
        cells.join(rows, x)
        .join(columns, y)
        .agg(
            F.sum("o").cast("double").alias("n"),
            F.sum(o * o / (r * c)).alias("s"),
            F.count_distinct(x).cast("double").alias("rows"),
            F.count_distinct(y).cast("double").alias("columns"),
        )
    )
    v = corrected_v(F.col("s") - 1, F.col("n"), F.col("rows"), F.col("columns"))
    return sums.select(F.coalesce(v, F.lit(0.0)).alias("cramers_v"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over rows that have both; null for a constant, where ANSI mode would make the
    built-in one fail."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return E.ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def point_biserial_of(x: Column, y: Column) -> Column:
    """Pearson r of a number and a 0/1 label; 0 for fewer than 3 rows or a constant."""
    both = x.isNotNull() & y.isNotNull()
    value = F.when(both, x.cast("double"))
    answer = F.when(both, y.cast("double"))
    fine = (F.count_if(both) >= 3) & (F.min(value) < F.max(value)) & (F.min(answer) < F.max(answer))
    return F.when(fine, correlation(value, answer)).otherwise(F.lit(0.0))


def point_biserial(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(point_biserial_of(F.col(x), F.col(y)).alias("point_biserial"))


def association_ranking(
    df: DataFrame, *, categories: Sequence[str], numbers: Sequence[str], label: str
) -> DataFrame:
    """Every feature by strength of association with a 0/1 label, strongest first.

    Categories are read in one unpivoted pass; with a binary label the statistic needs only
    each value's size and positives.  Numbers are one aggregate over the same table.
    """
    known = df.where(F.col(label).isNotNull())
    values = (
        members(known.withColumn("__y", F.col(label).cast("bigint")), categories, carry=["__y"])
        .where(F.col("segment").isNotNull())
        .groupBy("dimension", "segment")
        .agg(F.count(F.lit(1)).cast("double").alias("r"), F.sum("__y").cast("double").alias("c"))
    )
    # The statistic separates into sums per value, so no value waits for its column's total.
    r, c, n, p = (F.col(x) for x in "rcnp")
    sums = values.groupBy("dimension").agg(
        F.sum("r").alias("n"),
        F.sum("c").alias("p"),
        F.sum(c * c / r).alias("with"),
        F.sum((r - c) * (r - c) / r).alias("without"),
        F.count(F.lit(1)).cast("double").alias("rows"),
    )
    both = (p > 0) & (p < n)
    by_category = sums.select(
        "dimension",
        "n",
        "rows",
        F.when(both, F.col("with") / p + F.col("without") / (n - p) - 1).otherwise(F.lit(0.0)).alias("phi2"),
        F.when(both, 2.0).otherwise(1.0).alias("columns"),
    )
    v = corrected_v(F.col("phi2"), F.col("n"), F.col("rows"), F.col("columns"))
    ranked = by_category.select(
        F.col("dimension").alias("feature"),
        F.lit("Cramer's V").alias("measure"),
        F.coalesce(v, F.lit(0.0)).alias("strength"),
        F.lit("n/a (categorical)").alias("direction"),
    )
    if numbers:
        y = F.col(label)
        stats = known.agg(*[point_biserial_of(F.col(x), y).alias(x) for x in numbers])
        pairs = F.array(
            *[F.struct(F.lit(x).alias("feature"), F.col(f"`{x}`").alias("r")) for x in numbers]
        )
        by_number = stats.select(F.inline(pairs)).select(
            "feature",
            F.lit("point-biserial |r|").alias("measure"),
            F.abs("r").alias("strength"),
            F.when(F.col("r") > 0, "higher -> more churn")
            .otherwise("higher -> less churn")
            .alias("direction"),
        )
        ranked = ranked.unionByName(by_number)
    return ranked.orderBy(F.col("strength").desc(), "feature")


def collinearity(df: DataFrame, *, total: str, tenure: str, amount: str) -> DataFrame:
    """Pearson r of a total against tenure times amount; reads features only."""
    product = F.col(tenure).cast("double") * F.col(amount).cast("double")
    return df.agg(correlation(F.col(total), product).alias("r"))


# --- score against outcome ---------------------------------------------------------------------


def scored_counts(df: DataFrame, *, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: what every ranking metric is computed from."""
    y = F.col(label)
    return df.groupBy(*keys, score).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def ranked(
    df: DataFrame, *, score: str, label: str, keys: Sequence[str] = (), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per key: positives, negatives, ROC-AUC, average precision and ``extra`` aggregates over the
    counts (``pos``, ``neg``) per distinct score, all from one pass over the rows."""
    per_score = scored_counts(df, score=score, label=label, keys=keys)
    run = running_totals(per_score, score, {"tp": "pos", "fp": "neg"}, keys=keys, descending=True)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    # A negative at this score loses to the positives above it and ties with those at it.
    beaten = neg * (tp - pos + 0.5 * pos)
    step = pos * (tp / (tp + fp))
    sums = run.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(beaten).alias("__pairs"),
        F.sum(step).alias("__steps"),
        *[value.alias(name) for name, value in (extra or {}).items()],
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(
        *keys,
        "positives",
        "negatives",
        F.when(both, F.col("__pairs") / (p * n)).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("__steps") / p).alias("average_precision"),
        *(extra or {}),
    )


def ranking_metrics(
    df: DataFrame,
    *,
    score: str,
    label: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (steps over distinct scores), per key.

    Both come from one running total along the score, highest first.  Null where a key holds
    a single class.
    """
    return ranked(df, score=score, label=label, keys=keys)


def confusion(
    df: DataFrame, *, score: str, label: str, threshold: float, keys: Sequence[str] = ()
) -> DataFrame:
    """The four cells at a threshold, per key."""
    hit, y = F.col(score) >= F.lit(float(threshold)), F.col(label)
    return df.groupBy(*keys).agg(
        F.count_if(~hit & (y == 0)).alias("tn"),
        F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"),
        F.count_if(hit & (y == 1)).alias("tp"),
    )


def with_rates(cells: DataFrame) -> DataFrame:
    """Size, positives, accuracy, precision, recall and F1; 0 where nothing is flagged."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({"n": tn + fp + fn + tp, "positives": tp + fn}).withColumns(
        {
            "accuracy": E.ratio(tp + tn, "n"),
            "precision": E.ratio_or_zero(tp, tp + fp),
            "recall": E.ratio_or_zero(tp, tp + fn),
        }
    ).withColumn("f1", E.f1("precision", "recall"))


def evaluate(df: DataFrame, *, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """All classification figures at one threshold, in one row."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [0, 1], got {threshold}")
    hit = F.col(score) >= F.lit(float(threshold))

    def cell(count: str, at: Column) -> Column:
        return F.coalesce(F.sum(F.when(at, F.col(count))), F.lit(0)).cast("bigint")

    miss, p = ~hit, F.col(score)
    # The error of a score is that of its positives and its negatives, so counts are enough.
    squares = F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p
    extra = {
        "tn": cell("neg", miss), "fp": cell("neg", hit), "fn": cell("pos", miss), "tp": cell("pos", hit),
        "brier": F.sum(squares) / F.sum(F.col("pos") + F.col("neg")),
    }
    found = ranked(df.withColumn(score, measurable(score)), score=score, label=label, extra=extra)
    rates = with_rates(found.withColumn("threshold", F.lit(float(threshold))).drop("positives", "negatives"))
    last = ["threshold", "brier", "roc_auc", "average_precision"]
    return rates.select(*[c for c in rates.columns if c not in last], *last)


def measurable(score: str) -> Column:
    """The score; a job that meets one that is missing, not a number or outside [0, 1] fails and
    says so, in whatever pass meets it first."""
    p = F.col(score)
    fine = p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    told = F.concat(F.lit(f"{score} cannot be measured: "), F.coalesce(p.cast("string"), F.lit("missing")))
    return F.when(fine, p).otherwise(F.raise_error(told).cast("double"))


def score_gate(df: DataFrame, *, score: str, label: str | None = None, rows: int | None = None) -> DataFrame:
    """Whether scores can be measured at all: finite, in [0, 1], both classes, one per row."""
    p = F.col(score)
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    checks = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("invalid"),
        (F.count_if(F.col(label) == 1) if label else F.lit(None).cast("bigint")).alias("positives"),
        (F.count_if(F.col(label) == 0) if label else F.lit(None).cast("bigint")).alias("negatives"),
    )
    fine = (F.col("rows") > 0) & (F.col("invalid") == 0)
    if label:
        fine = fine & (F.col("positives") > 0) & (F.col("negatives") > 0)
    if rows is not None:
        fine = fine & (F.col("rows") == rows)
    return checks.withColumn("valid", fine)


def reliability(
    df: DataFrame, *, score: str, label: str, bins: int = fixed.RELIABILITY_BINS
) -> DataFrame:
    """Observed rate against mean score per right-closed bin; empty bins are left out."""
    edges = E.reliability_edges(bins)
    table = df.groupBy(E.reliability_bin(score, bins).alias("bin")).agg(
        F.avg(score).alias("mean_predicted"),
        F.sum(F.col(label).cast("bigint")).alias("churned"),
        F.count(F.lit(1)).alias("count"),
    )
    rate = E.ratio("churned", "count")
    low = E.pick([(F.col("bin") == i, edges[i]) for i in range(bins)])
    high = E.pick([(F.col("bin") == i, edges[i + 1]) for i in range(bins)])
    return table.select(
        "bin",
        low.alias("low"),
        high.alias("high"),
        "count",
        "mean_predicted",
        "churned",
        rate.alias("observed_rate"),
        (rate - F.col("mean_predicted")).alias("gap"),
    )


def reliability_shown(table: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Bins as published: under ``minimum`` rows no outcome."""
    enough = F.col("count") >= minimum
    return table.select(
        "low",
        "high",
        F.col("count").alias("customers"),
        "mean_predicted",
        F.when(enough, F.col("churned")).alias("churned"),
        F.when(enough, F.col("observed_rate")).alias("rate"),
    )


def calibration_error(df: DataFrame, *, score: str, label: str, bins: int = fixed.RELIABILITY_BINS) -> DataFrame:
    """The count-weighted mean absolute gap."""
    table = reliability(df, score=score, label=label, bins=bins)
    return table.agg(
        (F.sum(F.col("count") * F.abs("gap")) / F.sum("count")).alias("ece")
    )


def reliability_on(df: DataFrame, *, score: str, label: str, cuts: Sequence[float]) -> DataFrame:
    """Reliability on the intervals between given cuts, the last one closed at 1.

    The cuts are a short list in the plan, so there is no range join.  A score's interval is found
    by bisection: a hundred comparisons written out make a method too long to be compiled, and
    every row would be interpreted.
    """
    cuts = [float(t) for t in cuts]
    edges = sorted({t + 0.0 for t in cuts})
    places = [-1] + [sum(t <= edge for t in cuts) - 1 for edge in edges]
    # Zero is added as the search tells -0 from 0; a score that is not a number lies above all.
    placed = with_range(
        df.select(F.col(score), F.col(label), (F.col(score) + F.lit(0.0)).alias("__at")), "__at", edges
    )
    place = F.get(F.array(*[F.lit(i) for i in places]), F.least(F.col(RANGE), F.lit(len(edges))))
    table = (
        placed.groupBy(F.when(F.col(RANGE).isNotNull(), place).alias("i"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg(score).alias("__mean"),
            F.sum(F.col(label).cast("bigint")).alias("churned"),
        )
        .where(F.col("i") >= 0)
    )
    declared = named_rows(
        df.sparkSession,
        "i int, low double, high double",
        [(i, t, cuts[i + 1] if i + 1 < len(cuts) else 1.0) for i, t in enumerate(cuts)],
    )
    return (
        declared.join(table, "i", "left")
        .fillna(0, subset=["customers", "churned"])
        .select(
            "low",
            "high",
            "customers",
            F.coalesce("__mean", "low").alias("mean_predicted"),
            "churned",
            E.ratio("churned", "customers").alias("rate"),
        )
    )


def segment_cells(
    df: DataFrame, columns: Sequence[str], *, score: str, label: str, threshold: float
) -> DataFrame:
    """The four cells of every (dimension, segment) at a threshold, all dimensions in one pass."""
    narrow = df.select(*columns, F.col(score).alias("__p"), F.col(label).alias("__y"))
    return confusion(
        members(narrow, columns, carry=["__p", "__y"]),
        score="__p",
        label="__y",
        threshold=threshold,
        keys=["dimension", "segment"],
    )


def segment_performance(
    df: DataFrame, columns: Sequence[str], *, score: str, label: str, threshold: float
) -> DataFrame:
    """Size, rate, flags, precision, recall with intervals, and ROC-AUC within each segment."""
    cells = segment_cells(df, columns, score=score, label=label, threshold=threshold)
    narrow = df.select(*columns, F.col(score).alias("__p"), F.col(label).alias("__y"))
    ranking = ranking_metrics(
        members(narrow, columns, carry=["__p", "__y"]),
        score="__p",
        label="__y",
        keys=["dimension", "segment"],
    ).select(F.col("dimension").alias("__d"), F.col("segment").alias("__s"), "roc_auc")
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sized = cells.withColumns(
        {"customers": tn + fp + fn + tp, "churners": tp + fn, "flagged": tp + fp}
    )
    precision_low, precision_high = E.wilson("tp", "flagged")
    recall_low, recall_high = E.wilson("tp", "churners")
    rated = sized.withColumns(
        {
            "churn_rate": E.ratio("churners", "customers"),
            "flagged_rate": E.ratio("flagged", "customers"),
            "precision": E.ratio("tp", "flagged"),
            "precision_low": precision_low,
            "precision_high": precision_high,
            "recall": E.ratio("tp", "churners"),
            "recall_low": recall_low,
            "recall_high": recall_high,
            "unscanned": (F.col("flagged") == 0) & (F.col("churners") > 0),
        }
    ).drop("tn", "fp", "fn", "tp")
    # A missing level is a segment like any other.
    same = (F.col("dimension") == F.col("__d")) & F.col("segment").eqNullSafe(F.col("__s"))
    return rated.join(ranking, same).drop("__d", "__s")


# The columns of a segment that state an outcome.
SEGMENT_OUTCOMES = (
    "churners", "churn_rate", "flagged_rate", "precision", "precision_low", "precision_high",
    "recall", "recall_low", "recall_high", "roc_auc", "unscanned",
)


def small_segments_hidden(segments: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Every outcome of a segment below ``minimum`` rows as null."""
    enough = F.col("customers") >= minimum
    return segments.withColumns({c: F.when(enough, F.col(c)) for c in SEGMENT_OUTCOMES})


def unscanned_note(segments: DataFrame) -> DataFrame:
    """How many segments nobody is flagged in though someone churned, and how many that were."""
    return segments.where("unscanned").agg(
        F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("churners"), F.lit(0)).alias("churners")
    )


def validation_summary(df: DataFrame, *, score: str, label: str, threshold: float) -> DataFrame:
    """``evaluate`` with the no-skill figures and the calibration error beside it."""
    ece = calibration_error(df, score=score, label=label)
    return (
        beside(evaluate(df, score=score, label=label, threshold=threshold), ece)
        .withColumn("churn_rate", E.ratio("positives", "n"))
        .withColumn("no_skill_accuracy", 1 - E.ratio("positives", "n"))
    )


def feature_ranks(ranking: DataFrame, features: Sequence[str], *, by: str = "strength") -> DataFrame:
    """The place of each of ``features`` in a ranking, strongest first."""
    kept = ranking.where(F.col("feature").isin(*features))
    order = Window.orderBy(F.col(by).desc(), F.col("feature").asc())
    # One row per model feature: a bounded table.
    return kept.select("feature", F.row_number().over(order).alias("rank"))


def rank_join(association: DataFrame, importance: DataFrame, features: Sequence[str]) -> DataFrame:
    """Association rank beside model-importance rank, per feature."""
    a = feature_ranks(association, features).withColumnRenamed("rank", "association_rank")
    b = feature_ranks(importance, features, by="mean_abs").withColumnRenamed("rank", "importance_rank")
    return a.join(b, "feature", "full")
