"""Pricing a decision threshold: a sweep over 101 cuts, its basis, and what is read off it.

The sweep never compares every row with every cut.  Each row falls in one grid step; the
steps are counted once (at most 101 rows) and accumulated from the top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import Business
from scorebook.operators.tables import beside, named_rows, row_by

GRID = [(i, E.grid_value(i)) for i in range(fixed.GRID_CUTS)]


def sweep_basis(
    df: DataFrame, *, score: str, label: str, amount: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts and flagged churners' charges per cut: all that any assumption needs.

    Columns: ``cut``, ``threshold``, ``true_positives``, ``false_positives``,
    ``false_negatives``, ``flagged_churner_charges``.
    """
    y = F.col(label)
    steps = df.groupBy(*keys, E.grid_index(score).alias("cut")).agg(
        F.count_if(y == 1).alias("__pos"),
        F.count_if(y == 0).alias("__neg"),
        F.sum(F.when(y == 1, F.col(amount).cast("decimal(20,4)"))).alias("__charges"),
    )
    grid = named_rows(df.sparkSession, "cut int, threshold double", GRID)
    if keys:
        # Every key gets the whole grid: 101 rows per key, from a literal list.
        places = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(t).alias("threshold")) for i, t in GRID])
        grid = steps.select(*keys).distinct().select(*keys, F.inline(places))
    full = grid.join(steps, [*keys, "cut"], "left")
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.col("cut").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    everyone = Window.partitionBy(*keys)
    tp = F.coalesce(F.sum("__pos").over(above), F.lit(0))
    return full.select(
        *keys,
        "cut",
        "threshold",
        tp.alias("true_positives"),
        F.coalesce(F.sum("__neg").over(above), F.lit(0)).alias("false_positives"),
        (F.coalesce(F.sum("__pos").over(everyone), F.lit(0)) - tp).alias("false_negatives"),
        F.coalesce(F.sum("__charges").over(above).cast("double"), F.lit(0.0)).alias(
            "flagged_churner_charges"
        ),
    )


def customers_of(basis: DataFrame, keys: Sequence[str] = ()) -> Column:
    """The partition's size: everyone is flagged at the lowest cut."""
    return F.max(F.col("true_positives") + F.col("false_positives")).over(Window.partitionBy(*keys))


def priced(
    basis: DataFrame,
    business: Business = Business(),
    *,
    success_rate: Column | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The sweep under given assumptions, from the basis alone; never a second scan."""
    rate = F.lit(business.success_rate) if success_rate is None else success_rate
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    flagged = tp + fp
    rated = basis.select(
        *keys,
        "threshold",
        flagged.alias("flagged"),
        E.ratio(flagged, customers_of(basis, keys)).alias("flagged_share"),
        "true_positives",
        "false_positives",
        "false_negatives",
        E.ratio_or_zero(tp, flagged).alias("precision"),
        E.ratio_or_zero(tp, tp + fn).alias("recall"),
        (flagged * F.lit(business.offer_cost)).alias("intervention_cost"),
        (E.customer_value("flagged_churner_charges", business) * rate).alias("retained_value"),
    )
    return rated.withColumn("f1", E.f1("precision", "recall")).withColumn(
        "net_benefit", F.col("retained_value") - F.col("intervention_cost")
    )


def sweep(
    df: DataFrame, business: Business = Business(), *, score: str, label: str, amount: str
) -> DataFrame:
    return priced(sweep_basis(df, score=score, label=label, amount=amount), business)


def indifference_band(
    priced_sweep: DataFrame, business: Business = Business(), *, keys: Sequence[str] = ()
) -> DataFrame:
    """Cuts within one offer's cost of the best net benefit."""
    best = F.max("net_benefit").over(Window.partitionBy(*keys))
    floor = best - F.lit(max(business.offer_cost, 0.0))
    return (
        priced_sweep.withColumn("__floor", floor)
        .where(F.col("net_benefit") >= F.col("__floor"))
        .drop("__floor")
    )


def recommended(
    priced_sweep: DataFrame, business: Business = Business(), *, keys: Sequence[str] = ()
) -> DataFrame:
    """The highest cut in the indifference band."""
    return row_by(
        indifference_band(priced_sweep, business, keys=keys), F.col("threshold"), keys=keys, largest=True
    )


def peak(priced_sweep: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The first cut with the best net benefit."""
    return row_by(
        priced_sweep,
        F.struct((-F.col("net_benefit")).alias("a"), F.col("threshold").alias("b")),
        keys=keys,
        largest=False,
    )


def scenario_at(priced_sweep: DataFrame, threshold: float) -> DataFrame:
    """The sweep's row nearest a threshold, the first of equally near ones."""
    gap = F.abs(F.col("threshold") - F.lit(float(threshold)))
    return row_by(
        priced_sweep, F.struct(gap.alias("a"), F.col("threshold").alias("b")), largest=False
    )


def nearest_cuts(lookups: DataFrame, priced_sweep: DataFrame, *, at: str = "at") -> DataFrame:
    """``scenario_at`` for many thresholds: each joins the two grid steps around it, so the work
    is two equi-joined rows per lookup and not a scan of the sweep per lookup."""
    place = E.grid_index(F.greatest(F.least(F.col(at), F.lit(1.0)), F.lit(0.0)))
    each = lookups.withColumn("__lookup", F.monotonically_increasing_id())
    near = each.withColumn("__cut", F.explode(F.array(place, place + 1)))
    grid = priced_sweep.withColumn("__cut", E.grid_index("threshold"))
    gap = F.abs(F.col("threshold") - F.col(at))
    return row_by(
        near.join(grid, "__cut").drop("__cut").withColumn("__gap", gap),
        F.struct(F.col("__gap"), F.col("threshold")),
        keys=["__lookup"],
        largest=False,
    ).drop("__gap", "__lookup")


def sensitivity(
    basis: DataFrame,
    business: Business = Business(),
    success_rates: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5),
) -> DataFrame:
    """The recommendation under other success rates, from one basis."""
    rates = F.array(*[F.lit(float(r)) for r in success_rates])
    repeated = basis.withColumn("offer_success_rate", F.explode(rates))
    keys = ["offer_success_rate"]
    table = priced(repeated, business, success_rate=F.col("offer_success_rate"), keys=keys)
    return recommended(table, business, keys=keys).select(
        "offer_success_rate", "threshold", "flagged", "precision", "recall", "net_benefit"
    )


def economics(basis: DataFrame, business: Business = Business()) -> DataFrame:
    """Recommendation, peak and band edges in one row."""
    table = priced(basis, business)
    band = indifference_band(table, business).agg(
        F.min("threshold").alias("band_low"), F.max("threshold").alias("band_high")
    )
    floor = table.agg(
        (F.max("net_benefit") - F.lit(max(business.offer_cost, 0.0))).alias("band_floor"),
        F.max("flagged").alias("customers"),
        F.max(F.col("true_positives") + F.col("false_negatives")).alias("churners"),
    )
    best = recommended(table, business).select(
        F.col("threshold").alias("recommended_threshold"),
        F.col("net_benefit").alias("recommended_net_benefit"),
    )
    top = peak(table).select(
        F.col("threshold").alias("peak_threshold"), F.col("net_benefit").alias("peak_net_benefit")
    )
    return beside(floor, band, best, top)


def campaign(basis: DataFrame, threshold: float, business: Business = Business()) -> DataFrame:
    """The served cut against the peak and the recommendation."""
    table = priced(basis, business)
    served = scenario_at(table, threshold).select(
        "threshold", "flagged", "precision", "recall", "intervention_cost", "retained_value",
        "net_benefit",
        E.return_on_spend("retained_value", "intervention_cost").alias("return_on_spend"),
    )
    top = peak(table).select(
        F.col("threshold").alias("peak_threshold"), F.col("net_benefit").alias("peak_net_benefit")
    )
    best = recommended(table, business).select(F.col("threshold").alias("recommended_threshold"))
    return beside(served, top, best).withColumn(
        "peak_gain", F.col("peak_net_benefit") - F.col("net_benefit")
    )


def at_cuts(basis: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``basis`` read at given cuts only; each must be one of its thresholds and they must rise.

    Joined on the grid step and then checked against the threshold itself.
    """
    cuts = [float(t) for t in cuts]
    if any(b <= a for a, b in zip(cuts, cuts[1:], strict=False)):
        raise ValueError(f"cuts have to rise strictly: {cuts}")
    wanted = named_rows(
        basis.sparkSession, "cut int, wanted double", [(round(t * 100), t) for t in cuts]
    )
    return (
        basis.join(wanted, "cut")
        .where(F.abs(F.col("threshold") - F.col("wanted")) < 1e-9)
        .drop("wanted")
    )


def missing_cuts(basis: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Requested cuts the basis does not have."""
    wanted = named_rows(
        basis.sparkSession, "cut int, wanted double", [(round(t * 100), float(t)) for t in cuts]
    )
    held = at_cuts(basis, sorted(cuts)).select("cut")
    return wanted.join(held, "cut", "left_anti").select("wanted")


def metrics_at(basis: DataFrame, threshold: float) -> DataFrame:
    """Classification figures read off a basis at one of its cuts; no row for any other cut."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return (
        basis.withColumn("n", customers_of(basis))
        .where(F.abs(F.col("threshold") - F.lit(float(threshold))) < 1e-9)
        .select(
            "threshold",
            "n",
            (tp + fn).alias("positives"),
            (F.col("n") - tp - fp - fn).alias("tn"),
            fp.alias("fp"),
            fn.alias("fn"),
            tp.alias("tp"),
            E.ratio(F.col("n") - fp - fn, "n").alias("accuracy"),
            E.ratio_or_zero(tp, tp + fp).alias("precision"),
            E.ratio_or_zero(tp, tp + fn).alias("recall"),
        )
        .withColumn("f1", E.f1("precision", "recall"))
    )


def leader_gap(candidates: DataFrame, leader: str, *, by: str = "cv_pr_auc") -> DataFrame:
    """How far the leader's score is above the selected candidate's; null unless each matches
    exactly one row."""
    is_leader, chosen = F.col("model") == leader, F.col("selected")
    return candidates.agg(
        F.count_if(is_leader).alias("a"),
        F.count_if(chosen).alias("b"),
        F.max(F.when(is_leader, F.col(by))).alias("x"),
        F.max(F.when(chosen, F.col(by))).alias("y"),
    ).select(F.when((F.col("a") == 1) & (F.col("b") == 1), F.col("x") - F.col("y")).alias("gap"))
