"""Keeping small groups out of published aggregates: rules, complementary suppression, audits.

The rule: a group may be published, or worked out from what is published, only if it is empty or
has at least ``minimum`` rows of each outcome.  Everything here works on aggregate tables whose
size is set by the declared levels and the 101-cut grid, never by the number of rows behind them.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions.fixed import MIN_CELL
from scorebook.operators.economics import customers_of
from scorebook.operators.quality import SEGMENT_OUTCOMES
from scorebook.operators.tables import beside, named_rows

#: Thresholds nearer than this are one threshold.
SAME_PLACE = 1e-9

# --- reasons --------------------------------------------------------------------------------------


def crossed(hidden_levels: Mapping[str, Sequence[str]]) -> Column:
    """Whether a cell lies in a level that is always hidden."""
    out = F.lit(False)
    for dimension, levels in hidden_levels.items():
        out = out | ((F.col("rows") == dimension) & F.col("row").isin(*levels))
        out = out | F.coalesce((F.col("cols") == dimension) & F.col("col").isin(*levels), F.lit(False))
    return out


def reason_of(
    customers: Column, churned: Column, is_crossed: Column, hidden: Column, minimum: int = MIN_CELL
) -> Column:
    """Why a cell is hidden, or null; only what its size or the rule itself already says."""
    keeps = E.two_sided(churned, customers - churned, minimum)
    return (
        F.when(customers < minimum, "too_few")
        .when(is_crossed, "cross_partition")
        .when(hidden | churned.isNull() | ~keeps, "withheld")
    )


def suppressed(
    cells: DataFrame,
    *,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """Every cell with the reason its own counts give; counts themselves are kept for the guards."""
    reason = reason_of(
        F.col("customers"), F.col("churned"), crossed(hidden_levels or {}), F.lit(False), minimum
    )
    return cells.withColumn("reason", reason)


# --- complementary suppression along one line ---------------------------------------------------------


def hide_until_kept(
    df: DataFrame, *, keys: Sequence[str], hidden: Column, order: Sequence[str], keeps: Column
) -> DataFrame:
    """Hide further rows, in ``order``, until the hidden ones together keep the rule.

    ``keeps`` is read over running sums (``sum_of`` below) of the rows hidden so far.  A row is
    hidden if it is already, or if no earlier prefix that holds all hidden rows keeps the rule.
    """
    line = Window.partitionBy(*keys).orderBy(F.col("__hidden").desc(), *order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = df.withColumn("__hidden", hidden).withColumns(
        {
            "__place": F.count(F.lit(1)).over(upto),
            "__count": F.sum(F.col("__hidden").cast("int")).over(whole),
        }
    )
    kept = placed.withColumn("__keeps", keeps)
    settled = F.max(
        (F.col("__keeps") & (F.col("__place") >= F.col("__count"))).cast("int")
    ).over(before)
    return kept.withColumn(
        "hide",
        F.col("__hidden")
        | ((F.col("__count") > 0) & (F.coalesce(settled, F.lit(0)) == 0)),
    ).drop("__hidden", "__place", "__count", "__keeps")


def sum_of(column: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The running sum ``hide_until_kept`` judges a prefix by."""
    line = Window.partitionBy(*keys).orderBy(F.col("__hidden").desc(), *order)
    return F.sum(column).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def guard_one_way(
    cells: DataFrame,
    *,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """One-way tables with the further levels hidden that keep the hidden ones from following
    out of the partition's total.

    Smallest first, and never cheaper by search: it may hide a level more than an exact solver.
    Always-hidden levels alone are never left as the whole hidden set.
    """
    own = suppressed(cells, hidden_levels=hidden_levels, minimum=minimum).withColumn(
        "__alone", crossed(hidden_levels or {}).cast("int")
    )
    # An empty level is a known zero: nothing to hide, nothing to hide behind.
    filled, empty = own.where("customers > 0"), own.where("customers = 0")
    keys, order = ["rows"], ["customers", "row"]
    n, c, a = (sum_of(x, keys, order) for x in ("customers", "churned", "__alone"))
    keeps = E.two_sided(c, n - c, minimum) & (a < F.col("__place"))
    guarded = hide_until_kept(
        filled, keys=keys, hidden=F.col("reason").isNotNull(), order=order, keeps=keeps
    )
    reason = F.when(F.col("reason").isNull() & F.col("hide"), "withheld").otherwise(F.col("reason"))
    return (
        guarded.withColumn("reason", reason)
        .unionByName(empty.withColumn("hide", F.lit(False)))
        .drop("__alone", "hide")
    )


def guard_segments(segments: DataFrame, cells: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Segment rows with every outcome null where either side of the cut, or the hidden ones of
    a dimension together, break the rule.  ``cells`` is (dimension, segment, tn, fp, fn, tp)."""
    keys, order = ["dimension"], ["__size", "segment"]
    sized = cells.withColumn("__size", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))

    def both(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
        return E.two_sided(tp, fp, minimum) & E.two_sided(fn, tn, minimum)

    own = both(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    together = both(*(sum_of(c, keys, order) for c in ("tp", "fp", "fn", "tn")))
    marked = hide_until_kept(sized, keys=keys, hidden=~own, order=order, keeps=together).select(
        "dimension", "segment", "hide"
    )
    # A segment without cells cannot be judged, so it is hidden.
    joined = segments.join(marked, ["dimension", "segment"], "left")
    show = ~F.coalesce(F.col("hide"), F.lit(True))
    present = [c for c in SEGMENT_OUTCOMES if c in segments.columns]
    return joined.withColumns({c: F.when(show, F.col(c)) for c in present}).drop("hide")


def guard_bands(bands: DataFrame, overall: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Score bands with observed churn hidden where a band, or overall less the shown ones,
    breaks the rule.

    ``bands`` is (name, observed_customers, observed_churned); ``overall`` one row
    (customers, churned) they add up to.
    """
    n, c = F.col("observed_customers"), F.col("observed_churned")
    shown = F.coalesce(c.isNotNull() & E.two_sided(c, n - c, minimum), F.lit(False))
    everything = Window.partitionBy()
    whole = overall.select(
        F.col("customers").alias("__all_n"), F.coalesce("churned", F.lit(0)).alias("__all_c")
    )
    based = beside(bands.withColumn("__shown", shown), whole).withColumns(
        {
            # What the hidden bands are read off as before any further one is hidden ...
            "__rest_n": F.col("__all_n") - F.coalesce(F.sum(F.when(F.col("__shown"), n)).over(everything), F.lit(0)),
            "__rest_c": F.col("__all_c") - F.coalesce(F.sum(F.when(F.col("__shown"), c)).over(everything), F.lit(0)),
            # ... and what each further one adds.
            "__add_n": F.when(F.col("__shown"), n).otherwise(0),
            "__add_c": F.when(F.col("__shown"), c).otherwise(0),
        }
    )
    order = ["observed_customers", "name"]
    rest_n = F.col("__rest_n") + sum_of("__add_n", [], order)
    rest_c = F.col("__rest_c") + sum_of("__add_c", [], order)
    marked = hide_until_kept(
        based, keys=[], hidden=~F.col("__shown"), order=order,
        keeps=E.two_sided(rest_c, rest_n - rest_c, minimum),
    )
    kept = ~F.col("hide")
    return marked.select(
        "name",
        "observed_customers",
        F.when(kept, c).alias("observed_churned"),
        F.when(kept, E.ratio(c, n)).alias("observed_rate"),
    )


def guarded_report(table: DataFrame, reasons: DataFrame, column: str) -> DataFrame:
    """A report table with the outcome masked wherever ``reasons`` (level, reason) gives one."""
    hidden = reasons.select(F.col("level").alias(column), F.col("reason").alias("__reason"))
    joined = table.join(hidden, column, "left")
    show = F.col("__reason").isNull()
    outcomes = [c for c in ("churned", "churn_rate") if c in table.columns]
    return joined.withColumns({c: F.when(show, F.col(c)) for c in outcomes}).drop("__reason")


def published_ranking(ranking: DataFrame, decimals: int = 2) -> DataFrame:
    """A ranking placed by its exact strengths and then rounded, so no count follows from one."""
    order = Window.orderBy(F.col("strength").desc(), "feature")
    # One row per feature: a bounded table.
    return ranking.withColumn("place", F.row_number().over(order)).withColumn(
        "strength", F.round("strength", decimals)
    )


# --- cuts of the score --------------------------------------------------------------------------------


def intervals(basis: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives between neighbouring cuts, and above the last up to 1."""
    line = Window.partitionBy(*keys).orderBy("threshold")

    def step(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lead(c).over(line), F.lit(0))

    return basis.select(
        *keys,
        F.col("threshold").alias("low"),
        F.coalesce(F.lead("threshold").over(line), F.lit(1.0)).alias("high"),
        step("true_positives").alias("churners"),
        step("false_positives").alias("stayers"),
    )


def holds(basis: DataFrame, minimum: int = MIN_CELL, keys: Sequence[str] = ()) -> DataFrame:
    """Whether cuts start at 0 and every interval has enough of each outcome."""
    fine = (F.col("churners") >= minimum) & (F.col("stayers") >= minimum)
    return intervals(basis, keys).groupBy(*keys).agg(
        (F.bool_and(fine) & (F.min("low") == 0.0)).alias("holds")
    )


def safe_cuts(
    basis: DataFrame,
    required: Sequence[float] = (),
    preferred: Sequence[float] = (),
    *,
    minimum: int = MIN_CELL,
    forbidden: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The cuts to publish: ``required`` always, as many ``preferred`` ones as fit, and as many
    others as keep the rule; no row where no cuts do.

    Left to right, a cut is taken as soon as enough rows of each outcome lie behind it and
    before the next required one.  The walk is a fold over the basis' at most 101 cuts, one
    per key, so many segments are cut in one job.  ``forbidden`` names steps (low, high; a
    null high is the top; with the keys, if there are any) other publications rule out.
    """
    options = [
        [*required, *chosen]
        for size in range(len(preferred), -1, -1)
        for chosen in itertools.combinations(preferred, size)
    ]
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("option"),
                F.array(*[F.lit(float(t)) for t in chosen]).cast("array<double>").alias("stops"),
            )
            for i, chosen in enumerate(options)
        ]
    )
    rows = basis.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("threshold", "true_positives", "false_positives"))
        ).alias("cuts")
    )
    if forbidden is not None:
        step = F.struct("low", F.coalesce("high", F.lit(2.0)).alias("high"))
        banned = forbidden.groupBy(*keys).agg(F.collect_set(step).alias("banned"))
        rows = rows.join(banned, list(keys), "left") if keys else beside(rows, banned)
    else:
        rows = rows.withColumn("banned", F.lit(None).cast("array<struct<low:double,high:double>>"))
    rows = rows.select("*", F.inline(wanted)).withColumn("k", F.size("cuts"))

    def value(index: Column, name: str, missing: object) -> Column:
        return F.coalesce(F.get("cuts", index).getField(name), F.lit(missing))

    def enough(i: Column, j: Column) -> Column:
        churners = value(i, "true_positives", 0) - value(j, "true_positives", 0)
        stayers = value(i, "false_positives", 0) - value(j, "false_positives", 0)
        step = F.struct(
            value(i, "threshold", 2.0).alias("low"), value(j, "threshold", 2.0).alias("high")
        )
        allowed = ~F.coalesce(F.array_contains("banned", step), F.lit(False))
        return (churners >= minimum) & (stayers >= minimum) & allowed

    def near(t: Column) -> Column:
        return F.exists("stops", lambda s: F.abs(s - t) < 1e-9)

    indexes = F.sequence(F.lit(0), F.col("k") - 1)
    rows = rows.withColumn("at", F.filter(indexes, lambda i: near(value(i, "threshold", -1.0))))
    found = F.size("at") == F.size(F.array_distinct("stops"))
    starts = value(F.lit(0), "threshold", -1.0) == 0.0

    def following(j: Column) -> Column:
        return F.coalesce(F.array_min(F.filter("at", lambda s: s > j)), F.col("k"))

    start = F.struct(F.array(F.lit(0)).alias("kept"), F.lit(True).alias("ok"))

    def walk(state: Column, j: Column) -> Column:
        kept, ok = state.getField("kept"), state.getField("ok")
        last = F.element_at(kept, -1)
        stop = F.array_contains("at", j)
        reach = enough(last, j)
        take = stop | (reach & enough(j, following(j)))
        return F.struct(
            F.when(take, F.array_append(kept, j)).otherwise(kept).alias("kept"),
            (ok & (~stop | reach)).alias("ok"),
        )

    rest = F.filter(indexes, lambda i: i > 0)
    walked = rows.where(found & starts).withColumn("walk", F.aggregate(rest, start, walk))
    good = walked.where(
        F.col("walk.ok") & enough(F.element_at("walk.kept", -1), F.col("k"))
    )
    best = good.groupBy(*keys).agg(
        F.min_by(F.struct("walk.kept", "cuts"), F.col("option")).alias("best")
    )
    return best.select(*keys, F.explode("best.kept").alias("i"), F.col("best.cuts").alias("cuts")).select(
        *keys, F.get("cuts", F.col("i")).getField("threshold").alias("threshold")
    )


def basis_on(basis: DataFrame, cuts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A basis read at computed cuts (a table of thresholds)."""
    return basis.join(cuts, [*keys, "threshold"], "left_semi")


def churner_range(points: DataFrame, positives: Column, decimals: int = 2) -> DataFrame:
    """The flagged churners a printed precision and recall allow, as ``low`` and ``high``.

    Both bounds are intersections of two intervals, so nothing is enumerated; null where no
    whole number fits.
    """
    half = 0.5 * 10.0**-decimals + 1e-9
    flagged, p, r = F.col("flagged"), F.col("precision"), F.col("recall")
    low = F.greatest(
        F.ceil(flagged * (p - half)), F.ceil(positives * (r - half)), F.lit(0)
    ).cast("bigint")
    high = F.least(
        F.floor(flagged * (p + half)), F.floor(positives * (r + half)), flagged, positives
    ).cast("bigint")
    fits = F.col("__low") <= F.col("__high")
    return (
        points.withColumns({"__low": low, "__high": high})
        .withColumns({"low": F.when(fits, F.col("__low")), "high": F.when(fits, F.col("__high"))})
        .drop("__low", "__high")
    )


def line_of(df: DataFrame, name: str, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key, the rows as one array in the order of their thresholds."""
    row = F.struct("threshold", *fields)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias(name))


def both_lines(basis: DataFrame, stated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, own cuts and stated thresholds as two arrays of edges."""
    own = basis.withColumns(
        {
            "flagged": F.col("true_positives") + F.col("false_positives"),
            "low": F.col("true_positives"),
            "high": F.col("true_positives"),
        }
    )
    fields = ("flagged", "low", "high")
    cuts, others = line_of(own, "own", fields, keys), line_of(stated, "stated", fields, keys)
    rows = cuts.join(others, list(keys), "left") if keys else beside(cuts, others)
    empty = F.array().cast("array<struct<threshold:double,flagged:bigint,low:bigint,high:bigint>>")

    own_rows = F.transform("own", lambda o: edge(o["threshold"], *[o[f].cast("bigint") for f in fields]))
    known = F.transform(F.coalesce("stated", empty), lambda s: edge(s["threshold"], *[s[f].cast("bigint") for f in fields]))
    return rows.where(F.size("own") > 0).select(*keys, own_rows.alias("own"), known.alias("stated"))


def edge(threshold: Column, flagged: Column, low: Column, high: Column) -> Column:
    return F.struct(threshold.alias("threshold"), flagged.alias("flagged"), low.alias("low"), high.alias("high"))


def between(upper: Column, lower: Column) -> tuple[Column, Column]:
    """The fewest churners and stayers that a piece from one edge to the next may hold."""
    churners = upper["low"] - lower["high"]
    stayers = (upper["flagged"] - upper["high"]) - (lower["flagged"] - lower["low"])
    return churners, stayers


def pieces(basis: DataFrame, stated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The score pieces an outsider reads from own cuts and thresholds stated elsewhere together.

    ``stated`` is (keys, threshold, flagged, low, high): exact flagged counts, churners as a
    range.  Where both have a cut the own counts are exact.  Each piece carries the fewest
    churners and stayers it may hold, and whether it is this publication's to answer for.
    """
    lines = both_lines(basis, stated, keys)

    def at_own(s: Column) -> Column:
        return F.exists("own", lambda o: F.abs(o["threshold"] - s["threshold"]) <= SAME_PLACE)

    lines = lines.withColumn("stated", F.filter("stated", lambda s: ~at_own(s)))

    def marked(name: str, own: bool) -> Column:
        return F.transform(name, lambda e: F.struct(e["threshold"].alias("threshold"), F.lit(own).alias("own"), e.alias("e")))

    merged = lines.select(*keys, F.array_sort(F.concat(marked("own", True), marked("stated", False))).alias("edges"))
    top = edge(F.lit(None).cast("double"), *[F.lit(0).cast("bigint")] * 3)
    last = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("own"), top.alias("e"))
    steps = F.transform(
        F.sequence(F.lit(0), F.size("edges") - 1),
        lambda i: F.struct(F.get("edges", i).alias("a"), F.coalesce(F.get("edges", i + 1), last).alias("b")),
    )
    each = merged.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.a", "s.b")
    churners, stayers = between(F.col("a")["e"], F.col("b")["e"])
    answers = (F.col("a")["own"] & (F.col("a")["threshold"] != 0.0)) | F.col("b")["own"]
    return each.select(
        *keys,
        F.col("a")["threshold"].alias("from"),
        F.col("b")["threshold"].alias("to"),
        churners.alias("churners"),
        stayers.alias("stayers"),
        answers.alias("answers"),
    )


def legacy_holds(
    basis: DataFrame, stated: DataFrame, minimum: int = MIN_CELL, keys: Sequence[str] = ()
) -> DataFrame:
    """Whether own cuts, read with the stated ones, cut no piece the rule forbids (per key)."""
    thin = (F.col("churners") < minimum) | (F.col("stayers") < minimum)
    return pieces(basis, stated, keys).groupBy(*keys).agg(
        F.coalesce(~F.bool_or(thin & F.col("answers")), F.lit(True)).alias("holds")
    )


def forbidden_steps(
    basis: DataFrame, stated: DataFrame, minimum: int = MIN_CELL, keys: Sequence[str] = ()
) -> DataFrame:
    """Steps between two grid cuts that stated thresholds inside them split too thinly.

    For ``safe_cuts``: one row per (keys, low, high), a null high being the top.  The steps are
    those of a grid of at most 101 cuts per key; thresholds are compared as they stand, on the
    grid or off it, and one that lies at a grid cut still splits the steps that pass over that
    cut.  Of the pieces of a step only the first and the last touch an own cut and are this
    publication's, so each step looks at its outermost stated thresholds alone.
    """
    lines = both_lines(basis, stated, keys)

    # How many stated thresholds lie below each own cut, and how many below it or at it.
    below = F.transform(
        "own", lambda o: F.size(F.filter("stated", lambda s: s["threshold"] < o["threshold"] - SAME_PLACE))
    )
    upto = F.transform(
        "own", lambda o: F.size(F.filter("stated", lambda s: s["threshold"] <= o["threshold"] + SAME_PLACE))
    )
    top = edge(F.lit(None).cast("double"), *[F.lit(0).cast("bigint")] * 3)
    lines = lines.withColumns({"below": below, "passed": upto, "n": F.size("own")})
    first = lines.select("*", F.posexplode("own").alias("i", "a"))
    steps = first.select("*", F.explode(F.sequence(F.col("i") + 1, F.col("n"))).alias("j"))
    at_top = F.col("j") == F.col("n")
    steps = steps.withColumns(
        {
            "b": F.coalesce(F.get("own", F.col("j")), top),
            "from_": F.get("passed", F.col("i")),
            "upto": F.when(at_top, F.size("stated")).otherwise(F.get("below", F.col("j"))),
        }
    )
    inside = F.col("upto") > F.col("from_")
    head = F.when(inside, F.get("stated", F.col("from_"))).otherwise(F.col("b"))
    tail = F.when(inside, F.get("stated", F.col("upto") - 1)).otherwise(F.col("a"))

    def thin(upper: Column, lower: Column) -> Column:
        churners, stayers = between(upper, lower)
        return (churners < minimum) | (stayers < minimum)

    own_first = F.col("a")["threshold"] != 0.0
    broken = (thin(F.col("a"), head) & (own_first | (~inside & ~at_top))) | (
        thin(tail, F.col("b")) & (~at_top | (~inside & own_first))
    )
    return steps.where(broken).select(
        *keys, F.col("a")["threshold"].alias("low"), F.col("b")["threshold"].alias("high")
    )


# --- one table released once --------------------------------------------------------------------------


def released(metrics: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """A confusion table as it may be published: counts that add up, every cell large enough,
    rates worked out here; null figures where the rule says no.  ``adds_up`` says whether the
    input was one whole table at all."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    whole = (
        F.col("threshold").between(0.0, 1.0)
        & (F.least(tn, fp, fn, tp) >= 0)
        & (tn + fp + fn + tp == F.col("n"))
        & (tp + fn == F.col("positives"))
    )
    allowed = F.col("adds_up") & (F.least(tn, fp, fn, tp) >= minimum)
    rates = {
        "accuracy": E.ratio(tp + tn, "n"),
        "precision": E.ratio(tp, tp + fp),
        "recall": E.ratio(tp, tp + fn),
        "f1": E.ratio(2 * tp, 2 * tp + fp + fn),
    }
    out = metrics.withColumn("adds_up", F.coalesce(whole, F.lit(False))).withColumn(
        "published", allowed
    )
    for name, value in rates.items():
        out = out.withColumn(name, F.when(F.col("published"), F.round(value, 4)))
    # Masked last: the flags above read the counts themselves.
    counts = ("n", "positives", "tn", "fp", "fn", "tp")
    return out.withColumns({c: F.when(F.col("published"), F.col(c)) for c in counts})


def is_released(records: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Stored records with ``exact``: whether each is just what the rule writes."""
    names = ("accuracy", "precision", "recall", "f1")
    kept = records.withColumns({f"__{c}": F.col(c) for c in names})
    again = released(kept.drop(*names), minimum)
    same = F.col("published")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return again.withColumn("exact", same).drop(*[f"__{c}" for c in names])


# --- audits ------------------------------------------------------------------------------------------

FACT = "partitions string, outcomes string, low double, high double, value bigint"


def facts(
    *,
    basis: DataFrame | None = None,
    reliability: DataFrame | None = None,
    bands: DataFrame | None = None,
    overall: DataFrame | None = None,
) -> DataFrame:
    """Every published count of rows split by score, one row each."""
    parts: list[DataFrame] = []

    def add(df: DataFrame, partitions: str, outcomes: str, low: Column, high: Column, value: Column) -> None:
        parts.append(
            df.where(value.isNotNull()).select(
                F.lit(partitions).alias("partitions"), F.lit(outcomes).alias("outcomes"),
                low.cast("double").alias("low"), high.cast("double").alias("high"),
                value.cast("bigint").alias("value"),
            )
        )

    top = F.lit(2.0)
    if basis is not None:
        add(basis, "validation", "churned", F.col("threshold"), top, F.col("true_positives"))
        add(basis, "validation", "stayed", F.col("threshold"), top, F.col("false_positives"))
    if reliability is not None:
        for outcomes, value in (("all", "customers"), ("churned", "churned")):
            add(reliability, "validation", outcomes, F.col("low"), F.col("high"), F.col(value))
    if bands is not None:
        for outcomes, value in (("all", "observed_customers"), ("churned", "observed_churned")):
            add(bands, "train,validation", outcomes, F.col("min"), F.col("max"), F.col(value))
    if overall is not None:
        for outcomes, value in (("all", "customers"), ("churned", "churned")):
            add(overall, "train,validation", outcomes, F.lit(0.0), top, F.col(value))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_violations(known: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Runs of neighbouring score intervals whose counts follow by difference and break the rule.

    ``known`` is ``facts``; cumulative counts at every cut are taken from it, and each cut meets
    the later ones by its number: at most 101 cuts, and no pairing of anything larger.
    """
    at = (
        known.where((F.col("partitions") == "validation") & (F.col("high") > 1.0))
        .groupBy(F.round("low", 9).alias("t"))
        .agg(
            F.max(F.when(F.col("outcomes") == "churned", F.col("value"))).alias("c"),
            F.max(F.when(F.col("outcomes") == "stayed", F.col("value"))).alias("s"),
        )
        .where(F.col("c").isNotNull() & F.col("s").isNotNull())
    )
    numbered = at.withColumn("i", F.row_number().over(Window.orderBy("t")))
    count = numbered.agg(F.max("i").alias("k"))
    ends = numbered.select(
        F.col("i").alias("j"), F.col("t").alias("to"), F.col("c").alias("c2"), F.col("s").alias("s2")
    )
    starts = beside(numbered, count).select(
        "t", "c", "s", F.explode(F.sequence(F.col("i") + 1, F.col("k") + 1)).alias("j")
    )
    runs = starts.join(ends, "j", "left").select(
        F.col("t").alias("low"),
        F.coalesce("to", F.lit(1.0)).alias("high"),
        (F.col("c") - F.coalesce("c2", F.lit(0))).alias("churned"),
        (F.col("s") - F.coalesce("s2", F.lit(0))).alias("stayed"),
    )
    both = F.array(
        F.struct(F.lit("churned").alias("outcome"), F.col("churned").alias("value"), F.col("stayed").alias("other")),
        F.struct(F.lit("stayed").alias("outcome"), F.col("stayed").alias("value"), F.col("churned").alias("other")),
    )
    fine = (F.col("value") >= minimum) | ((F.col("value") == 0) & (F.col("other") == 0))
    return runs.select("low", "high", F.inline(both)).where(~fine).drop("other")


def new_violations(published: DataFrame, already: DataFrame) -> DataFrame:
    """Violations not already implied by older facts."""
    return published.join(already.select("low", "high", "outcome"), ["low", "high", "outcome"], "left_anti")


def external_sets(
    training: DataFrame, partition_churned: int | Column, test: DataFrame, population: DataFrame
) -> DataFrame:
    """Validation churners of level sets that other sources give by subtraction.

    ``training`` is (dimension, level, churned or null); ``test`` and ``population`` are
    (dimension, level, churners) stated elsewhere.  A shown level is a set of its own; the
    hidden ones of a dimension are one set together.
    """
    joined = training.join(test.withColumnRenamed("churners", "t"), ["dimension", "level"], "left").join(
        population.withColumnRenamed("churners", "p"), ["dimension", "level"], "left"
    )
    all_churned = partition_churned if isinstance(partition_churned, Column) else F.lit(partition_churned)
    shown = joined.where(F.col("churned").isNotNull()).select(
        "dimension", F.col("level").alias("members"), (F.col("p") - F.col("t") - F.col("churned")).alias("churners")
    )
    per_dimension = joined.groupBy("dimension").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("churned").isNull(), F.col("level")))), "|").alias("members"),
        F.sum("churned").alias("shown"),
        F.sum(F.when(F.col("churned").isNull(), F.col("p") - F.col("t"))).alias("rest"),
        F.count_if(F.col("churned").isNull()).alias("hidden"),
        F.count_if(F.col("churned").isNull() & (F.col("p").isNull() | F.col("t").isNull())).alias("unstated"),
    )
    together = per_dimension.where((F.col("hidden") > 0) & (F.col("unstated") == 0)).select(
        "dimension", "members",
        (F.col("rest") - (all_churned - F.coalesce("shown", F.lit(0)))).alias("churners"),
    )
    return shown.where(F.col("churners").isNotNull()).unionByName(together)


def segment_violations(
    segments: DataFrame, cells: DataFrame, totals: DataFrame, minimum: int = MIN_CELL
) -> DataFrame:
    """Unions of segments whose cells follow from what is published and break the rule.

    ``segments`` are the published rows (null ``churners`` where hidden); ``cells`` the four
    cells of the shown ones; ``totals`` one row of the partition's four cells.  Each shown
    segment is one union; the hidden ones of a dimension, as total less shown, another.
    Every other solvable union is a sum of these.
    """
    four = ("tp", "fp", "fn", "tn")
    shown = segments.where(F.col("churners").isNotNull()).select("dimension", "segment")
    known = cells.join(shown, ["dimension", "segment"], "left_semi").select("dimension", "segment", *four)
    hidden = segments.groupBy("dimension").agg(
        F.count_if(F.col("churners").isNull()).alias("hidden")
    ).where("hidden > 0")
    sums = known.groupBy("dimension").agg(*[F.sum(c).alias(f"s_{c}") for c in four])
    rest = beside(
        hidden.join(sums, "dimension", "left"), totals.select(*[F.col(c).alias(f"t_{c}") for c in four])
    ).select(
        "dimension",
        F.lit("(hidden together)").alias("segment"),
        *[(F.col(f"t_{c}") - F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in four],
    )
    tp, fp, fn, tn = (F.col(c) for c in four)
    sides = F.array(
        F.struct(F.lit("flagged").alias("side"), tp.alias("churners"), fp.alias("stayers")),
        F.struct(F.lit("left").alias("side"), fn.alias("churners"), tn.alias("stayers")),
        F.struct(F.lit("whole").alias("side"), (tp + fn).alias("churners"), (fp + tn).alias("stayers")),
    )
    return (
        known.unionByName(rest)
        .select("dimension", "segment", F.inline(sides))
        .where(~E.two_sided("churners", "stayers", minimum))
    )


def external_violations(sets: DataFrame, sizes: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Level sets whose validation churners others give away and that break the rule.

    ``sizes`` is (dimension, level, customers) of the validation segments.
    """
    n = (
        sets.select("dimension", "members", "churners", F.explode(F.split("members", "\\|")).alias("level"))
        .join(sizes, ["dimension", "level"])
        .groupBy("dimension", "members", "churners")
        .agg(F.sum("customers").alias("customers"))
    )
    return n.where(~E.two_sided("churners", F.col("customers") - F.col("churners"), minimum))


def transcription_differences(basis: DataFrame, points: DataFrame) -> DataFrame:
    """Stated points that are not the own full sweep: no such cut, other rows flagged, or a
    churner count the printed precision and recall do not allow."""
    own = basis.withColumn("__n", customers_of(basis)).select(
        "cut",
        (F.col("true_positives") + F.col("false_positives")).alias("own_flagged"),
        F.col("true_positives").alias("own_churners"),
        F.max(F.col("true_positives") + F.col("false_negatives")).over(Window.partitionBy()).alias("positives"),
    )
    stated = points.withColumn("cut", F.round(F.col("threshold") * 100).cast("int"))
    joined = churner_range(stated.join(own, "cut", "left"), F.col("positives"))
    reason = (
        F.when(F.col("own_flagged").isNull(), "no such cut")
        .when(F.col("own_flagged") != F.col("flagged"), "other rows flagged")
        .when(
            ~F.coalesce(F.col("own_churners").between(F.col("low"), F.col("high")), F.lit(False)),
            "not the printed rates",
        )
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("threshold", "reason")


# --- stored aggregates ----------------------------------------------------------------------------------


def merged_reliability(bins: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Old calibration bins summed into the coarser intervals that contain them.

    ``aligned`` is false where the old edges do not line up with the new ones.  The cuts are a
    short list in the plan, so there is no range join.
    """
    cuts = [float(t) for t in cuts]
    edges = [*cuts, 1.0]
    place = E.interval_index(F.col("low") + 1e-9, cuts)
    sums = (
        bins.withColumn("i", place)
        .groupBy("i")
        .agg(
            F.min("low").alias("first"),
            F.max("high").alias("last"),
            F.sum("customers").alias("customers"),
            (F.sum(F.col("mean_predicted") * F.col("customers")) / F.sum("customers")).alias("mean_predicted"),
            F.sum("churned").alias("churned"),
        )
    )
    declared = named_rows(
        bins.sparkSession, "i int, low double, high double",
        [(i, t, edges[i + 1]) for i, t in enumerate(cuts)],
    )
    lined = (F.abs(F.col("first") - F.col("low")) < 1e-9) & (F.abs(F.col("last") - F.col("high")) < 1e-9)
    return declared.join(sums, "i", "left").select(
        "low", "high", "customers", "mean_predicted", "churned",
        E.ratio("churned", "customers").alias("rate"),
        F.coalesce(lined, F.lit(False)).alias("aligned"),
    )


def integrity(
    *,
    basis: DataFrame,
    metrics: DataFrame | None = None,
    reliability: DataFrame | None = None,
    bands: DataFrame | None = None,
    overall: DataFrame | None = None,
    segments: DataFrame | None = None,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """Disagreements between stored aggregates as (check, at); empty when they are sound."""
    out: list[DataFrame] = []

    def finding(df: DataFrame, check: str, at: Column | None = None) -> None:
        place = F.lit(None) if at is None else at
        out.append(df.select(F.lit(check).alias("check"), place.cast("string").alias("at")))

    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    line = Window.orderBy("threshold")
    whole = Window.partitionBy()
    rows = basis.withColumns(
        {
            "__churners": F.max(tp + fn).over(whole),
            "__first": F.row_number().over(line) == 1,
            "__before": F.lag("flagged_churner_charges").over(line),
            "__flagged_before": F.lag(tp + fp).over(line),
        }
    )
    finding(rows.where(tp + fn != F.col("__churners")), "churners change along the sweep", F.col("threshold"))
    finding(
        rows.where(F.col("flagged_churner_charges") > F.col("__before") + 1e-6),
        "charges rise along the sweep", F.col("threshold"),
    )
    finding(rows.where(tp + fp > F.col("__flagged_before")), "flags rise along the sweep", F.col("threshold"))
    finding(
        rows.where(F.col("__first") & ((fn != 0) | (F.col("threshold") != 0.0))),
        "the first cut does not flag everyone", F.col("threshold"),
    )
    if metrics is not None:
        place = F.round(F.col("threshold") * 1e9).cast("bigint")
        cut = basis.withColumn("__n", customers_of(basis)).select(
            place.alias("__p"), tp.alias("__tp"), fp.alias("__fp"), fn.alias("__fn"), "__n"
        )
        joined = metrics.withColumn("__p", place).join(cut, "__p", "left")
        same = (
            (F.col("tp") == F.col("__tp")) & (F.col("fp") == F.col("__fp")) & (F.col("fn") == F.col("__fn"))
            & (F.col("n") == F.col("__n"))
        )
        finding(
            joined.where(~F.coalesce(same, F.lit(False))),
            "the operating point is not the sweep at its cut", F.col("threshold"),
        )
        rates = (
            (F.abs(F.col("accuracy") - E.ratio(F.col("tp") + F.col("tn"), "n")) < 1e-9)
            & (F.abs(F.col("recall") - E.ratio_or_zero("tp", F.col("tp") + F.col("fn"))) < 1e-9)
            & (F.abs(F.col("precision") - E.ratio_or_zero("tp", F.col("tp") + F.col("fp"))) < 1e-9)
        )
        finding(
            joined.where(~F.coalesce(rates, F.lit(False))),
            "rates and counts of the operating point disagree", F.col("threshold"),
        )
    if reliability is not None:
        want = intervals(basis).select(
            F.round(F.col("low") * 1e9).cast("bigint").alias("__p"),
            F.col("high").alias("__high"), F.col("churners").alias("__c"), F.col("stayers").alias("__s"),
        )
        joined = reliability.withColumn("__p", F.round(F.col("low") * 1e9).cast("bigint")).join(want, "__p", "full")
        same = (
            (F.abs(F.col("high") - F.col("__high")) < 1e-9)
            & (F.col("customers") == F.col("__c") + F.col("__s"))
            & (F.col("churned") == F.col("__c"))
        )
        finding(
            joined.where(~F.coalesce(same, F.lit(False))),
            "the bins are not the sweep's intervals", F.coalesce(F.col("low"), F.col("__p") / 1e9),
        )
    if bands is not None and overall is not None:
        sums = beside(
            bands.agg(
                F.sum("observed_customers").alias("n"), F.sum("observed_churned").alias("c"),
                F.sum(F.when(F.col("observed_churned").isNotNull(), F.col("observed_customers"))).alias("shown_n"),
                F.count_if(F.col("observed_churned").isNull()).alias("hidden"),
            ),
            overall.select(F.col("customers").alias("all_n"), F.col("churned").alias("all_c")),
        )
        finding(sums.where(F.col("n") != F.col("all_n")), "the bands do not add up")
        finding(
            sums.where((F.col("hidden") == 0) & (F.col("c") != F.col("all_c"))),
            "the bands' churn does not add up",
        )
        rest_c = F.col("all_c") - F.coalesce("c", F.lit(0))
        rest_n = F.col("all_n") - F.coalesce("shown_n", F.lit(0))
        finding(
            sums.where((F.col("hidden") > 0) & ~E.two_sided(rest_c, rest_n - rest_c, minimum)),
            "the hidden bands can be solved for",
        )
    if segments is not None:
        wrong = F.col("churners").isNotNull() & (
            (F.abs(F.col("churn_rate") - E.ratio("churners", "customers")) > 1e-12)
            | (F.abs(F.col("flagged_rate") - E.ratio("flagged", "customers")) > 1e-12)
        )
        finding(segments.where(wrong), "a segment's rate is not its counts'", F.col("segment"))
        whole_n = basis.agg(F.max(tp + fp).alias("all_n"))
        sums = beside(segments.groupBy("dimension").agg(F.sum("customers").alias("n")), whole_n)
        finding(
            sums.where(F.col("n") != F.col("all_n")), "a dimension does not add up", F.col("dimension")
        )
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found
