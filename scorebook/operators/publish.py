"""Publishing aggregates: figures on safe cuts, publishing again from what is stored, the gate.

A publication is a few small aggregate tables that are read together.  It is built on cuts that
keep the small-group rule, may be published again later under stricter rules from its own tables
alone, and is written in two phases: all parts go to a folder of their own, every audit reads what
was written, and only then one commit row makes the version visible.  A refused version is never
committed, so a reader sees the last one that passed, whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.fixed import MIN_CELL, Business
from scorebook.operators import disclosure as D
from scorebook.operators import economics as X
from scorebook.operators import joint as J
from scorebook.operators import quality as Q
from scorebook.operators import segments as S
from scorebook.session import durable

#: The cut that figures are quoted at by habit.
AT_HALF = 0.5
COMMIT = "number bigint, version string, parts array<string>"


class Refused(Exception):
    """A publication that an audit found fault with; ``findings`` are (check, at) pairs."""

    def __init__(self, findings: Sequence[tuple[str, str | None]]):
        super().__init__(f"{len(findings)} findings; first: {findings[0]}")
        self.findings = list(findings)


@dataclass(frozen=True)
class Publication:
    """Aggregates that are published together; a part that is not published is None.

    ``basis`` is a sweep at its cuts, ``metrics`` one confusion table with its ``threshold``,
    ``reliability`` the bins between the cuts, ``segments`` rows with null outcomes where hidden,
    ``breakdowns`` dense cells with null ``churned`` where hidden, ``total`` their one-row total.
    """

    basis: DataFrame | None = None
    metrics: DataFrame | None = None
    reliability: DataFrame | None = None
    segments: DataFrame | None = None
    breakdowns: DataFrame | None = None
    total: DataFrame | None = None

    def parts(self) -> dict[str, DataFrame]:
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in own.items() if df is not None}


def cuts_to_publish(
    basis: DataFrame,
    threshold: float,
    business: Business = Business(),
    *,
    stated: DataFrame | None = None,
    minimum: int = MIN_CELL,
) -> list[float]:
    """The cuts of a sweep that may be published: the served threshold always, its peak and one
    half where they fit, and as many others as keep the rule beside what is stated elsewhere.
    Empty where no cuts do.  At most 101 numbers."""
    peak = X.peak(X.priced(basis, business)).first()
    preferred = [float(peak["threshold"])] if peak else []
    preferred += [AT_HALF] if AT_HALF not in preferred else []
    forbidden = None if stated is None else D.forbidden_steps(basis, stated, minimum)
    cuts = D.safe_cuts(basis, (threshold,), preferred, minimum=minimum, forbidden=forbidden)
    return sorted(r["threshold"] for r in cuts.collect())


def figures_on_safe_cuts(
    rows: DataFrame,
    dimensions: Sequence[str],
    *,
    score: str,
    label: str,
    amount: str,
    id: str,
    threshold: float,
    business: Business = Business(),
    stated: DataFrame | None = None,
    minimum: int = MIN_CELL,
) -> Publication:
    """The sweep at safe cuts and the figures that are read on those cuts; an empty publication
    where no cuts keep the rule, as every figure at the threshold is a cut of its own.

    A group that would be hidden under one segment's name and shown under another's is refused.
    """
    fine = durable(X.sweep_basis(rows, score=score, label=label, amount=amount))
    cuts = cuts_to_publish(fine, threshold, business, stated=stated, minimum=minimum)
    if not cuts:
        return Publication()
    at = {"score": score, "label": label, "threshold": threshold}
    performance = Q.segment_performance(rows, list(dimensions), **at)
    cells = Q.segment_cells(rows, list(dimensions), **at)
    segments = durable(D.guard_segments(performance, cells, minimum))
    shown = segments.select("dimension", "segment", F.col("churners").isNotNull().alias("shown"))
    mixed = S.betrayed(S.identical_segments(rows, list(dimensions), id=id), shown)
    if not mixed.isEmpty():
        raise Refused([("a segment hidden under one name is shown under another", None)])
    metrics = Q.with_rates(Q.confusion(rows, **at)).withColumn("threshold", F.lit(float(threshold)))
    return Publication(
        basis=X.at_cuts(fine, cuts),
        metrics=metrics,
        reliability=Q.reliability_on(rows, score=score, label=label, cuts=cuts),
        segments=segments,
    )


def republished(
    old: Publication,
    *,
    threshold: float,
    business: Business = Business(),
    stated: DataFrame | None = None,
    minimum: int = MIN_CELL,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
) -> Publication:
    """A publication under the current rules, from its own tables alone: fewer cuts, bins summed
    into the wider intervals, more cells hidden, nothing new.

    Without safe cuts the sweep goes, and with it every figure at the threshold.
    """
    out = old
    if old.basis is not None:
        cuts = cuts_to_publish(old.basis, threshold, business, stated=stated, minimum=minimum)
        if cuts:
            out = replace(out, basis=X.at_cuts(old.basis, cuts))
            if old.reliability is not None:
                bins = durable(D.merged_reliability(old.reliability, cuts))
                if not bins.where(~F.col("aligned")).isEmpty():
                    raise Refused([("the old bins do not line up with the new cuts", None)])
                out = replace(out, reliability=bins.drop("aligned"))
        else:
            out = replace(out, basis=None, metrics=None, reliability=None, segments=None)
    if old.breakdowns is not None and old.total is not None:
        cells = old.breakdowns.drop("reason")
        out = replace(out, breakdowns=J.guard_published(cells, old.total, minimum=minimum, hidden_levels=hidden_levels))
    return out


def shown_anew(old: Publication, new: Publication) -> DataFrame | None:
    """What a publication says that the one it replaces did not: (check, at).  Cuts and bins
    have to be cuts and unions of bins of the old one, a shown cell has to be shown there alike."""
    found: list[DataFrame] = []

    def finding(df: DataFrame, check: str, at) -> None:
        found.append(df.select(F.lit(check).alias("check"), at.cast("string").alias("at")))

    if new.basis is not None and old.basis is not None:
        same = ["true_positives", "false_positives", "false_negatives"]
        place = F.round(F.col("threshold") * 1e9).cast("bigint").alias("__p")
        before = old.basis.select(place, *same)
        finding(new.basis.select("threshold", place, *same).join(before, ["__p", *same], "left_anti"), "a cut the old sweep does not have", F.col("threshold"))
    if new.reliability is not None and old.reliability is not None:
        edges = old.reliability.select(F.round("low", 9).alias("low"))
        finding(new.reliability.withColumn("low", F.round("low", 9)).join(edges, "low", "left_anti"), "a bin the old bins do not add up to", F.col("low"))
    if new.breakdowns is not None and old.breakdowns is not None:
        node = J.node_of().alias("__node")
        before = old.breakdowns.select(node, "customers", F.col("churned").alias("__churned")).where(F.col("__churned").isNotNull())
        after = new.breakdowns.where(F.col("churned").isNotNull()).select(node, "customers", F.col("churned").alias("__churned"))
        finding(after.join(before, ["__node", "customers", "__churned"], "left_anti"), "a cell that was hidden or different", F.col("__node"))
    return union(found)


def union(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def published_cells(segments: DataFrame) -> DataFrame:
    """The four cells of every shown segment, as its published figures give them."""
    tp = F.round(F.coalesce("recall", F.lit(0.0)) * F.col("churners")).cast("bigint")
    fn = F.col("churners") - F.col("tp")
    return (
        segments.where(F.col("churners").isNotNull())
        .withColumn("tp", tp)
        .withColumns({"fp": F.col("flagged") - F.col("tp"), "fn": fn})
        .withColumn("tn", F.col("customers") - F.col("flagged") - F.col("fn"))
        .select("dimension", "segment", "tp", "fp", "fn", "tn")
    )


def stated_facts(stated: DataFrame) -> DataFrame:
    """Thresholds stated elsewhere as facts, where their count is exact; a range is no fact."""
    exact = stated.where(F.col("low") == F.col("high"))
    both = F.array(
        F.struct(F.lit("churned").alias("outcomes"), F.col("low").alias("value")),
        F.struct(F.lit("stayed").alias("outcomes"), (F.col("flagged") - F.col("low")).alias("value")),
    )
    return exact.select(
        F.lit("validation").alias("partitions"), F.col("threshold").cast("double").alias("low"), F.lit(2.0).alias("high"), F.inline(both)
    ).select("partitions", "outcomes", "low", "high", F.col("value").cast("bigint").alias("value"))


def findings(
    publication: Publication,
    *,
    stated: DataFrame | None = None,
    cells: DataFrame | None = None,
    external: tuple[DataFrame, DataFrame] | None = None,
    minimum: int = MIN_CELL,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame | None:
    """Every reason not to publish, as (check, at); no row when there is none.

    Tables that guarding again would hide more of; groups that follow by difference from the
    cuts (only what is new beside ``stated`` facts); cuts that split a stated interval too
    thinly; segments, or the hidden ones together, that break the rule (from ``cells``, or from
    the published figures); sets that ``external`` counts give away; tables that disagree.
    """
    found: list[DataFrame] = []

    def finding(df: DataFrame, check: str, at) -> None:
        found.append(df.select(F.lit(check).alias("check"), at.cast("string").alias("at")))

    p = publication
    if p.breakdowns is not None and p.total is not None:
        before = p.breakdowns.drop("reason").withColumn("before", F.col("churned").isNull())
        again = J.guard_published(durable(before), p.total, minimum=minimum, hidden_levels=hidden_levels)
        finding(again.where(F.col("churned").isNull() & ~F.col("before")), "a table would hide more", J.node_of())
    if p.basis is not None:
        known = D.facts(basis=p.basis, reliability=p.reliability)
        if stated is None:
            runs = D.run_violations(known, minimum)
        else:
            other = durable(stated_facts(stated))
            runs = D.new_violations(D.run_violations(known.unionByName(other), minimum), D.run_violations(other, minimum))
            held = D.legacy_holds(p.basis, stated, minimum)
            finding(held.where(~F.col("holds")), "a cut splits a stated interval too thinly", F.lit(None))
        finding(runs, "a group can be differenced", F.col("low"))
        if p.segments is not None and p.metrics is not None:
            own = published_cells(p.segments) if cells is None else cells
            finding(D.segment_violations(p.segments, own, p.metrics.select("tp", "fp", "fn", "tn"), minimum), "a segment gives a small group away", F.concat_ws("=", "dimension", "segment"))
        whole = D.integrity(basis=p.basis, metrics=p.metrics, reliability=p.reliability, segments=p.segments, minimum=minimum)
        found.append(whole.select("check", F.col("at").cast("string").alias("at")))
    if external is not None:
        sets, sizes = external
        given = D.external_violations(sets, sizes, minimum)
        finding(given, "counts from elsewhere give a set away", F.concat_ws("=", *[F.col(c).cast("string") for c in given.columns[:2]]))
    return union(found)


# --- two phases ---------------------------------------------------------------------------------------


def staged(publication: Publication, path: str) -> tuple[str, list[str]]:
    """Write every part to a folder of a new version; nothing refers to it yet."""
    version = uuid.uuid4().hex
    parts = publication.parts()
    for name, df in parts.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    return version, sorted(parts)


def version_at(spark: SparkSession, path: str, version: str, parts: Sequence[str]) -> Publication:
    return Publication(**{name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in parts})


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits made so far: one row per published version."""
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def published(spark: SparkSession, path: str) -> Publication:
    """The version committed last; an empty publication where there is none."""
    last = commits(spark, path).orderBy(F.desc("number"), F.desc("version")).limit(1).collect()
    return version_at(spark, path, last[0]["version"], last[0]["parts"]) if last else Publication()


def publish(spark: SparkSession, publication: Publication, path: str, *, replaces: Publication | None = None, **audits) -> str:
    """Write a publication, audit what was written, commit it; the version's name.

    ``audits`` go to ``findings``; with ``replaces``, nothing may be new against it.  ``Refused``
    carries every finding, and nothing is committed then.  The findings are bounded by the
    aggregates' own size.  One publisher at a time: the commit row is one appended file, which a
    reader sees whole or not at all.
    """
    if not publication.parts():
        raise Refused([("there is nothing to publish", None)])
    version, parts = staged(publication, path)
    written = version_at(spark, path, version, parts)
    found = [findings(written, **audits), None if replaces is None else shown_anew(replaces, written)]
    reasons = union([f for f in found if f is not None])
    named = [(r["check"], r["at"]) for r in reasons.collect()] if reasons is not None else []
    if named:
        raise Refused(sorted(named, key=lambda r: (r[0], r[1] or "")))
    number = (commits(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, version, parts)], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
    return version
