"""Permutation Shapley attributions as one Spark job, and what is read off them.

A step of an ordering scores rows that take the explained row's value for the features placed so
far and a background row's for the rest.  Only the *set* of placed features matters, so the sets
of all orderings are made once, each is scored against the bounded background in one transform,
and a feature's contribution is a fixed combination of the sets' mean scores.

Where the score is a link of one term per feature, a set's margin is a sum of terms of the row and
of the background, so the terms are made once per row and no mixed row is built (``Additive``).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.operators.split import seeded_sample
from scorebook.operators.tables import beside, named_rows

Score = Callable[[DataFrame], DataFrame]

TERMS = "__terms"
# Explained rows whose margins are held at once: times the background, in doubles.
BLOCK = 1024


@dataclass(frozen=True)
class Additive:
    """A score that is ``link`` of ``constant`` plus one term per feature.

    ``terms`` adds ``TERMS``, the terms in the order of the features, to rows; ``link`` goes from
    arrays of margins to arrays of scores.
    """

    terms: Score
    constant: float
    link: Callable[[np.ndarray], np.ndarray]


def orderings(features: Sequence[str], n: int, seed: int) -> list[list[str]]:
    """``n`` seeded orderings and their reverses."""
    out = []
    for i in range(n):
        order = sorted(features, key=lambda f: hashlib.md5(f"{f}:{seed}:{i}".encode()).hexdigest())
        out += [order, order[::-1]]
    return out


def set_weights(features: Sequence[str], n: int, seed: int) -> dict[int, dict[str, float]]:
    """Feature sets (as bit masks) and each one's weight in every feature's contribution."""
    bit = {f: 1 << i for i, f in enumerate(features)}
    walks = orderings(features, n, seed)
    weights: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for walk in walks:
        mask = 0
        for f in walk:
            weights[mask][f] -= 1.0 / len(walks)
            mask |= bit[f]
            weights[mask][f] += 1.0 / len(walks)
    return {mask: dict(w) for mask, w in weights.items()}


def background(train: DataFrame, n: int = fixed.BACKGROUND_ROWS, *, id: str, seed: int) -> DataFrame:
    """The reference population: exactly ``n`` rows, the same for the same seed."""
    return seeded_sample(train, n, id=id, seed=seed)


def hybrid_rows(
    explained: DataFrame, reference: DataFrame, features: Sequence[str], masks: Sequence[int], *, id: str
) -> DataFrame:
    """Explained rows times sets times background rows.

    The background is a bounded sample carried as one array by a scalar subquery, so no table is
    cross joined and nothing of the explained rows moves.
    """
    held = reference.agg(
        F.collect_list(F.struct(*[F.col(f).alias(f"b_{f}") for f in features])).alias("__bg")
    )
    sets = F.array(*[F.lit(m) for m in masks])
    # Each explained row becomes thousands: spread them first, over a fixed number of tasks.
    tasks = int(explained.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = (
        beside(explained.select(id, *features).repartition(tasks, id), held)
        .withColumn("__mask", F.explode(sets))
        .select(id, *features, "__mask", F.explode("__bg").alias("__b"))
    )
    values = [
        F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f))
        .otherwise(F.col(f"__b.b_{f}"))
        .alias(f)
        for i, f in enumerate(features)
    ]
    return wide.select(id, "__mask", *values)


def set_means(
    explained: DataFrame,
    reference: DataFrame,
    additive: Additive,
    features: Sequence[str],
    weights: Mapping[int, Mapping[str, float]],
    *,
    id: str,
    output: str,
) -> DataFrame:
    """Per id the contributions as an array, the base value and the score.

    Every explained row meets every set and every background row, as margins in blocks of rows; the
    background is a bounded sample.
    """
    behind = additive.terms(reference.select(*features)).select(TERMS).collect()
    terms = np.array([r[0] for r in behind], dtype=float).reshape(len(behind), len(features))
    masks, constant, link, block = sorted(weights), additive.constant, additive.link, BLOCK
    placed = np.array([[m >> i & 1 for i in range(len(features))] for m in masks], dtype=float)
    shift = constant + (1.0 - placed) @ terms.T
    combine = np.array([[weights[m].get(f, 0.0) for f in features] for m in masks])
    empty, whole = masks.index(0), masks.index((1 << len(features)) - 1)

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                own = np.asarray(part.column(1).flatten(), dtype=float).reshape(part.num_rows, -1) @ placed.T
                means = np.stack(
                    [link(own[:, k, None] + shift[k]).mean(axis=1) for k in range(len(shift))], axis=1
                )
                parts = pa.array(list(means @ combine), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), parts, pa.array(means[:, empty]), pa.array(means[:, whole])],
                    names=["id", "parts", "base", "score"],
                )

    # Each row costs thousands of scores: spread them first, over a fixed number of tasks.
    tasks = int(explained.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = explained.where(F.col(id).isNotNull()).select(id, *features).repartition(tasks, id)
    kind = explained.schema[id].dataType.simpleString()
    rows = additive.terms(known).select(F.col(id).alias("id"), TERMS).mapInArrow(
        blocks, f"id {kind}, parts array<double>, base double, score double"
    )
    # An id that comes several times has the mean of its rows.
    return rows.groupBy(F.col("id").alias(id)).agg(
        F.array(*[F.avg(F.get("parts", F.lit(i))) for i in range(len(features))]).alias("__parts"),
        F.avg("base").alias("base_value"),
        F.avg("score").alias(output),
    )


def attributions(
    explained: DataFrame,
    reference: DataFrame,
    score: Score,
    features: Sequence[str],
    *,
    id: str,
    n_orderings: int = fixed.ORDERINGS,
    seed: int = 0,
    output: str = "score",
    additive: Additive | None = None,
) -> DataFrame:
    """Long attributions (id, feature, value, contribution, base_value, score).

    Contributions add up to the row's score less the base value, the background's mean score.
    ``additive`` says how ``score`` is made of terms, where it is; the attributions are the same.
    """
    weights = set_weights(features, n_orderings, seed)
    values = explained.select(id, *[F.col(f).cast("string").alias(f) for f in features]).unpivot(
        id, list(features), "feature", "value"
    )
    if additive is not None:
        means = set_means(explained, reference, additive, features, weights, id=id, output=output)
        each = [
            F.struct(F.lit(f).alias("feature"), F.get("__parts", F.lit(i)).alias("contribution"))
            for i, f in enumerate(features)
        ]
        long = means.select(id, "base_value", output, F.inline(F.array(*each)))
        return long.join(values, [id, "feature"]).select(
            id, "feature", "contribution", "value", "base_value", output
        )
    everything = (1 << len(features)) - 1
    rows = hybrid_rows(explained, reference, features, sorted(weights), id=id)
    means = score(rows).groupBy(id, "__mask").agg(F.avg(output).alias("__v"))
    table = named_rows(
        explained.sparkSession,
        "__mask int, feature string, w double",
        [(m, f, w) for m, per in weights.items() for f, w in per.items()],
    )
    parts = means.join(table, "__mask")
    contributions = parts.groupBy(id, "feature").agg(F.sum(F.col("w") * F.col("__v")).alias("contribution"))
    ends = means.groupBy(id).agg(
        F.max(F.when(F.col("__mask") == 0, F.col("__v"))).alias("base_value"),
        F.max(F.when(F.col("__mask") == everything, F.col("__v"))).alias(output),
    )
    return contributions.join(values, [id, "feature"]).join(ends, id)


def additivity(table: DataFrame, *, id: str, score: str = "score") -> DataFrame:
    """How closely base value and contributions reproduce the score, and whether it is close
    enough to be served."""
    per_row = table.groupBy(id).agg(
        F.sum("contribution").alias("s"), F.max("base_value").alias("b"), F.max(score).alias("p")
    )
    gap = F.max(F.abs(F.col("b") + F.col("s") - F.col("p")))
    return per_row.agg(gap.alias("max_gap")).withColumn(
        "served", F.col("max_gap") <= fixed.ADDITIVITY_TOLERANCE
    )


def global_importance(table: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Features by mean absolute contribution, with their share of the total."""
    means = table.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    total = F.sum("mean_abs").over(Window.partitionBy())
    return means.select(
        "feature",
        E.label_of("feature", labels or {}).alias("label"),
        "mean_abs",
        F.coalesce(E.ratio("mean_abs", total), F.lit(0.0)).alias("share"),
    ).orderBy(F.col("mean_abs").desc(), "feature")


def top_contributions(table: DataFrame, k: int = 5, *, id: str) -> DataFrame:
    """Each row's strongest contributions; a limited rank, so the rest is dropped early."""
    order = Window.partitionBy(id).orderBy(F.abs("contribution").desc(), "feature")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def narrated(
    table: DataFrame, labels: Mapping[str, str] | None = None, **units: Sequence[str]
) -> DataFrame:
    """Contributions in words."""
    value = E.shown_value("feature", "value", **units)
    return table.withColumn(
        "sentence", E.sentence(E.label_of("feature", labels or {}), value, "contribution")
    )


def group_mean(contribution: Column, minimum: int = fixed.DEPENDENCE_MIN) -> Column:
    """A mean contribution, withheld for a group too small to be stable."""
    return F.when(F.count(F.lit(1)) >= minimum, F.round(F.avg(contribution), 6))


def categorical_dependence(table: DataFrame, vocabularies: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean contribution per category, every declared category kept."""
    found = table.where(F.col("feature").isin(*vocabularies)).groupBy("feature", F.col("value").alias("category")).agg(
        F.count(F.lit(1)).alias("customers"), group_mean(F.col("contribution")).alias("mean")
    )
    declared = named_rows(
        table.sparkSession, "feature string, category string, position int",
        [(f, v, i) for f, words in vocabularies.items() for i, v in enumerate(words)],
    )
    return declared.join(found, ["feature", "category"], "left").fillna(0, subset=["customers"])


def numeric_dependence(
    table: DataFrame, features: Sequence[str], bins: int = fixed.DEPENDENCE_BINS
) -> DataFrame:
    """Mean contribution per equal-width, right-closed group of each numeric feature.

    The inner edges are compared with the value, so the minimum falls in the first group, the
    maximum in the last, and a constant in one group.
    """
    rows = table.where(F.col("feature").isin(*features)).withColumn("x", F.col("value").try_cast("double"))
    ends = rows.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = rows.join(ends, "feature")
    step = (F.col("hi") - F.col("lo")) / bins
    index = F.lit(0)
    for i in range(1, bins):
        index = index + (F.col("x") > F.col("lo") + step * i).cast("int")
    edge = F.col("lo") + step * F.col("bin")
    upper = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + step * (F.col("bin") + 1))
    return (
        placed.withColumn("bin", index)
        .groupBy("feature", "bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("customers"), group_mean(F.col("contribution")).alias("mean"))
        .select("feature", edge.alias("low"), upper.alias("high"), "customers", "mean")
    )
