"""Quality: a sparse ensemble of rules over statistics of a text.

Shallow trees are grown on the statistics of labelled documents; every path from a root is one
conjunctive rule; a lasso logistic regression gives most rules the weight zero; the rules left
are compiled into one Spark column expression.

A null text counts as empty; empty and very long texts have all statistics defined.  Repeated rows
are scored row by row.  Without labels of both classes there are no rules and the score is the
share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import labelled_ids, stored, without

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, as expressions over it; shares are 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    n_words = F.size(words)
    shifted = F.slice(words, F.lit(2), F.greatest(n_words - 1, F.lit(0)))
    ahead = F.slice(words, F.lit(1), F.greatest(n_words - 1, F.lit(0)))
    repeats = F.size(F.filter(F.zip_with(ahead, shifted, lambda a, b: a == b), lambda x: x))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    return {
        "chars": F.log1p(n),
        "words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "distinct": share(F.size(F.array_distinct(words)), n_words),
        "distinct_root": share(F.size(F.array_distinct(words)), F.sqrt(n_words)),
        "repeats": share(repeats, n_words),
        "upper": share(kept(r"[^\p{Lu}]+"), n),
        "letters": share(kept(r"[^\p{L}]+"), n),
        "digits": share(kept(r"[^0-9]+"), n),
        "symbols": share(kept(r"[^#$%&*@^~<>={}\[\]\\+_]+"), n),
        "bars": share(n - F.length(F.replace(t, F.lit("|"), F.lit(""))), n),
        "bangs": share(n - F.length(F.replace(t, F.lit("!"), F.lit(""))), n),
        "stops": share(n - F.length(F.replace(t, F.lit("."), F.lit(""))), n_words),
        "commas": share(n - F.length(F.replace(t, F.lit(","), F.lit(""))), n_words),
        "lines": share(n - F.length(F.replace(t, F.lit("\n"), F.lit(""))), n_words),
    }


STATISTICS = (
    "chars", "words", "word_length", "distinct", "distinct_root", "repeats", "upper", "letters",
    "digits", "symbols", "bars", "bangs", "stops", "commas", "lines",
)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and the intercept; a rule is a conjunction of (statistic, operator, cut)."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a struct column ``stats``."""
    docs = without(docs, "stats", "score")
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col(text)).items()])
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], stats.alias("stats"))


def paths(tree: str) -> list[Rule]:
    """The rules of a tree printed by Spark: the path to every node below the root."""
    out: list[Rule] = []
    open_: list[tuple[int, tuple[str, str, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            open_ = [o for o in open_ if o[0] < depth]
            open_.append((depth, (STATISTICS[int(m[2])], m[3], float(m[4]))))
            out.append(tuple(c for _, c in open_))
    return out


def compiled(rule: Rule, stats: str = "stats") -> Column:
    """A rule as a Spark condition."""
    tests = [
        F.col(stats).getField(name) <= cut if op == "<=" else F.col(stats).getField(name) > cut
        for name, op, cut in rule
    ]
    return reduce(lambda a, b: a & b, tests)


def logit(model: Ensemble, stats: str = "stats") -> Column:
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        total = total + F.when(compiled(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def train(
    stats: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    label: str = "quality",
    per_class: int = 6000,
    trees: int = 24,
    depth: int = 3,
    penalty: float = 0.002,
    seed: int = 11,
    modulus: int = 4,
    remainder: int = 2,
) -> Ensemble:
    """Rules and weights from the statistics of at most ``per_class`` labelled documents of each
    class; the bound is on learning alone."""
    ids = labelled_ids(labels, label, per_class=per_class, modulus=modulus, remainder=remainder)
    rows = stored(
        stats.select(F.col(doc_id).alias("doc_id"), "stats").join(F.broadcast(ids), "doc_id").select("stats", F.col("label").cast("double").alias("label")).coalesce(4),
        "quality-sample",
    )
    counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else (1 - 1e-6 if 1 in counts else 1e-6)
        return Ensemble((), math.log(share / (1 - share)))
    vector = array_to_vector(F.array(*[F.col("stats").getField(s) for s in STATISTICS]))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64, minInstancesPerNode=5
    ).fit(rows.select("label", vector.alias("features")))
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    if not rules:
        share = counts[1] / (counts[0] + counts[1])
        return Ensemble((), math.log(share / (1 - share)))
    fired = array_to_vector(F.array(*[compiled(r).cast("double") for r in rules]))
    fitted = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    ).fit(rows.select("label", fired.alias("features")))
    weights = fitted.coefficients.toArray().tolist()
    kept = tuple((r, w) for r, w in zip(rules, weights, strict=True) if w)
    return Ensemble(kept, float(fitted.intercept))


def scored(stats: DataFrame, model: Ensemble) -> DataFrame:
    """``stats`` with ``score``, the probability of label 1 by the compiled rules."""
    return stats.withColumn("score", 1 / (1 + F.exp(-logit(model))))
