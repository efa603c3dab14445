"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample of distinct vectors; every vector is then put into a leaf of
every tree.  A query walks all trees with one priority queue, nearest splits first, until the leaves
it has reached should hold enough candidates; the candidates are ranked by their exact cosine.

Points are dealt into blocks by a hash, each once with its leaves, and a query goes to every block
with a bit per leaf that it has reached, so neither a vector per leaf nor a row per leaf is moved,
and no table that a walk makes longer is joined.

Equal vectors are one candidate that carries its smallest IDs, as many as a result may need, so a
vector that a third of the rows have is compared once and loses no neighbour.  Vectors that are
null, zero or hold null or non-finite components take no part, nor do rows without an ID or vectors
of another length than the most frequent one.  Ties go to the smaller ID, however many vectors of
one direction tie; rows that repeat an ID with the same vector are one.  A table without vectors
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import stored

#: Most points of a block and queries of a slice, which meet in one task.
BLOCK, SLICE = 1 << 15, 1 << 15
#: Blocks of a small table, as far as they have so many points; queries that walk in one task.
SPREAD, LEAST_BLOCK, WALKS = 12, 1 << 11, 1 << 8
#: Queries compared at once, a bit of a word each.
WORD = 64
#: More than the fast and the exact score of a pair can differ by, and pairs ranked at once.
MARGIN = 1e-9
PAIRS = 1 << 15


@dataclass(frozen=True)
class Forest:
    """``planes``, ``cuts`` and ``children`` of all inner nodes, ``roots`` of the trees; a child
    below 0 is leaf ``-child - 1``.  ``sizes``: rows that each leaf should hold."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: tuple[int, ...]
    sizes: np.ndarray


def grown(sample: np.ndarray, trees: int, leaf: int, weight: float, seed: int = 3) -> Forest:
    """Trees over unit vectors; a split lies halfway between two random members of its node."""
    rng = np.random.default_rng(seed)
    planes, cuts, children, sizes = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
                values = sample[rows] @ plane
                cut = float(np.median(values))
                right = values > cut
                if right.any() and not right.all():
                    at = len(planes)
                    norm = float(np.linalg.norm(plane)) or 1.0
                    planes.append(plane / norm)
                    cuts.append(cut / norm)
                    children.append([0, 0])
                    children[at] = [node(rows[~right]), node(rows[right])]
                    return at
        sizes.append(len(rows) * weight)
        return -len(sizes)

    roots = tuple(node(np.arange(len(sample))) for _ in range(trees))
    width = max(1, sample.shape[1])
    return Forest(
        np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, dtype=np.int64).reshape(-1, 2), roots, np.array(sizes)
    )


def leaves(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree."""
    out = np.empty((len(vectors), len(forest.roots)), dtype=np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(vectors), root, dtype=np.int64)
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                break
            own = at[inner]
            side = np.einsum("ij,ij->i", vectors[inner], forest.planes[own]) > forest.cuts[own]
            at[inner] = forest.children[own, side.astype(np.int64)]
        out[:, t] = -at - 1
    return out


def reached(forest: Forest, vector: np.ndarray, budget: float) -> list[int]:
    """Leaves of all trees in the order of one shared queue, until they should hold ``budget``
    candidates; the priority of a leaf is the least margin on its path."""
    values = forest.planes @ vector - forest.cuts if len(forest.planes) else np.empty(0)
    queue = [(-np.inf, root) for root in forest.roots]
    heapq.heapify(queue)
    found: list[int] = []
    held = 0.0
    while queue and held < budget:
        margin, at = heapq.heappop(queue)
        while at >= 0:
            value = values[at]
            near = int(value > 0)
            heapq.heappush(queue, (max(margin, abs(value)), int(forest.children[at, 1 - near])))
            at = int(forest.children[at, near])
        found.append(-at - 1)
        held += forest.sizes[-at - 1]
    return found


def usable(vectors: DataFrame, *, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    given = vectors.select(F.col(f"`{embedding}`")).schema[0].dataType
    single = isinstance(given, T.ArrayType) and given.elementType == T.FloatType()
    v = F.col(f"`{embedding}`").cast("array<float>" if single else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0)
    )
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).first()
    return rows.where(F.size("v") == (width["width"] if width else 0))


def matrix(rows) -> np.ndarray:
    return np.stack(rows).astype(np.float64) if len(rows) else np.empty((0, 0))


def unit(rows) -> np.ndarray:
    m = matrix(rows)
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, always summed in the same order.

    Vectors are scaled by a power of two first, which changes no bit of the result and keeps
    squares of very large and very small components within range.
    """
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) for v in (a, b))
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def drawn(points: DataFrame, sample: int) -> np.ndarray:
    """Unit vectors of the ``sample`` points with the smallest hashes, in the order of these.

    Where they end is found on hashes and IDs alone, so no task gets the vectors of all parts.
    """
    place = F.struct(F.xxhash64("point").alias("hash"), "point", F.xxhash64("v").alias("own"))
    last = points.select(place.alias("place")).orderBy("place").limit(sample).agg(F.max("place").alias("place")).first()["place"]
    if last is None:
        return unit([])
    end = F.struct(*[F.lit(last[c]).alias(c) for c in ("hash", "point", "own")])
    found = points.where(place <= end).select("point", "v", place["hash"].alias("hash"), place["own"].alias("own"))
    found = found.toArrow().to_pandas().sort_values(["hash", "point", "own"])
    return unit(found["v"].tolist()[:sample])


def flagged(found: list[int], number: int) -> bytes:
    """A bit for each of ``number`` leaves."""
    flags = np.zeros(number, dtype=bool)
    flags[found] = True
    return np.packbits(flags).tobytes()


def best(units: np.ndarray, own: np.ndarray, asked: np.ndarray, flags: list[bytes], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, queries): of at most ``WORD`` queries, the ``keep`` candidates of each with the
    largest products and all that come within ``MARGIN`` of them.  A candidate has one of its
    leaves (``own``, a row per tree) among those that the query has reached (``flags``)."""
    bits = np.zeros((WORD, 8 * len(flags[0])), dtype=np.uint8)
    bits[: len(flags)] = np.unpackbits(np.frombuffer(b"".join(flags), dtype=np.uint8).reshape(len(flags), -1), axis=1)
    words = np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)[:, 0]
    by = np.bitwise_or.reduce([words[held] for held in own])
    some = np.flatnonzero(by)
    if not len(some):
        return some, some
    score = (units if len(some) == len(units) else units[some]) @ asked.T
    # From 1 to 3 for a candidate, 0 for any other pair.
    score += 2.0
    score *= np.unpackbits(by[some].view(np.uint8).reshape(-1, 8), axis=1, count=len(flags))
    # The least of the largest in ``keep`` groups of points is no larger than the last to be kept.
    size = max(1, len(some) // max(1024, 8 * keep))
    whole = len(some) // size * size
    tops = np.concatenate([score[:whole].reshape(size, -1, len(flags)).max(axis=0), score[whole:]])
    at = max(0, len(tops) - keep)
    least = np.maximum(np.partition(tops, at, axis=0)[at] - MARGIN, 0.5)
    near, row = np.divmod(np.flatnonzero(score >= least), len(flags))
    return some[near], row


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    trees: int = 12,
    leaf: int = 100,
    sample: int = 20_000,
    share: float = 0.9,
    least: int = 2_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found.

    ``sample`` bounds what the trees are grown on, nothing else.  A query walks on until its leaves
    should hold ``share`` of the distinct vectors, counted once per tree, and ``least`` of them.
    """
    rows = stored(usable(vectors, vec_id=vec_id, embedding=embedding), "ann-rows")
    # Sorted by a number first, vectors are seldom compared.
    hashed = rows.distinct().withColumn("hash", F.xxhash64("v"))
    first = Window.partitionBy("hash", "v").orderBy("vec_id")
    points = stored(
        hashed.withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= k + 1)
        .withColumn("ids", F.collect_list("vec_id").over(first.rowsBetween(0, k)))
        .where(F.col("r") == 1)
        .select(F.col("vec_id").alias("point"), "ids", "v"),
        "ann-points",
    )
    asked = stored(
        hashed.where(is_query).withColumn("query", F.min("vec_id").over(Window.partitionBy("hash", "v"))).select("vec_id", "query", "v"),
        "ann-queries",
    )
    distinct = asked.where(F.col("vec_id") == F.col("query")).select("query", "v")
    total, queries = points.count(), distinct.count()
    seen = drawn(points, sample)
    forest = grown(seen, trees if total else 0, leaf, total / max(1, len(seen)))
    budget = max(float(least), share * total)
    blocks = max(1, -(-total // BLOCK), min(SPREAD, -(-total // LEAST_BLOCK)))
    slices = max(1, -(-queries // SLICE))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=list(leaves(forest, unit(batch["v"].tolist()))))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = [reached(forest, u, budget) for u in unit(batch["v"].tolist())]
                yield batch.assign(reached=[flagged(f, len(forest.sizes)) for f in found])

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("v"), F.lit(parts))

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))

    kind = rows.schema["v"].dataType.simpleString()
    members = points.select("point", "v").mapInPandas(placed, f"point bigint, v {kind}, leaves array<int>")
    members = members.withColumn("block", dealt(blocks)).withColumn("slice", every(slices))
    walks = distinct.repartition(max(1, -(-queries // WALKS))).mapInPandas(walked, f"query bigint, v {kind}, reached binary")
    walks = walks.withColumn("slice", dealt(slices)).withColumn("block", every(blocks))

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "point": [], "score": []})]
        if not len(left) or not len(right):
            return out[0]
        raw, ids = matrix(right["v"].tolist()), right["point"].to_numpy()
        units, own = unit(raw), np.stack(right["leaves"].tolist(), axis=1)
        for lo in range(0, len(left), WORD):
            some = left.iloc[lo : lo + WORD]
            asked_, names = matrix(some["v"].tolist()), some["query"].to_numpy()
            near, row = best(units, own, unit(asked_), some["reached"].tolist(), k + 1)
            for at in range(0, len(row), PAIRS):
                r, n = row[at : at + PAIRS], near[at : at + PAIRS]
                found = pd.DataFrame({"query": names[r], "point": ids[n], "score": cosine(asked_[r], raw[n])})
                found = found.sort_values(["query", "score", "point"], ascending=[True, False, True])
                out.append(found.groupby("query").head(k + 1))
        return pd.concat(out[1:] or out)

    tile, tiles = ("block", "slice"), blocks * slices
    parts = min(4 * tiles, max(256, tiles))  # few tiles share a part by chance
    sides = walks.repartition(parts, *tile).groupBy(*tile).cogroup(members.repartition(parts, *tile).groupBy(*tile))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    scores = (
        sides.applyInPandas(ranked, "query bigint, point bigint, score double")
        .distinct()
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k + 1)
    )
    everyone = asked.select(F.col("vec_id").alias("query_id"), "query")
    named = scores.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        everyone.join(named, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
