"""Recall and scores against brute force, equal vectors, vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from scorebook.llm import ann_forest as A
from scorebook.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(ids, vectors, queries, k=5):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = np.round(v @ v[ids.index(q)], 12)
        order = sorted((-score[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def test_shared_queue_reaches_every_leaf_in_order():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    forest = A.grown(points, 3, 20, 1.0)
    found = A.reached(forest, points[0], 1e9)
    assert sorted(found) == list(range(len(forest.sizes)))
    own = A.leaves(forest, points[:1])[0]
    assert set(found[:3]) == set(own.tolist())
    assert len(A.reached(forest, points[0], 1.0)) == 1


def test_query_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids = table["vec_id"].tolist()
    want = brute(ids, np.stack(table["embedding"].tolist()).astype(float), [i for i in ids if i % 50 == 0])
    got = {}
    for r in QUERIES["op2_projection_forest"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(brute(ids, np.stack(table["embedding"].tolist()).astype(float), [q], len(ids))[q]) for q in list(want)[:5]}
    assert all(abs(exact[q][i] - s) < 1e-9 for q in exact for i, s in got[q])


def test_equal_vectors_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300)] + [(1000 + i, [1.0, i / 10 + 0.1, 0.0]) for i in range(10)]
    rows += [(50, [1.0, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [nan, 1.0, 1.0]), (2003, [inf, 1.0, 1.0]), (2004, [None, 1.0, 1.0]), (2005, [1.0]), (2006, [])]
    got = {}
    for r in A.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 200, 250, 1000}
    assert [v for _, v, _ in sorted(got[50])] == [0, 1, 2, 3, 4] and [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 4, 5]
    assert [v for _, v, _ in sorted(got[1000])] == [0, 1, 2, 3, 4] or sorted(got[1000])[0][1] == 1001
    assert A.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    few = A.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in few] == [(0, 1, 1, 0.8)]


def test_many_parallel_vectors_and_extreme_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)]
    # Sixty vectors of one direction, exactly: powers of two, far beyond what squares can hold.
    rows += [(900 + i, [x * 2.0 ** (20 * i - 600) for x in (3.0, 1.0, 2.0, 5.0)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for r in A.nearest(table, F.col("vec_id").isin(900, 933, 7)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [v for _, v, _ in sorted(got[933])] == [900, 901, 902, 903, 904]
    assert [v for _, v, _ in sorted(got[900])] == [901, 902, 903, 904, 905]
    assert all(abs(s - 1) < 1e-12 for q in (900, 933) for _, _, s in got[q])
    assert len(got[7]) == 5


def below_broadcasts(table) -> str:
    """The operators that a plan sends to the driver and every executor."""
    lines = table._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [line.find("+- ") for line in lines]
    found = []
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
            found += lines[at + 1 : end]
    return "\n".join(found)


def test_no_walk_is_broadcast(spark):
    # Spark takes a walk for as large as the queries it starts from, and it is hundreds of rows each.
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], SCHEMA)
    found = A.nearest(table, F.col("vec_id") % 50 == 0)
    assert "Broadcast" in found._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in below_broadcasts(found)


def test_blocks_and_slices_give_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 100)
    monkeypatch.setattr(A, "SLICE", 40)
    monkeypatch.setattr(A, "WALKS", 16)
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(430, 8)), 3)
    vectors[::9, 2] = 0.0
    vectors[200:230] = vectors[9]
    vectors[210, 2] = -0.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows + rows[:50], "vec_id bigint, embedding array<double>").repartition(3)
    got = {}
    for r in A.nearest(table, F.col("vec_id") % 5 == 0, least=10**9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = range(0, 430, 5)
    want = brute(list(range(430)), vectors, queries)
    assert {q: [i for _, i, _ in got[q]] for q in got} == {q: [i for i, _ in want[q]] for q in queries}
    assert all(abs(a[2] - b[1]) < 1e-9 for q in queries for a, b in zip(got[q], want[q], strict=True))
    assert all([rank for rank, _, _ in got[q]] == [1, 2, 3, 4, 5] for q in queries)


def test_best_keeps_only_candidates_and_all_ties():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(5000, 6))
    points[100:120] = points[7]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    forest = A.grown(points, 3, 50, 1.0)
    own, asked = A.leaves(forest, points).T, points[5:45]
    walks = [A.reached(forest, q, 900.0) for q in asked]
    near, row = A.best(points, own, asked, [A.flagged(w, len(forest.sizes)) for w in walks], 6)
    for j, walk in enumerate(walks):
        candidate = np.isin(own, walk).any(axis=0)
        assert not candidate.all()
        score = np.where(candidate, points @ asked[j], -2.0)
        found = set(near[row == j].tolist())
        assert set(np.flatnonzero(score >= np.sort(score)[-6] - 1e-12).tolist()) <= found
        assert candidate[list(found)].all()
    few = A.best(points[:4], own[:, :4], asked[:1], [A.flagged([int(own[0, 2])], len(forest.sizes))], 6)
    assert set(few[0].tolist()) == set(np.flatnonzero(own[0, :4] == own[0, 2]).tolist())


def test_sample_is_bounded_where_many_vectors_have_one_id(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 4))
    points = spark.createDataFrame([(7 if i < 200 else i, v.tolist()) for i, v in enumerate(vectors)], "point bigint, v array<double>")
    seen = A.drawn(points, 150)
    assert seen.shape == (150, 4) and (seen == A.drawn(points.repartition(5), 150)).all()
    assert A.drawn(points, 1000).shape == (300, 4) and len(A.drawn(points.where("false"), 10)) == 0
