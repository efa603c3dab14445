"""Statistics, ranking metrics and threshold economics against plain Python on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorebook.functions.fixed import Business
from scorebook.operators import economics as X
from scorebook.operators import quality as Q
from scorebook.operators import segments as S
from scorebook.operators.split import fingerprint, row_hash
from scorebook.operators.tables import named_rows


def rows_of(n=400, seed=0, grid=50):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.randrange(grid + 1) / grid
        out.append((i, int(rng.random() < 0.2 + 0.5 * p), p, round(20 + 80 * rng.random(), 2), rng.choice("abc")))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_of()
    return rows, spark.createDataFrame(rows, "id int, y int, p double, m double, g string").repartition(5)


def auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total, last, out = sum(y for y, _ in pairs), 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        hit = [y for y, p in pairs if p >= t]
        recall = sum(hit) / total
        out += (recall - last) * sum(hit) / len(hit)
        last = recall
    return out


def test_ranking_metrics_count_ties_at_half(data):
    rows, df = data
    pairs = [(r[1], r[2]) for r in rows]
    got = Q.ranking_metrics(df, score="p", label="y").first()
    assert got["roc_auc"] == pytest.approx(auc(pairs), abs=1e-12)
    assert got["average_precision"] == pytest.approx(average_precision(pairs), abs=1e-12)


def test_ranking_metrics_per_group_and_for_one_class(spark, data):
    rows, df = data
    one = df.withColumn("y", F.when(F.col("g") == "c", 1).otherwise(F.col("y")))
    got = {r["g"]: r["roc_auc"] for r in Q.ranking_metrics(one, score="p", label="y", keys=["g"]).collect()}
    assert got["c"] is None
    for g in "ab":
        assert got[g] == pytest.approx(auc([(r[1], r[2]) for r in rows if r[4] == g]), abs=1e-12)


def test_a_constant_score_ranks_like_chance(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(20)], "y int, p double")
    got = Q.ranking_metrics(df, score="p", label="y").first()
    assert (got["roc_auc"], got["average_precision"]) == (0.5, 0.5)


def test_evaluate_defines_precision_as_zero_when_nothing_is_flagged(data):
    rows, df = data
    got = Q.evaluate(df.withColumn("p", F.col("p") / 2), score="p", label="y", threshold=0.9).first()
    assert (got["tp"], got["fp"], got["precision"], got["f1"]) == (0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        Q.evaluate(df, score="p", label="y", threshold=1.5)


def test_score_gate(spark):
    def gate(*scores):
        df = spark.createDataFrame([(i % 2, p) for i, p in enumerate(scores)], "y int, p double")
        return Q.score_gate(df, score="p", label="y").first()["valid"]

    assert gate(0.1, 0.9)
    assert not gate(0.1, 1.1) and not gate(0.1, float("nan")) and not gate(0.1, None)
    assert not gate(0.1)


def test_cramers_v_of_known_tables(spark):
    # Perfect association of two balanced two-level columns, and a constant one.
    df = spark.createDataFrame([("a", "x"), ("b", "y")] * 50, "u string, v string")
    assert Q.cramers_v(df, "u", "v").first()[0] == pytest.approx(1.0)
    constant = df.withColumn("v", F.lit("x"))
    assert Q.cramers_v(constant, "u", "v").first()[0] == 0.0


def test_ranking_agrees_with_single_statistics(data):
    rows, df = data
    got = {r["feature"]: r["strength"] for r in Q.association_ranking(df, categories=["g"], numbers=["p", "m"], label="y").collect()}
    assert got["g"] == pytest.approx(Q.cramers_v(df, "g", "y").first()[0], abs=1e-12)
    n = len(rows)
    mx, my = sum(r[2] for r in rows) / n, sum(r[1] for r in rows) / n
    cov = sum((r[2] - mx) * (r[1] - my) for r in rows)
    r = cov / math.sqrt(sum((q[2] - mx) ** 2 for q in rows) * sum((q[1] - my) ** 2 for q in rows))
    assert got["p"] == pytest.approx(abs(r))


def test_point_biserial_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (1.0, 1)], "x double, y int")
    assert Q.point_biserial(df, "x", "y").first()[0] == 0.0


# --- economics ------------------------------------------------------------------------------------------


def brute_sweep(rows, b: Business):
    out = []
    for i in range(101):
        t = i * 0.01
        flagged = [r for r in rows if r[2] >= t]
        tp = [r for r in flagged if r[1]]
        value = sum(r[3] for r in tp) * b.horizon_months * b.margin * b.success_rate
        out.append((t, len(flagged), len(tp), value - len(flagged) * b.offer_cost))
    return out


def test_sweep_equals_comparing_every_row_with_every_cut(data):
    rows, df = data
    got = X.sweep(df, Business(), score="p", label="y", amount="m").orderBy("threshold").collect()
    want = brute_sweep(rows, Business())
    assert [(r["threshold"], r["flagged"], r["true_positives"]) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want, strict=True):
        assert r["net_benefit"] == pytest.approx(w[3], abs=1e-6)


def test_flags_and_recall_fall_along_the_sweep(data):
    _, df = data
    got = X.sweep(df, score="p", label="y", amount="m").orderBy("threshold").collect()
    assert all(a["flagged"] >= b["flagged"] and a["recall"] >= b["recall"] for a, b in zip(got, got[1:]))


def constructed(spark):
    """Five cuts with the peak at 0.30 and the band {0.30, 0.36} under a $50 offer."""
    rows = [(0.0, 90.0, 100), (0.30, 1000.0, 60), (0.36, 968.0, 50), (0.50, 900.0, 30), (1.0, 0.0, 0)]
    return named_rows(spark, "threshold double, net_benefit double, flagged bigint", rows)


def test_recommendation_is_the_highest_cut_within_one_offer(spark):
    sweep = constructed(spark)
    assert X.recommended(sweep).first()["threshold"] == 0.36
    assert X.peak(sweep).first()["threshold"] == 0.30
    band = X.indifference_band(sweep).agg(F.sort_array(F.collect_list("threshold"))).first()[0]
    assert band == [0.30, 0.36]
    assert X.recommended(sweep, Business(offer_cost=10.0)).first()["threshold"] == 0.30


def test_nearest_cut_takes_the_first_on_ties(spark):
    sweep = named_rows(spark, "threshold double, net_benefit double", [(0.25, 1.0), (0.5, 2.0)])
    assert X.scenario_at(sweep, 0.375).first()["threshold"] == 0.25
    assert X.scenario_at(sweep, 0.376).first()["threshold"] == 0.5


def test_cuts_must_rise_and_exist(data):
    _, df = data
    basis = X.sweep_basis(df, score="p", label="y", amount="m")
    with pytest.raises(ValueError):
        X.at_cuts(basis, [0.3, 0.2])
    assert X.at_cuts(basis, [0.0, 0.29, 0.57]).count() == 3
    assert [r[0] for r in X.missing_cuts(basis, [0.1, 0.123]).collect()] == [0.123]


def test_leader_gap_needs_one_row_each(spark):
    df = spark.createDataFrame([("a", 0.7, False), ("b", 0.6, True)], "model string, cv_pr_auc double, selected boolean")
    assert X.leader_gap(df, "a").first()[0] == pytest.approx(0.1)
    assert X.leader_gap(df.unionByName(df), "a").first()[0] is None


def test_a_missing_level_is_a_segment(spark):
    rows = [(i, i % 2, (i % 10) / 10, None if i < 40 else "a") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, p double, g string")
    got = {r["segment"]: r for r in Q.segment_performance(df, ["g"], score="p", label="y", threshold=0.5).collect()}
    assert len(got) == 2 and sorted(r["customers"] for r in got.values()) == [40, 60]
    assert all(r["roc_auc"] is not None for r in got.values())


@pytest.mark.parametrize("bad", [float("nan"), 2.0, -0.1, None])
def test_scores_that_cannot_be_measured_are_named(spark, bad):
    df = spark.createDataFrame([(0, 0.2), (1, 0.8), (1, bad)], "y int, p double")
    with pytest.raises(Exception, match="p cannot be measured"):
        Q.evaluate(df, score="p", label="y").collect()


def test_two_lookups_at_one_threshold_are_two_rows(spark, data):
    _, df = data
    sweep = X.sweep(df, score="p", label="y", amount="m")
    looked = named_rows(spark, "name string, at double", [("a", 0.2), ("b", 0.2), ("c", 0.55)])
    got = sorted((r["name"], round(r["threshold"], 2)) for r in X.nearest_cuts(looked, sweep).collect())
    assert got == [("a", 0.2), ("b", 0.2), ("c", 0.55)]


def test_intervals_between_a_hundred_cuts_are_found_by_compiled_code(spark):
    cuts = [i * 0.01 for i in range(0, 100)]
    scores = [-0.0, 0.0, 0.005, 0.01, 0.29, 0.5, 0.985, 0.99, 1.0, None]
    df = spark.createDataFrame([(p, i % 2) for i, p in enumerate(scores)], "p double, y int")
    table = Q.reliability_on(df, score="p", label="y", cuts=cuts)
    got = {r["low"]: (r["customers"], r["churned"]) for r in table.collect()}
    want = {c: [0, 0] for c in cuts}
    for i, p in enumerate(scores):
        if p is not None:
            low = max(c for c in cuts if p >= c)
            want[low] = [want[low][0] + 1, want[low][1] + i % 2]
    assert got == {c: tuple(v) for c, v in want.items()}
    # HotSpot compiles no method of 8,000 bytes or more; it interprets it for every row.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = Q.reliability_on(df, score="p", label="y", cuts=cuts)
        text = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000


def test_identical_segments_hash_each_row_once(spark):
    rows = [(i, "ab"[i % 2], "xy"[i % 2] if i % 7 else None, "pq"[i // 10 % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    twin = df.withColumn("b2", F.col("a"))
    got = {(r["dimension"], r["segment"]): r for r in S.identical_segments(twin, ["a", "b", "b2", "c"], id="id").collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("b2", "a"), ("b2", "b")}
    for level in "ab":
        own = fingerprint(df.where(F.col("a") == level), ["id"]).first()
        whole = df.where(F.col("a") == level).select(row_hash(["id"]).alias("h")).agg(F.sum(F.col("h").cast("decimal(20,0)")).cast("string")).first()[0]
        assert own["checksum"] == whole
        for d in ("a", "b2"):
            r = got[d, level]
            assert (r["customers"], r["members"], r["checksum"]) == (30, own["fingerprint"], whole)
    plan = S.identical_segments(twin, ["a", "b", "b2", "c"], id="id")._jdf.queryExecution().optimizedPlan().toString()
    # Rows are counted below the step that makes one of every dimension.
    assert "Aggregate" in plan[plan.index("Expand"):]
