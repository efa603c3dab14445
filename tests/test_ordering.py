"""Ordering helpers on skewed input, against plain Python."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from scorebook.operators import book as B
from scorebook.operators import segments as S
from scorebook.operators.prefix import medians, positions, running_totals
from scorebook.operators.segments import breakdown_counts, dense, level_grid
from scorebook.operators.split import fingerprint, stratified_folds, stratified_split
from scorebook.operators.tables import named_rows


def skewed(spark, n=3000):
    """A third of all rows share one value, the rest are crowded into a narrow range."""
    rng = random.Random(5)
    rows = [
        (i, 0.5 if i % 3 == 0 else round(0.1 + rng.random() * 1e-3, 7), "hot" if i % 3 else "cold")
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id int, v double, k string")


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_on_skew(spark, descending):
    rows, df = skewed(spark)
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))
    got = {
        (r["k"], r["v"]): (r["upto"], r["all_upto"])
        for r in running_totals(counted, "v", {"upto": "m"}, keys=["k"], descending=descending).collect()
    }
    for (k, v), (upto, total) in got.items():
        mine = [x for _, x, key in rows if key == k]
        want = sum(x >= v for x in mine) if descending else sum(x <= v for x in mine)
        assert (upto, total) == (want, len(mine))


def test_running_totals_keep_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "k string, v double, m int")
    got = {(r["k"], r["v"]): r["t"] for r in running_totals(df, "v", {"t": "m"}, keys=["k"]).collect()}
    assert got == {(None, 1.0): 2, (None, 2.0): 5, ("a", 1.0): 5}


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [5], [2, 2, 2, 9], [1, 3, 3, 3, 100]])
def test_medians_are_exact(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "k string, v int")
    assert medians(df, "v", keys=["k"]).first()["median"] == statistics.median(values)


def test_positions_with_ties_and_keys(spark):
    rows, df = skewed(spark, 600)
    got = {r["id"]: r["position"] for r in positions(df, [F.col("v").desc(), F.col("id")], keys=["k"]).collect()}
    for key in ("hot", "cold"):
        order = sorted((r for r in rows if r[2] == key), key=lambda r: (-r[1], r[0]))
        assert [got[i] for i, _, _ in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("page", [1, 2, 24, 99])
def test_pages_clamp_and_agree_near_and_deep(spark, page):
    rows, df = skewed(spark, 600)
    c = B.Columns(id="id")
    got = B.page_of(df, sort="v", descending=True, page=page, page_size=25, c=c)
    at = min(page, 24)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[(at - 1) * 25 : at * 25]
    back = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["id"] for r in back] == [r[0] for r in want]
    assert {(r["page"], r["pages"], r["total"]) for r in back} == {(at, 24, 600)}


def test_split_is_stratified_reproducible_and_seeded(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000)], "id int, y int")

    def parts(seed, frame=df):
        return {
            r["id"]: r["partition_name"]
            for r in stratified_split(frame, id="id", label="y", seed=seed).collect()
        }

    one = parts(1)
    assert one == parts(1, df.repartition(7)) and one != parts(2)
    for label, n in ((1, 250), (0, 750)):
        mine = [p for i, p in one.items() if int(i % 4 == 0) == label]
        assert mine.count("test") == mine.count("validation") == round(0.2 * n)


def test_split_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 2) for i in range(50)], "id int, y int")
    assert stratified_split(df, id="id", label="y").count() == 50


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "id int, y int")
    sizes = stratified_folds(df, id="id", label="y", folds=5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in sizes} == {(1, 20), (0, 80)}


def test_fingerprints_tell_repeats_nulls_and_separators_apart(spark):
    def of(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return tuple(fingerprint(df, ["a", "b"]).first())

    different = [[("x", "x"), ("x", "x")], [("y", "y"), ("y", "y")], [("x", None)], [(None, "x")], [("x|y", "z")], [("x", "y|z")], [("", None)]]
    assert len({of(rows) for rows in different}) == len(different)
    assert of([("a", "b"), ("c", "d")]) == of([("c", "d"), ("a", "b")])


def test_an_undeclared_level_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (0, "b"), (1, "z")], "churn int, g string")
    found = breakdown_counts(df, ["g"], label="churn")
    assert {r["row"] for r in dense(found, level_grid(spark, {"g": ["a", "b", "z", "never"]})).collect()} == {"a", "b", "z", "never"}
    with pytest.raises(Exception, match="undeclared level z"):
        dense(found, level_grid(spark, {"g": ["a", "b"]})).collect()


def test_shared_parents_hold_every_pair_within_the_bound():
    rng = random.Random(8)
    for _ in range(40):
        sizes = {f"d{i}": rng.randint(1, 60) for i in range(rng.randint(1, 14))}
        most = rng.choice([100, 5_000, 100_000])
        parents = S.shared_parents(sizes, most)
        for a, b in itertools.combinations(sizes, 2):
            assert any(a in p and b in p for p in parents)
        assert all(math.prod(sizes[d] for d in p) <= most or len(p) <= 2 for p in parents)
        assert {d for p in parents for d in p} == set(sizes)
        if math.prod(sizes.values()) <= most:
            assert parents == [list(sizes)]


def test_breakdowns_are_the_same_through_any_parents(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, "x", "y"]), rng.randint(0, 4), rng.choice("pqr"), rng.randint(0, 1)) for _ in range(300)]
    df = named_rows(spark, "a string, b string, c int, d string, y int", rows)
    dims = ["a", "b", "c", "d"]
    whole = sorted(map(str, breakdown_counts(df, dims, label="y").collect()))
    sizes = {"a": 2, "b": 3, "c": 5, "d": 3}
    for most in (6, 16, 30, 1000):
        assert sorted(map(str, breakdown_counts(df, dims, label="y", sizes=sizes, most=most).collect())) == whole
    assert len(whole) == 1 + (2 + 3 + 5 + 3) + (6 + 10 + 6 + 15 + 9 + 15)
