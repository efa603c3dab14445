"""Column expressions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_tenure_buckets_are_right_closed(spark):
    got = column(spark, [0, 3, 4, 12, 13, 72, 73, None], "int", E.tenure_bucket("v"))
    assert got == ["0-3", "0-3", "4-6", "7-12", "13-24", "49-72", None, None]


def test_charge_bands_are_left_closed(spark):
    got = column(spark, [0.0, 34.99, 35.0, 75.0, 95.0, -1.0], "double", E.charge_band("v"))
    assert got == ["<$35", "<$35", "$35-55", "$75-95", "$95+", None]


def test_score_bands_hold_their_lower_edge(spark):
    got = column(spark, [0.0, 0.25, 0.5, 0.75, 1.0], "double", E.score_band("v"))
    assert got == ["Low", "Moderate", "High", "Critical", "Critical"]


def test_grid_index_agrees_with_comparing_every_cut(spark):
    scores = [i / 1000 for i in range(1001)] + [i * 0.01 for i in range(101)]
    scores += [math.nextafter(i * 0.01, 0) for i in range(1, 101)]
    got = column(spark, scores, "double", E.grid_index("v"))
    want = [max(i for i in range(101) if i * 0.01 <= p) for p in scores]
    assert got == want


def test_reliability_bins_are_right_closed_and_the_first_holds_zero(spark):
    edges = E.reliability_edges()
    scores = [0.0, *edges[1:], *(math.nextafter(e, 2) for e in edges[1:-1])]
    got = column(spark, scores, "double", E.reliability_bin("v"))
    want = [sum(p > e for e in edges[1:-1]) for p in scores]
    assert got == want
    assert got[0] == 0 and got[10] == 9


def test_histogram_bin_keeps_one_in_the_last_bin(spark):
    assert column(spark, [0.0, 0.05, 0.9999, 1.0], "double", E.histogram_bin("v")) == [0, 1, 19, 19]


def test_clamp_is_half_an_observation(spark):
    assert column(spark, [0.0, 0.5, 1.0], "double", E.clamp("v", 50)) == [0.01, 0.5, 0.99]
    assert column(spark, [0.0], "double", E.clamp("v", 0)) == [0.49]


def test_wilson_interval(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k int, n int")
    low, high = E.wilson("k", "n")
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0][0] == 0.0 and got[0][1] == pytest.approx(0.2775327998628892)
    assert got[1][1] == 1.0 and got[1][0] == pytest.approx(0.7224672001371108)
    assert got[2] == (pytest.approx(0.23659309051256394), pytest.approx(0.7634069094874361))
    assert got[3] == (None, None)


def test_ratio_is_null_on_nothing(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "a int, b int")
    assert [r[0] for r in df.select(E.ratio("a", "b")).collect()] == [0.5, None, None]
    assert [r[0] for r in df.select(E.ratio_or_zero("a", "b")).collect()] == [0.5, 0.0, 0.0]


def test_two_sided_rule(spark):
    df = spark.createDataFrame([(0, 0), (20, 20), (19, 50), (50, 0)], "p int, n int")
    assert [r[0] for r in df.select(E.two_sided("p", "n")).collect()] == [True, True, False, False]


# What a spreadsheet would start a formula at, and what becomes of it.
DEFUSED = {
    "=1+1": "'=1+1",
    "+1": "'+1",
    "-1": "'-1",
    "@SUM(A1)": "'@SUM(A1)",
    "\tx": "'\tx",
    "\rx": "'\rx",
    "a-b": "a-b",
    "safe": "safe",
    "": "",
    "x;=1": "x;'=1",
    "x\n+1": "x\n'+1",
    'say "=1"': "say \"'=1\"",
    "=a;-b": "'=a;'-b",
    " =1": " =1",
    ";;=": ";;'=",
}


def test_formula_defusing(spark):
    got = column(spark, list(DEFUSED), "string", E.defuse("v"))
    assert got == list(DEFUSED.values())


def test_hash_shape(spark):
    good = "0123456789abcdef" * 4
    got = column(spark, [good, good.upper(), good[:-1], good + "0", None], "string", E.is_sha256("v"))
    assert got == [True, False, False, False, False]


def test_category_codes_round_trip(spark):
    words = ("b", "a", "c")
    code = E.category_code("v", words)
    assert column(spark, ["a", "b", "x", None], "string", code) == [1, 0, None, None]
    assert column(spark, ["a", "b", "x"], "string", E.category_of(code, words)) == ["a", "b", None]


def test_sentences_never_claim_a_cause(spark):
    df = spark.createDataFrame(
        [("tenure", "12", 0.0314), ("monthly", "70.5", -0.02), ("senior", "1", 0.1)],
        "feature string, value string, c double",
    )
    value = E.shown_value("feature", "value", months=["tenure"], money=["monthly"], flags=["senior"])
    got = [r[0] for r in df.select(E.sentence("feature", value, "c")).collect()]
    assert got[0].startswith("tenure (12 months) raises the estimated risk by 3.1 percentage points")
    assert got[1].startswith("monthly ($70.50) lowers the estimated risk by 2.0")
    assert got[2].startswith("senior (yes) raises")
    assert all("relative to an average customer" in s for s in got)


def test_quoting_is_bounded(spark):
    df = spark.createDataFrame([(["x" * 60, "b", "c", "d", "e", "f"], 9)], "v array<string>, d int")
    shown, more = E.quoted("v", "d")
    row = df.select(shown.alias("s"), more.alias("m")).first()
    assert row["s"][0] == "x" * 40 + "…" and len(row["s"]) == 5 and row["m"] == 4


def test_business_rejects_what_is_no_share():
    with pytest.raises(ValueError):
        fixed.Business(success_rate=1.2)
    with pytest.raises(ValueError):
        fixed.Business(offer_cost=-1)


def test_expressions_run_on_a_stream(spark, small, tmp_path):
    """Bands, flags and model-input columns are stateless, so a stream reads them unchanged."""
    schema = spark.read.parquet(f"{small}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(small)
    scored = stream.select(
        "o_orderkey", E.score_band(F.lit(0.3)).alias("band"), E.grid_index(F.lit(0.29)).alias("cut")
    )
    query = (
        scored.writeStream.format("memory").queryName("banded").outputMode("append")
        .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    rows = spark.table("banded")
    assert rows.count() == spark.read.parquet(f"{small}/orders.parquet").count()
    assert rows.select("band", "cut").distinct().collect() == [("Moderate", 29)]
