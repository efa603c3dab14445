"""Rules are read from trees as printed, compiled as they read, and right on held-out rows."""

from pyspark.sql import functions as F

import odd
from scorebook.llm import quality_rules as Q
from scorebook.llm.queries import QUERIES


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=15
  If (feature 0 <= 1.5)
   Predict: 0.0
  Else (feature 0 > 1.5)
   If (feature 5 <= 0.25)
    Predict: 1.0
   Else (feature 5 > 0.25)
    Predict: 0.0
"""
    a, b = ("chars", "<=", 1.5), ("chars", ">", 1.5)
    assert Q.paths(tree) == [(a,), (b,), (b, ("repeats", "<=", 0.25)), (b, ("repeats", ">", 0.25))]


def test_compiled_rules_equal_plain_evaluation(spark):
    docs = odd.odd_docs(spark)
    rules = ((("chars", ">", 2.0), ("repeats", "<=", 0.1)), 1.5), ((("digits", ">", 0.0),), -2.0)
    rows = Q.scored(Q.with_statistics(docs), Q.Ensemble(rules, 0.25)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        s = r["stats"].asDict()
        z = 0.25 + (1.5 if s["chars"] > 2 and s["repeats"] <= 0.1 else 0) - (2.0 if s["digits"] > 0 else 0)
        assert abs(r["score"] - 1 / (1 + 2.718281828459045**-z)) < 1e-12


def test_statistics_of_a_text(spark):
    row = spark.createDataFrame([("Go go go!! A|b\n12",)], "text string")
    s = row.select(F.struct(*[c.alias(k) for k, c in Q.statistics(F.col("text")).items()]).alias("s")).first()["s"]
    assert set(s.asDict()) == set(Q.STATISTICS)
    assert (s["repeats"], s["bangs"], s["bars"], s["digits"]) == (0.0, 2 / 17, 1 / 17, 2 / 17)
    assert s["upper"] == 2 / 17 and s["distinct"] == 1.0 and s["lines"] == 1 / 5


def test_without_labels_or_documents(spark):
    docs = odd.odd_docs(spark)
    stats = Q.with_statistics(docs)
    model = Q.train(stats, odd.labels(spark, [], "quality"))
    assert {r["score"] for r in Q.scored(stats, model).collect()} == {0.5}
    one = Q.train(stats, odd.labels(spark, [(1, 1), (4, 1), (5, 1), (6, 1)], "quality"))
    assert Q.scored(stats, one).filter("score < 0.9").count() == 0
    assert Q.scored(Q.with_statistics(odd.empty_docs(spark)), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_rule_ensemble_quality"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
