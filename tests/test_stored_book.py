"""A stored book: the same rows in any session, joins that leave it where it lies."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scorebook.operators import book as B
from scorebook.sources import stored as T


@pytest.fixture()
def kept(spark, tmp_path):
    rows = spark.range(2000).select(
        (F.col("id") * 7 % 2000).alias("customer_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("seg`ment"),
        (F.col("id") / 2000).alias("score"), F.lit(None).cast("int").alias("none"),
    )
    return rows, T.store_book(rows.repartition(5), str(tmp_path / "book"), id="customer_id", buckets=4)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_come_back_and_a_second_book_is_refused(spark, kept):
    rows, book = kept
    again = T.read_book(spark, T.stored_book(spark, book.path))
    assert T.stored_book(spark, book.path) == book
    assert again.schema == rows.schema and again.exceptAll(rows).isEmpty() and again.count() == 2000
    with pytest.raises(AnalysisException):
        T.store_book(rows, book.path, id="customer_id")


def test_joins_by_id_move_the_other_side_only(spark, kept, tmp_path):
    rows, book = kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = T.read_book(spark, book)
        ids = spark.range(0, 3000, 3).select(F.col("id").alias("customer_id")).repartition(3)
        found = T.looked_up(stored, ids, id="customer_id")
        text = plan_of(found)
        assert text.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(customer_id") == 0
        assert found.where("found").count() == 667 and found.count() == 1000
        other = T.store_book(rows.select("customer_id", F.lit(1).alias("churn")), str(tmp_path / "outcomes"), id="customer_id", buckets=4)
        both = B.unlabelled_rows(stored.withColumn("partition_name", F.lit("train")), T.read_book(spark, other))
        assert "Exchange" not in plan_of(both).split("== Initial Plan ==")[0] and both.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeats_and_missing_ids(spark, kept):
    _, book = kept
    ids = spark.createDataFrame([(7,), (7,), (None,), (-1,)], "customer_id bigint")
    got = T.looked_up(T.read_book(spark, book), ids, id="customer_id").collect()
    assert sorted((r["customer_id"] or 0, r["found"], r["score"]) for r in got) == [(-1, False, None), (0, False, None), (7, True, 0.0005), (7, True, 0.0005)]


def test_an_empty_book(spark, tmp_path):
    empty = spark.createDataFrame([], "customer_id bigint, x string")
    book = T.store_book(empty, str(tmp_path / "none"), id="customer_id", buckets=2)
    assert T.read_book(spark, book).count() == 0
    assert T.looked_up(T.read_book(spark, book), spark.range(3).toDF("customer_id"), id="customer_id").where("found").count() == 0
