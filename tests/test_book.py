"""Outcomes of a book are shown only where they may be."""

import pytest

from scorebook.operators import book as B


@pytest.fixture(scope="module")
def tables(spark):
    book = spark.createDataFrame(
        [(1, "train", 0.2, 10), (2, "validation", 0.6, 20), (3, "test", 0.9, 30)],
        "customer_id int, partition_name string, score double, monthly_charges int",
    )
    return book, spark.createDataFrame([(1, 0), (2, 1)], "customer_id int, churn int")


def test_the_test_partition_cannot_be_asked_for(tables):
    with pytest.raises(ValueError):
        B.labelled(*tables, "test")


def test_a_shown_row_without_an_outcome_is_refused(tables):
    book, outcomes = tables
    assert B.labelled(book, outcomes, strict=True).count() == 2
    with pytest.raises(KeyError):
        B.labelled(book, outcomes.where("customer_id = 1"), strict=True)


def test_unknown_rows_never_read_as_a_class(tables):
    got = {r["customer_id"]: (r["outcome"], r["status"], r["at_risk"]) for r in B.with_outcomes(*tables).collect()}
    assert got == {1: ("stayed", "active", 2.0), 2: ("churned", "churned", None), 3: ("withheld", "unknown", None)}


def test_ids_and_filters_exclude_each_other():
    with pytest.raises(ValueError):
        B.BookFilter(ids=(1,), query="x")
    with pytest.raises(ValueError):
        B.BookFilter(tenure_min=5, tenure_max=4)
