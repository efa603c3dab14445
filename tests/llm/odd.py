"""Documents with everything that may be odd about them."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("Score", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("hits", T.StringType()),
        T.StructField("pieces", T.StringType()),
    ]
)
BIG = 2**60 + 1
LONG = "the longest of all words " * 20_000


def odd_docs(spark, more=()):
    rows = [
        (1, "a plain text of a few words in one line", "en", "s0"),
        (1, "a plain text of a few words in one line", "en", "s0"),
        (2, None, "en", "s1"),
        (3, "", None, "s1"),
        (4, " \t\n ", "fr", None),
        (5, LONG, "en", "s2"),
        (None, "a plain text of a few words in one line", "en", "s2"),
        (6, "12 %% ++ 99 \u0000 ▁ \U0001f600", None, None),
        (BIG, "x", "de", "s3"),
        (7, None, None, None),
        *more,
    ]
    return spark.createDataFrame([(*r, BIG if r[0] == 1 else None, "c", "c", "c", "c") for r in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id bigint, {name} int")
