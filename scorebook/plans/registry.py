"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.fixed import Z_95
from scorebook.plans import books

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

THRESHOLD = 0.2


def query(name: str, sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may read the named books as common tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = books.with_sql(sql, *tables) if tables else sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums and means of doubles depend on the order rows arrive in beyond about 1e-12; the
    queries publish them rounded, the operators do not."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def book(spark: SparkSession, folder: str) -> DataFrame:
    return books.with_buckets(books.book_orders(spark, folder))


def plain(spark: SparkSession, folder: str) -> DataFrame:
    """The book for queries that read no partition: the split is not computed."""
    return books.with_buckets(books.scored_orders(spark, folder))


def shown(spark: SparkSession, folder: str) -> DataFrame:
    """The book with ``flagged``, ``outcome``, ``status`` and ``at_risk``; test rows withheld."""
    hidden = F.col("partition_name") == "test"
    return (
        book(spark, folder)
        .withColumn("flagged", F.col("score") >= THRESHOLD)
        .withColumn(
            "outcome",
            F.when(hidden, "withheld").when(F.col("churn") == 1, "churned").otherwise("stayed"),
        )
        .withColumn(
            "status",
            F.when(hidden, "unknown").when(F.col("churn") == 1, "churned").otherwise("active"),
        )
        .withColumn(
            "at_risk", F.when(F.col("status") == "active", F.col("score") * F.col("monthly_charges"))
        )
    )


SHOWN = f"""shown AS (
SELECT *, score >= {THRESHOLD} AS flagged,
  CASE WHEN partition_name = 'test' THEN 'withheld' WHEN churn = 1 THEN 'churned' ELSE 'stayed' END AS outcome,
  CASE WHEN partition_name = 'test' THEN 'unknown' WHEN churn = 1 THEN 'churned' ELSE 'active' END AS status,
  CASE WHEN partition_name <> 'test' AND churn = 0 THEN score * monthly_charges END AS at_risk
FROM book)"""


def train(spark: SparkSession, folder: str) -> DataFrame:
    return book(spark, folder).where(F.col("partition_name") == "train")


def validation(spark: SparkSession, folder: str) -> DataFrame:
    return book(spark, folder).where(F.col("partition_name") == "validation")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return books.book_lines(spark, folder)


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return books.book_docs(spark, folder)


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def wilson_sql(k: str, n: str, side: str) -> str:
    z = f"{Z_95!r}e0"
    kd, nd = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    share = f"({kd} / {nd})"
    spread = f"{z} * sqrt({share} * (1 - {share}) / {nd} + {z} * {z} / (4 * {nd} * {nd}))"
    centre = f"{share} + {z} * {z} / (2 * {nd})"
    scale = f"(1 + {z} * {z} / {nd})"
    if side == "low":
        return f"CASE WHEN {n} > 0 THEN CASE WHEN {k} = 0 THEN 0.0e0 ELSE round(({centre} - {spread}) / {scale}, 9) END END"
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {k} = {n} THEN 1.0e0 ELSE round(({centre} + {spread}) / {scale}, 9) END END"


def money_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(20,4))) AS DOUBLE)"


def keeps_sql(p: str, n: str) -> str:
    return f"((({p}) = 0 AND ({n}) = 0) OR (({p}) >= 20 AND ({n}) >= 20))"
