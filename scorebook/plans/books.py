"""The three scored books built from the shared tables, as DataFrames and as SQL.

``book_orders`` - one row per customer, scored by how long ago they last ordered.
``book_docs`` - labelled documents.  ``book_lines`` - order lines, with many tied scores.
Each DataFrame reads only the columns it needs and each table once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.operators.split import stratified_split

CUTOFF = "2000-08-01 00:00:00"

# Amount bands of this data: a mean order value, in whole units.
AMOUNT_EDGES = (0.0, 120000.0, 180000.0, 240000.0, 300000.0, 1e12)
AMOUNT_LABELS = ("<120k", "120k-180k", "180k-240k", "240k-300k", "300k+")
TENURE_EDGES = (-1, 12, 24, 36, 48, 60, 1200)
TENURE_LABELS = ("0-12", "13-24", "25-36", "37-48", "49-60", "61+")

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
YES_NO = ("No", "Yes")

# Dimensions of the order book and their levels in display order.
DIMENSIONS = {
    "segment": SEGMENTS,
    "region": REGIONS,
    "in_debit": YES_NO,
    "tenure_bucket": TENURE_LABELS,
    "amount_band": AMOUNT_LABELS,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The order book without its split: what a query that reads no partition needs."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    cutoff = F.to_timestamp(F.lit(CUTOFF))
    before = F.col("o_orderdate") < cutoff
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    # One pass over the orders gives both the features and the label.
    history = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("orders"),
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
        F.max(F.when(before, F.col("o_orderdate"))).alias("last_order"),
        F.sum(F.when(before, cents)).alias("cents"),
        F.coalesce(F.bool_or(~before), F.lit(False)).alias("came_back"),
    )
    joined = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    orders_n = F.coalesce("orders", F.lit(0)).cast("bigint")
    cents_n = F.coalesce("cents", F.lit(0)).cast("bigint")
    idle = F.coalesce(5 * F.datediff(cutoff, F.col("last_order")), F.lit(5 * 2000))
    return joined.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("in_debit"),
        orders_n.alias("orders"),
        F.coalesce(
            F.floor(F.datediff("last_order", "first_order") / 30.0).cast("int"), F.lit(0)
        ).alias("tenure"),
        (cents_n.cast("double") / 100).alias("total_charges"),
        F.floor(cents_n / (100 * F.greatest(orders_n, F.lit(1)))).cast("int").alias("monthly_charges"),
        (F.least(F.greatest(idle, F.lit(5)), F.lit(9995)).cast("double") / 10000).alias("score"),
        F.when(F.coalesce("came_back", F.lit(False)), 0).otherwise(1).alias("churn"),
    )


def book_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The order book with its partition."""
    return stratified_split(
        scored_orders(spark, folder), id="customer_id", label="churn", seed=42
    )


def with_buckets(book: DataFrame) -> DataFrame:
    """The order book with its tenure bucket, amount band, score band and flag column."""
    return book.withColumns(
        {
            "tenure_bucket": E.tenure_bucket("tenure", TENURE_EDGES, TENURE_LABELS),
            "amount_band": E.charge_band("monthly_charges", AMOUNT_EDGES, AMOUNT_LABELS),
            "risk_band": E.score_band("score"),
        }
    )


def book_docs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    size = E.bucket("n_chars", (-1, 1000, 2000, 4000, 10**12), ("<1k", "1k-2k", "2k-4k", "4k+"), right=False)
    score = F.least(F.greatest(F.col("n_chars"), F.lit(5)), F.lit(9995)).cast("double") / 10000
    return documents.join(labels, "doc_id").select(
        "doc_id", "lang", "source", size.alias("size_band"), "n_chars", "quality", "toxic",
        score.alias("score"),
    )


def book_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    units = (
        500 * F.round(F.col("l_discount") * 100).cast("int") + 98 * F.col("l_quantity").cast("int") + 50
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        F.year("l_shipdate").alias("ship_year"),
        F.when(F.col("l_quantity") <= 10, "1-10")
        .when(F.col("l_quantity") <= 25, "11-25")
        .otherwise("26-50")
        .alias("quantity_band"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
        (units.cast("double") / 10000).alias("score"),
    )


# --- the same books as SQL ---------------------------------------------------------------

ORDERS_SQL = f"""
SELECT customer_id, segment, region, nation, in_debit, orders, tenure, total_charges,
  monthly_charges, score, churn,
  CASE WHEN rn <= floor(0.2 * nc + 0.5) THEN 'test'
       WHEN rn <= 2 * floor(0.2 * nc + 0.5) THEN 'validation' ELSE 'train' END AS partition_name
FROM (
  SELECT b.*, row_number() OVER (PARTITION BY churn
           ORDER BY md5(concat(CAST(customer_id AS VARCHAR), ':42')), customer_id) AS rn,
         count(*) OVER (PARTITION BY churn) AS nc
  FROM (
    SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment, r.r_name AS region,
      n.n_name AS nation, CASE WHEN c.c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS in_debit,
      coalesce(pre.orders, 0) AS orders,
      coalesce(CAST(floor(date_diff('day', pre.first_order, pre.last_order) / 30.0) AS INT), 0) AS tenure,
      CAST(coalesce(pre.cents, 0) AS DOUBLE) / 100 AS total_charges,
      CAST(floor(coalesce(pre.cents, 0) / (100 * coalesce(pre.orders, 1))) AS INT) AS monthly_charges,
      CAST(least(greatest(5 * coalesce(date_diff('day', pre.last_order, TIMESTAMP '{CUTOFF}'), 2000), 5), 9995)
        AS DOUBLE) / 10000 AS score,
      CASE WHEN post.o_custkey IS NULL THEN 1 ELSE 0 END AS churn
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN (
      SELECT o_custkey, count(*) AS orders, min(o_orderdate) AS first_order,
        max(o_orderdate) AS last_order,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' GROUP BY o_custkey) pre
      ON pre.o_custkey = c.c_custkey
    LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}') post
      ON post.o_custkey = c.c_custkey) b)
"""


def case_sql(column: str, edges, labels, *, right: bool) -> str:
    low_op, high_op = (">", "<=") if right else (">=", "<")
    arms = " ".join(
        f"WHEN {column} {low_op} {low!r} AND {column} {high_op} {high!r} THEN '{label}'"
        for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True)
    )
    return f"CASE {arms} END"


BANDS_SQL = (
    "CASE WHEN score < 0.25 THEN 'Low' WHEN score < 0.5 THEN 'Moderate' "
    "WHEN score < 0.75 THEN 'High' ELSE 'Critical' END"
)

BUCKETED_SQL = f"""
SELECT *, {case_sql('tenure', TENURE_EDGES, TENURE_LABELS, right=True)} AS tenure_bucket,
  {case_sql('monthly_charges', AMOUNT_EDGES, AMOUNT_LABELS, right=False)} AS amount_band,
  {BANDS_SQL} AS risk_band
FROM ({ORDERS_SQL})
"""

DOCS_SQL = """
SELECT d.doc_id, d.lang, d.source,
  CASE WHEN d.n_chars < 1000 THEN '<1k' WHEN d.n_chars < 2000 THEN '1k-2k'
       WHEN d.n_chars < 4000 THEN '2k-4k' ELSE '4k+' END AS size_band,
  d.n_chars, l.quality, l.toxic,
  CAST(least(greatest(d.n_chars, 5), 9995) AS DOUBLE) / 10000 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

LINES_SQL = """
SELECT l_orderkey, l_linenumber, l_linestatus, CAST(year(l_shipdate) AS INT) AS ship_year,
  CASE WHEN l_quantity <= 10 THEN '1-10' WHEN l_quantity <= 25 THEN '11-25' ELSE '26-50' END AS quantity_band,
  l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
  CAST(500 * CAST(round(l_discount * 100) AS INT) + 98 * CAST(l_quantity AS INT) + 50 AS DOUBLE) / 10000 AS score
FROM lineitem
"""


def with_sql(body: str, *books: str) -> str:
    """``body`` with the named books (``book``, ``docs``, ``lines``) as common tables."""
    source = {"book": BUCKETED_SQL, "docs": DOCS_SQL, "lines": LINES_SQL}
    heads = ", ".join(f"{name} AS ({source[name]})" for name in books)
    joined = body.strip()
    if joined[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {joined[15:]}"
    if joined[:5].upper() == "WITH ":
        return f"WITH {heads}, {joined[5:]}"
    return f"WITH {heads} {joined}"
