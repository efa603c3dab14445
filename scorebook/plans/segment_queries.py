"""Queries over segments: rates, cross-tabs, breakdowns, nesting, reconciliation."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.operators import segments as S
from scorebook.plans import books
from scorebook.session import durable
from scorebook.plans.registry import (
    SHOWN, book, plain, money_sql, query, ratio_sql, rounded, shown, train, wilson_sql,
)

RATE = ratio_sql("sum(churn)", "count(*)")
DIMS = books.DIMENSIONS


@query(
    "d1_rate_by_level",
    f"SELECT segment, count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned, {RATE} AS churn_rate "
    "FROM book GROUP BY segment",
    "book",
)
def rate_by_level(spark, folder):
    return S.rate_by(plain(spark, folder), "segment", label="churn", sort_by_rate=True)


@query(
    "d2_cross_tab",
    f"""SELECT nation, in_debit, count(*) AS customers,
  CASE WHEN count(*) >= 20 THEN CAST(sum(churn) AS BIGINT) END AS churned,
  CASE WHEN count(*) >= 20 THEN {RATE} END AS churn_rate
FROM book GROUP BY nation, in_debit""",
    "book",
)
def cross_tab(spark, folder):
    return S.cross_tab(plain(spark, folder), ["nation", "in_debit"], label="churn")


def matrix_sql() -> str:
    parts = []
    for level in DIMS["tenure_bucket"]:
        here = f"tenure_bucket = '{level}'"
        parts.append(f"count(*) FILTER ({here}) AS \"n {level}\"")
        parts.append(
            f"CASE WHEN count(*) FILTER ({here}) >= 20 THEN CAST(sum(churn) FILTER ({here}) AS DOUBLE) "
            f"/ count(*) FILTER ({here}) END AS \"rate {level}\""
        )
    return f"SELECT segment, {', '.join(parts)} FROM book GROUP BY segment"


@query("d3_rate_and_count_matrices", matrix_sql(), "book")
def rate_matrices(spark, folder):
    return S.rate_matrix(
        plain(spark, folder), "segment", "tenure_bucket", DIMS["tenure_bucket"], label="churn"
    )


def with_without_sql() -> str:
    arms = []
    for name, test in (("In debit", "in_debit = 'Yes'"), ("Long tenure", "tenure > 48")):
        arms.append(
            f"""SELECT '{name}' AS addon,
  CAST(sum(churn) FILTER ({test}) AS DOUBLE) / count(*) FILTER ({test}) AS with_addon,
  CAST(sum(churn) FILTER (NOT ({test})) AS DOUBLE) / count(*) FILTER (NOT ({test})) AS without_addon,
  count(*) FILTER ({test}) AS n_with, count(*) FILTER (NOT ({test})) AS n_without
FROM book WHERE orders > 0"""
        )
    return f"SELECT *, with_addon - without_addon AS difference FROM ({' UNION ALL '.join(arms)})"


@query("d4_with_without_rates", with_without_sql(), "book")
def with_without(spark, folder):
    buyers = (
        plain(spark, folder)
        .where("orders > 0")
        .withColumn("long_tenure", F.when(F.col("tenure") > 48, "Yes").otherwise("No"))
    )
    labels = {"in_debit": "In debit", "long_tenure": "Long tenure"}
    return S.with_without(buyers, ["in_debit", "long_tenure"], label="churn", labels=labels)


@query(
    "d5_median_by_outcome",
    "SELECT churn, CAST(median(monthly_charges) AS DOUBLE) AS median FROM book GROUP BY churn",
    "book",
)
def median_by_outcome(spark, folder):
    return S.median_by_outcome(plain(spark, folder), "monthly_charges", label="churn")


@query(
    "d6_overview",
    f"""SELECT count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned, {RATE} AS churn_rate,
  {money_sql('monthly_charges')} AS monthly_revenue,
  {money_sql('CASE WHEN churn = 1 THEN monthly_charges END')} AS monthly_revenue_at_risk,
  CAST(median(tenure) FILTER (churn = 1) AS DOUBLE) AS median_tenure_churned,
  CAST(median(tenure) FILTER (churn = 0) AS DOUBLE) AS median_tenure_retained,
  CAST(median(monthly_charges) FILTER (churn = 1) AS DOUBLE) AS median_charges_churned,
  CAST(median(monthly_charges) FILTER (churn = 0) AS DOUBLE) AS median_charges_retained,
  1 - {RATE} AS majority_class_accuracy
FROM book""",
    "book",
)
def overview(spark, folder):
    return S.overview(plain(spark, folder), label="churn", tenure="tenure", amount="monthly_charges")


BANDS_VALUES = ", ".join(f"('{n}', {lo!r}e0, {hi!r}e0)" for n, lo, hi in fixed.RISK_BANDS)


@query(
    "d7_band_summary",
    f"""WITH {SHOWN}, bands(name, min, max) AS (VALUES {BANDS_VALUES}),
s AS (SELECT risk_band AS name, count(*) AS customers, {money_sql('monthly_charges')} AS monthly_charges,
  count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND outcome <> 'churned') AS flagged_not_churned,
  count(*) FILTER (outcome <> 'withheld') AS seen, count(*) FILTER (outcome = 'churned') AS churned
  FROM shown GROUP BY risk_band),
f AS (SELECT b.*, coalesce(customers, 0) AS customers, coalesce(monthly_charges, 0.0e0) AS monthly_charges,
  coalesce(flagged, 0) AS flagged, coalesce(flagged_not_churned, 0) AS flagged_not_churned,
  coalesce(seen, 0) AS seen, coalesce(churned, 0) AS churned FROM bands b LEFT JOIN s USING (name))
SELECT name, min, max, customers, customers / CAST(sum(customers) OVER () AS DOUBLE) AS share, monthly_charges,
  round(monthly_charges / sum(monthly_charges) OVER (), 9) AS monthly_share, flagged, flagged_not_churned,
  seen AS observed_customers, CASE WHEN seen >= 20 THEN churned END AS observed_churned,
  CASE WHEN seen >= 20 THEN CAST(churned AS DOUBLE) / seen END AS observed_rate FROM f""",
    "book",
)
def band_summary(spark, folder):
    table = S.band_summaries(shown(spark, folder), score="score", amount="monthly_charges")
    return rounded(table, 9, "monthly_share")


@query(
    "d8_score_histogram",
    f"""WITH {SHOWN}, bins AS (SELECT CAST(range AS INT) AS bin FROM range(20)),
s AS (SELECT CAST(least(19, floor(score * 20)) AS INT) AS bin, count(*) AS customers,
  {money_sql('monthly_charges')} AS monthly_charges,
  count(*) FILTER (partition_name = 'validation') AS seen,
  count(*) FILTER (partition_name = 'validation' AND churn = 1) AS churned,
  avg(score) FILTER (partition_name = 'validation') AS mean FROM shown GROUP BY 1)
SELECT bin, bin / 20.0e0 AS low, (bin + 1) / 20.0e0 AS high,
  CASE WHEN bin < 5 THEN 'Low' WHEN bin < 10 THEN 'Moderate' WHEN bin < 15 THEN 'High' ELSE 'Critical' END AS band,
  coalesce(customers, 0) AS customers, coalesce(monthly_charges, 0.0e0) AS monthly_charges,
  coalesce(seen, 0) AS observed_customers, CASE WHEN seen >= 20 THEN churned END AS observed_churned,
  CASE WHEN seen >= 20 THEN CAST(churned AS DOUBLE) / seen END AS observed_rate,
  CASE WHEN seen >= 20 THEN round(mean, 9) END AS observed_mean FROM bins LEFT JOIN s USING (bin)""",
    "book",
)
def score_histogram(spark, folder):
    table = S.score_histogram(
        shown(spark, folder), score="score", amount="monthly_charges", partition="partition_name"
    )
    return rounded(table, 9, "observed_mean")


def share_sql(test: str) -> str:
    queue = f"({test}) AND flagged AND status"
    return f"""WITH {SHOWN}, s AS (SELECT count(*) AS n, count(*) FILTER ({test}) AS customers,
  coalesce({money_sql(f'CASE WHEN {test} THEN monthly_charges END')}, 0.0e0) AS monthly_charges,
  count(*) FILTER ({queue} = 'active') AS in_queue_active,
  count(*) FILTER ({queue} = 'unknown') AS in_queue_unknown,
  coalesce({money_sql(f"CASE WHEN {queue} = 'active' THEN monthly_charges END")}, 0.0e0) AS in_queue_monthly
  FROM shown)
SELECT customers, customers / CAST(n AS DOUBLE) AS share, monthly_charges,
  in_queue_active + in_queue_unknown AS in_queue, in_queue_active, in_queue_unknown,
  (in_queue_active + in_queue_unknown) / CAST(n AS DOUBLE) AS in_queue_share, in_queue_monthly FROM s"""


@query("d9_share_of_flagged", share_sql("flagged"), "book")
def share_of_flagged(spark, folder):
    return S.share_block(shown(spark, folder), F.col("flagged"), amount="monthly_charges")


@query("d9_share_of_high_bands", share_sql("risk_band IN ('High', 'Critical')"), "book")
def share_of_high_bands(spark, folder):
    high = F.col("risk_band").isin("High", "Critical")
    return S.share_block(shown(spark, folder), high, amount="monthly_charges")


@query(
    "d10_active_and_unknown_totals",
    f"""WITH {SHOWN} SELECT {money_sql("CASE WHEN status = 'active' THEN monthly_charges END")} AS current_monthly_charges,
  count(*) FILTER (status = 'unknown') AS unknown_customers,
  coalesce({money_sql("CASE WHEN status = 'unknown' THEN monthly_charges END")}, 0.0e0) AS unknown_monthly_charges
FROM shown""",
    "book",
)
def active_and_unknown(spark, folder):
    return S.status_totals(shown(spark, folder), amount="monthly_charges")


# --- all one- and two-way breakdowns --------------------------------------------------------------


def grid_sql(dims=DIMS) -> str:
    rows = [
        f"('{d}', NULL, '{x}', NULL, {i}, NULL)" for d, names in dims.items() for i, x in enumerate(names)
    ]
    rows += [
        f"('{a}', '{b}', '{x}', '{y}', {i}, {j})"
        for a, b in itertools.combinations(dims, 2)
        for i, x in enumerate(dims[a])
        for j, y in enumerate(dims[b])
    ]
    return f'grid("rows", cols, "row", col, row_pos, col_pos) AS (VALUES {", ".join(rows)})'


def counts_sql(where: str = "TRUE", dims=DIMS) -> str:
    arms = [
        f"SELECT '{d}' AS \"rows\", CAST(NULL AS VARCHAR) AS cols, {d} AS \"row\", CAST(NULL AS VARCHAR) AS col, "
        f"count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned FROM book WHERE {where} GROUP BY {d}"
        for d in dims
    ]
    arms += [
        f"SELECT '{a}', '{b}', {a}, {b}, count(*), CAST(sum(churn) AS BIGINT) FROM book WHERE {where} GROUP BY {a}, {b}"
        for a, b in itertools.combinations(dims, 2)
    ]
    return f"counts AS ({' UNION ALL '.join(arms)})"


def cells_sql(where: str = "TRUE") -> str:
    """Dense cells with the partition's totals."""
    return f"""{counts_sql(where)}, {grid_sql()},
total AS (SELECT count(*) AS pn, CAST(sum(churn) AS BIGINT) AS pc FROM book WHERE {where}),
cells AS (SELECT g.*, coalesce(k.customers, 0) AS customers, coalesce(k.churned, 0) AS churned,
    pn AS partition_customers, pc AS partition_churned
  FROM grid g LEFT JOIN counts k ON g."rows" = k."rows" AND g.cols IS NOT DISTINCT FROM k.cols
    AND g."row" = k."row" AND g.col IS NOT DISTINCT FROM k.col, total)"""


TRAIN = "partition_name = 'train'"


def breakdown_cells(df):
    # The counts are small and read twice: cells and total.
    found = durable(S.breakdown_counts(df, list(DIMS), label="churn"))
    dense = S.dense(found, S.level_grid(df.sparkSession, DIMS))
    return S.decorated(dense, S.total_of(found))


@query(
    "d11_all_breakdowns",
    f"""WITH {cells_sql(TRAIN)}
SELECT "rows", cols, "row", col, row_pos, col_pos, customers, churned, partition_customers, partition_churned,
  partition_churned / CAST(partition_customers AS DOUBLE) AS base_rate,
  {ratio_sql('churned', 'customers')} AS rate,
  {ratio_sql('churned', 'customers')} / (partition_churned / CAST(partition_customers AS DOUBLE)) AS lift,
  {wilson_sql('churned', 'customers', 'low')} AS low, {wilson_sql('churned', 'customers', 'high')} AS high FROM cells""",
    "book",
)
def all_breakdowns(spark, folder):
    return rounded(breakdown_cells(train(spark, folder)), 9, "low", "high")


# Fourteen dimensions of a line: name, levels at most, as Spark and as SQL.
FOURTEEN = (
    ("l_returnflag", 3, "l_returnflag", None),
    ("l_linestatus", 2, "l_linestatus", None),
    ("l_linenumber", 7, "l_linenumber", None),
    ("quantity_band", 5, "cast(floor((l_quantity - 1) / 10) as int)", None),
    ("discount", 11, "cast(round(l_discount * 100) as int)", None),
    ("tax", 9, "cast(round(l_tax * 100) as int)", None),
    ("ship_year", 8, "year(l_shipdate)", None),
    ("ship_quarter", 4, "quarter(l_shipdate)", None),
    ("ship_month", 12, "month(l_shipdate)", None),
    ("ship_day", 31, "day(l_shipdate)", None),
    ("weekday", 7, "weekday(l_shipdate)", "(dayofweek(l_shipdate) + 6) % 7"),
    ("price_band", 12, "cast(floor(l_extendedprice / 10000) as int)", None),
    ("supplier_group", 10, "l_suppkey % 10", None),
    ("part_group", 25, "l_partkey % 25", None),
)
FOURTEEN_CELLS = """WITH e AS MATERIALIZED (SELECT """ + ", ".join(
    f"CAST({sql or spark} AS VARCHAR) AS {name}" for name, _, spark, sql in FOURTEEN
) + """, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)
""" + "\nUNION ALL ".join(
    [
        """SELECT CAST(NULL AS VARCHAR) AS "rows", CAST(NULL AS VARCHAR) AS cols, CAST(NULL AS VARCHAR) AS "row", CAST(NULL AS VARCHAR) AS col,
  count(*) AS customers, CAST(sum(y) AS BIGINT) AS churned FROM e"""
    ]
    + [f"SELECT '{a[0]}', NULL, {a[0]}, NULL, count(*), CAST(sum(y) AS BIGINT) FROM e GROUP BY {a[0]}" for a in FOURTEEN]
    + [
        f"SELECT '{a[0]}', '{b[0]}', {a[0]}, {b[0]}, count(*), CAST(sum(y) AS BIGINT) FROM e GROUP BY {a[0]}, {b[0]}"
        for a, b in itertools.combinations(FOURTEEN, 2)
    ]
)


@query("d11_fourteen_dimensions", FOURTEEN_CELLS)
def fourteen_dimensions(spark, folder):
    """All 91 pairs of fourteen dimensions: together they have more combinations than there are rows."""
    columns = [F.expr(spark_sql).alias(name) for name, _, spark_sql, _ in FOURTEEN]
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y")
    rows = books.table(spark, folder, "lineitem").select(*columns, returned)
    sizes = {name: levels for name, levels, _, _ in FOURTEEN}
    return S.breakdown_counts(rows, list(sizes), label="y", sizes=sizes)


@query(
    "c9_dense_cells",
    f"""WITH {cells_sql()} SELECT "rows", cols, "row", col, row_pos, col_pos, customers, churned FROM cells""",
    "book",
)
def dense_cells(spark, folder):
    found = S.breakdown_counts(plain(spark, folder), list(DIMS), label="churn")
    return S.dense(found, S.level_grid(spark, DIMS))


@query(
    "c9_undeclared_levels",
    """SELECT 'segment' AS "rows", CAST(NULL AS VARCHAR) AS cols, segment AS "row", CAST(NULL AS VARCHAR) AS col,
  count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned
FROM book WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING') GROUP BY segment""",
    "book",
)
def undeclared_levels(spark, folder):
    found = S.breakdown_counts(plain(spark, folder), ["segment"], label="churn")
    return S.unknown_levels(found, {"segment": ("AUTOMOBILE", "BUILDING")}).select(
        "rows", "cols", "row", "col", "customers", "churned"
    )


@query(
    "d12_lifecycle",
    f"""WITH m AS (SELECT CAST(median(tenure) FILTER (churn = 1) AS DOUBLE) AS median_tenure_churned,
    CAST(median(tenure) FILTER (churn = 0) AS DOUBLE) AS median_tenure_stayed FROM book WHERE {TRAIN}),
{cells_sql(TRAIN)}
SELECT "row", customers, churned, {ratio_sql('churned', 'customers')} AS rate, partition_customers,
  median_tenure_churned, median_tenure_stayed
FROM cells, m WHERE "rows" = 'tenure_bucket' AND cols IS NULL""",
    "book",
)
def lifecycle(spark, folder):
    rows = train(spark, folder)
    cells = breakdown_cells(rows)
    table = S.lifecycle(cells, rows, tenure="tenure", label="churn", dimension="tenure_bucket")
    return table.select(
        "row", "customers", "churned", "rate", "partition_customers", "median_tenure_churned",
        "median_tenure_stayed",
    )


@query(
    "d13_spread_and_peak",
    f"""WITH {cells_sql(TRAIN)}, one AS (SELECT *, churned / CAST(customers AS DOUBLE) AS rate FROM cells
  WHERE cols IS NULL AND customers >= 20)
SELECT "rows", count(*) AS shown, CASE WHEN count(*) >= 2 AND min(rate) <> 0 THEN max(rate) / min(rate) END AS spread,
  CASE WHEN count(*) >= 2 THEN first("row" ORDER BY rate DESC, row_pos) END AS peak FROM one GROUP BY "rows" """,
    "book",
)
def spread_and_peak(spark, folder):
    found = durable(S.breakdown_counts(train(spark, folder), list(DIMS), label="churn"))
    dense = S.dense(found, S.level_grid(spark, DIMS, pairs=False)).withColumn(
        "reason", F.when(F.col("customers") < 20, "too_few")
    )
    return S.spread_and_peak(S.decorated(dense, S.total_of(found)))


@query(
    "h3_top_cells_per_table",
    f"""WITH {cells_sql(TRAIN)}, r AS (SELECT *, churned / CAST(customers AS DOUBLE) AS rate FROM cells WHERE customers > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY "rows", cols ORDER BY rate DESC, row_pos, col_pos NULLS FIRST) AS rank FROM r)
SELECT "rows", cols, "row", col, customers, rate, CAST(rank AS INT) AS rank FROM k WHERE rank <= 7""",
    "book",
)
def top_cells(spark, folder):
    top = S.top_cells(breakdown_cells(train(spark, folder)))
    return top.select("rows", "cols", "row", "col", "customers", "rate", "rank")


@query(
    "d21_subset_rate",
    f"SELECT count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned, {RATE} AS churn_rate "
    "FROM book WHERE segment <> 'BUILDING'",
    "book",
)
def subset_rate(spark, folder):
    return S.subset_rate(plain(spark, folder), F.col("segment") != "BUILDING", label="churn")


@query(
    "d22_observed_overall",
    """SELECT count(*) AS customers, CASE WHEN count(*) >= 20 THEN CAST(sum(churn) AS BIGINT) END AS churned,
  CASE WHEN count(*) >= 20 THEN CAST(sum(churn) AS DOUBLE) / count(*) END AS rate
FROM book WHERE partition_name IN ('train', 'validation')""",
    "book",
)
def observed_overall(spark, folder):
    rows = book(spark, folder).where(F.col("partition_name").isin(*fixed.SHOWN_PARTITIONS))
    return S.observed_overall(rows, label="churn")


# --- identity, nesting, reconciliation -----------------------------------------------------------


def nested_book(spark, folder):
    """The book with ``segment`` under a second name, so identical groups exist."""
    return plain(spark, folder).withColumn("line", F.concat(F.lit("line of "), F.col("segment")))


HASH_SQL = (
    "CAST('0x' || substr(md5(length(CAST(customer_id AS VARCHAR)) || ':' || CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT)"
)


@query(
    "c7_identical_groups",
    f"""WITH long AS (SELECT 'segment' AS dimension, segment AS segment, customer_id FROM book
  UNION ALL SELECT 'line', 'line of ' || segment, customer_id FROM book
  UNION ALL SELECT 'region', region, customer_id FROM book),
g AS (SELECT dimension, segment, count(*) AS customers, bit_xor({HASH_SQL}) AS members,
  CAST(sum(CAST({HASH_SQL} AS HUGEINT)) AS VARCHAR) AS checksum FROM long GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY customers, members, checksum) AS names FROM g
QUALIFY count(*) OVER (PARTITION BY customers, members, checksum) > 1""",
    "book",
)
def identical_groups(spark, folder):
    return S.identical_segments(nested_book(spark, folder), ["segment", "line", "region"], id="customer_id")


@query(
    "c8_betrayed_groups",
    f"""SELECT count(*) AS customers, bit_xor({HASH_SQL}) AS members,
  CAST(sum(CAST({HASH_SQL} AS HUGEINT)) AS VARCHAR) AS checksum, CAST(2 AS BIGINT) AS names
FROM book WHERE segment = 'BUILDING'""",
    "book",
)
def betrayed_groups(spark, folder):
    rows = nested_book(spark, folder)
    identical = S.identical_segments(rows, ["segment", "line"], id="customer_id")
    # A publication that hides one group under its first name only.
    shown_flags = identical.select(
        "dimension", "segment",
        (~((F.col("dimension") == "segment") & (F.col("segment") == "BUILDING"))).alias("shown"),
    )
    return S.betrayed(identical, shown_flags)


NEST = ("nation", "region", "in_debit")


@query(
    "c10_nested_groups",
    """WITH n AS (SELECT nation, any_value(region) AS region, count(*) AS n, CAST(sum(churn) AS BIGINT) AS c
  FROM book GROUP BY nation),
r AS (SELECT region, count(*) AS n, CAST(sum(churn) AS BIGINT) AS c FROM book GROUP BY region),
whole AS (SELECT count(*) AS n FROM book)
SELECT 'nation' AS "rows", n.nation AS "row", 'region' AS cols, r.region AS col, 'row inside col' AS relation,
  r.n - n.n AS customers, r.c - n.c AS churned FROM n JOIN r USING (region) WHERE n.n < r.n""",
    "book",
)
def nested_groups(spark, folder):
    found = S.breakdown_counts(plain(spark, folder), ["nation", "region"], label="churn")
    return S.nested_gaps(found)


@query(
    "c11_cross_table_reconciliation",
    """SELECT 'x' AS "check", 'x' AS "rows", 'x' AS cols, 'x' AS "row", 'x' AS col FROM book WHERE FALSE""",
    "book",
)
def reconciliation(spark, folder):
    cells = durable(S.both_orientations(breakdown_cells(train(spark, folder))))
    buckets = cells.where("rows = 'tenure_bucket' AND cols IS NULL")
    return S.reconcile(cells, buckets, "tenure_bucket")


@query(
    "c11_reconciliation_finds_a_changed_margin",
    f"""WITH {cells_sql(TRAIN)} SELECT 'cells do not add up to the margin' AS "check", 'segment' AS "rows", d AS cols,
  'BUILDING' AS "row", CAST(NULL AS VARCHAR) AS col
FROM (VALUES ('region'), ('in_debit'), ('tenure_bucket'), ('amount_band')) v(d)
UNION ALL SELECT 'churn does not add up to the margin', 'segment', d, 'BUILDING', NULL
FROM (VALUES ('region'), ('in_debit'), ('tenure_bucket'), ('amount_band')) v(d)
UNION ALL SELECT 'levels do not add up to the partition', 'segment', NULL, NULL, NULL""",
    "book",
)
def reconciliation_changed(spark, folder):
    cells = durable(breakdown_cells(train(spark, folder)))
    changed = (F.col("rows") == "segment") & F.col("cols").isNull() & (F.col("row") == "BUILDING")
    wrong = cells.withColumns(
        {
            "customers": F.when(changed, F.col("customers") + 1).otherwise(F.col("customers")),
            "churned": F.when(changed, F.col("churned") + 1).otherwise(F.col("churned")),
        }
    )
    return S.reconcile(S.both_orientations(wrong))


@query(
    "k1_k2_k3_buckets",
    "SELECT tenure_bucket, amount_band, risk_band, count(*) AS customers FROM book GROUP BY ALL",
    "book",
)
def buckets(spark, folder):
    return (
        plain(spark, folder)
        .groupBy("tenure_bucket", "amount_band", "risk_band")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query(
    "k4_k5_bins_and_clamp",
    """SELECT CAST(least(19, floor(score * 20)) AS INT) AS bin,
  round(min(greatest(least(score, 1.0e0 - 0.01e0), 0.01e0)), 9) AS low,
  round(max(greatest(least(score, 1.0e0 - 0.01e0), 0.01e0)), 9) AS high, count(*) AS n FROM lines GROUP BY 1""",
    "lines",
)
def bins_and_clamp(spark, folder):
    rows = books.book_lines(spark, folder)
    clamped = E.clamp("score", 50)
    table = rows.groupBy(E.histogram_bin("score").alias("bin")).agg(
        F.min(clamped).alias("low"), F.max(clamped).alias("high"), F.count(F.lit(1)).alias("n")
    )
    return rounded(table, 9, "low", "high")


@query(
    "k6_safe_ratio",
    f"""SELECT customer_id, {ratio_sql('total_charges', 'orders')} AS per_order FROM book""",
    "book",
)
def safe_ratio(spark, folder):
    return plain(spark, folder).select(
        "customer_id", E.finite(E.ratio("total_charges", "orders")).alias("per_order")
    )


@query(
    "k7_label_map",
    """SELECT d AS feature, CASE d WHEN 'segment' THEN 'Market segment' WHEN 'in_debit' THEN 'In debit' ELSE d END AS label,
  n FROM (SELECT 'segment' AS d, count(DISTINCT segment) AS n FROM book
  UNION ALL SELECT 'in_debit', count(DISTINCT in_debit) FROM book UNION ALL SELECT 'region', count(DISTINCT region) FROM book)""",
    "book",
)
def label_map(spark, folder):
    names = ["segment", "in_debit", "region"]
    long = S.members(plain(spark, folder), names)
    return (
        long.groupBy(F.col("dimension").alias("feature"))
        .agg(F.count_distinct("segment").alias("n"))
        .withColumn("label", E.label_of("feature", {"segment": "Market segment", "in_debit": "In debit"}))
    )


@query(
    "k8_contribution_sentences",
    """SELECT customer_id, 'Tenure (' || CAST(tenure AS VARCHAR) || ' months) '
    || CASE WHEN (score - 0.1) / 3.3 > 0 THEN 'raises' ELSE 'lowers' END || ' the estimated risk by '
    || printf('%.1f', abs((score - 0.1) / 3.3 * 100.0)) || ' percentage points, relative to an average customer.' AS by_tenure,
  'Monthly amount ($' || format('{:,.2f}', CAST(monthly_charges AS DOUBLE)) || ') lowers the estimated risk by 2.0 percentage points, relative to an average customer.' AS by_amount
FROM book""",
    "book",
)
def sentences(spark, folder):
    rows = plain(spark, folder)
    units = {"months": ["tenure"], "money": ["monthly_charges"]}
    tenure = E.shown_value(F.lit("tenure"), "tenure", **units)
    amount = E.shown_value(F.lit("monthly_charges"), "monthly_charges", **units)
    return rows.select(
        "customer_id",
        E.sentence(F.lit("Tenure"), tenure, (F.col("score") - 0.1) / 3.3).alias("by_tenure"),
        E.sentence(F.lit("Monthly amount"), amount, F.lit(-0.02)).alias("by_amount"),
    )


@query(
    "k10_hash_shape",
    """SELECT partition_name, count(*) FILTER (regexp_full_match(sha256(CAST(customer_id AS VARCHAR)), '[0-9a-f]{64}')) AS hashes,
  count(*) FILTER (regexp_full_match(md5(CAST(customer_id AS VARCHAR)), '[0-9a-f]{64}')) AS others FROM book GROUP BY 1""",
    "book",
)
def hash_shape(spark, folder):
    text = F.col("customer_id").cast("string")
    return book(spark, folder).groupBy("partition_name").agg(
        F.count_if(E.is_sha256(F.sha2(text, 256))).alias("hashes"),
        F.count_if(E.is_sha256(F.md5(text))).alias("others"),
    )


@query(
    "k11_category_codes",
    f"""SELECT segment, CAST(list_position({list(books.SEGMENTS[1:])}, segment) - 1 AS INT) AS code,
  CASE WHEN segment <> 'AUTOMOBILE' THEN segment END AS back, count(*) AS n FROM book GROUP BY 1, 2, 3""",
    "book",
)
def category_codes(spark, folder):
    vocabulary = books.SEGMENTS[1:]
    code = E.category_code("segment", vocabulary)
    return (
        plain(spark, folder)
        .select("segment", code.alias("code"), E.category_of(code, vocabulary).alias("back"))
        .groupBy("segment", "code", "back")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "k12_normal_ids",
    "SELECT upper(trim('  c-' || CAST(customer_id AS VARCHAR) || ' ')) AS id FROM book",
    "book",
)
def normal_ids(spark, folder):
    messy = F.concat(F.lit("  c-"), F.col("customer_id").cast("string"), F.lit(" "))
    return plain(spark, folder).select(E.normal_id(messy).alias("id"))


@query(
    "j2_union_of_dimension_tables",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS segment, count(*) AS customers FROM book GROUP BY {d}"
        for d in ("segment", "region", "in_debit")
    ),
    "book",
)
def union_of_tables(spark, folder):
    return (
        S.members(plain(spark, folder), ["segment", "region", "in_debit"])
        .groupBy("dimension", "segment")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
