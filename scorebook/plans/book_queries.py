"""Queries over the book itself: splits, outcomes, filters, listings, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.operators import book as B
from scorebook.operators import split as P
from scorebook.operators.prefix import positions
from scorebook.plans import books
from scorebook.plans.registry import (
    SHOWN, THRESHOLD, book, plain, lines, money_sql, query, ratio_sql, rounded, shown, train, validation,
)
from scorebook.session import scratch_path
from scorebook.sources import stored as T

DIGEST = (
    "CAST('0x' || substr(md5(length(CAST(customer_id AS VARCHAR)) || ':' || CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT)"
)


def parted(spark, folder):
    """The book without outcomes, and the outcomes that may be shown."""
    full = book(spark, folder)
    outcomes = full.where(F.col("partition_name").isin(*fixed.SHOWN_PARTITIONS)).select(
        "customer_id", "churn"
    )
    return full.drop("churn"), outcomes


# --- split ----------------------------------------------------------------------------------------


@query("h5_stratified_split", "SELECT customer_id, churn, partition_name FROM book", "book")
def stratified_split(spark, folder):
    return book(spark, folder).select("customer_id", "churn", "partition_name")


@query(
    "h6_stratified_folds",
    """SELECT customer_id, churn, CAST((row_number() OVER (PARTITION BY churn
  ORDER BY md5(CAST(customer_id AS VARCHAR) || ':7'), customer_id) - 1) % 5 AS INT) AS fold
FROM book WHERE partition_name = 'train'""",
    "book",
)
def stratified_folds(spark, folder):
    rows = train(spark, folder).select("customer_id", "churn")
    return P.stratified_folds(rows, id="customer_id", label="churn", folds=5, seed=7)


@query(
    "d14_split_summary",
    """SELECT partition_name, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share,
  CAST(sum(churn) AS BIGINT) AS positives, round(CAST(sum(churn) AS DOUBLE) / count(*), 4) AS positive_rate
FROM book GROUP BY partition_name""",
    "book",
)
def split_summary(spark, folder):
    return P.split_summary(book(spark, folder), label="churn")


@query(
    "d15_split_digest",
    f"""SELECT partition_name, count(*) AS n, bit_xor({DIGEST}) AS fingerprint,
  CAST(sum(CAST({DIGEST} AS HUGEINT)) AS VARCHAR) AS checksum FROM book GROUP BY 1""",
    "book",
)
def split_digest(spark, folder):
    return P.split_digest(book(spark, folder), id="customer_id")


@query(
    "d15_split_provenance",
    """SELECT 'same' AS recorded, TRUE AS verified, CAST(NULL AS VARCHAR) AS reason
UNION ALL SELECT 'other seed', FALSE, 'the split differs from the one the model was trained on'
UNION ALL SELECT 'none', FALSE, 'the model records no split, so no partition can be trusted'""",
)
def split_provenance(spark, folder):
    full = book(spark, folder)
    digest = P.split_digest(full, id="customer_id")
    other = P.stratified_split(
        full.drop("partition_name"), id="customer_id", label="churn", seed=43
    )
    recorded = {
        "same": digest,
        "other seed": P.split_digest(other, id="customer_id"),
        "none": digest.where(F.lit(False)),
    }
    out = None
    for name, table in recorded.items():
        row = P.provenance(digest, table).select(F.lit(name).alias("recorded"), "verified", "reason")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "a11_table_fingerprint",
    """WITH hashed AS (SELECT CAST('0x' || substr(md5(list_reduce(list_transform(
    [CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_linestatus, quantity_band],
    lambda x: coalesce(length(x) || ':' || x, 'n')), lambda a, b: a || b)), 1, 15) AS BIGINT) AS h FROM lines)
SELECT count(*) AS n, bit_xor(h) AS fingerprint, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS checksum FROM hashed""",
    "lines",
)
def table_fingerprint(spark, folder):
    return P.fingerprint(
        lines(spark, folder), ["l_orderkey", "l_linenumber", "l_linestatus", "quantity_band"]
    )


@query(
    "i5_seeded_sample",
    """SELECT customer_id, score FROM book WHERE partition_name = 'train'
ORDER BY md5(CAST(customer_id AS VARCHAR) || ':11'), customer_id LIMIT 100""",
    "book",
)
def seeded_sample(spark, folder):
    rows = train(spark, folder).select("customer_id", "score")
    return P.seeded_sample(rows, 100, id="customer_id", seed=11)


# --- outcomes -------------------------------------------------------------------------------------


@query(
    "c1_labelled_rows",
    "SELECT customer_id, segment, score, churn FROM book WHERE partition_name IN ('train', 'validation')",
    "book",
)
def labelled_rows(spark, folder):
    rows, outcomes = parted(spark, folder)
    return B.labelled(rows, outcomes).select("customer_id", "segment", "score", "churn")


@query(
    "c1_shown_rows_without_an_outcome",
    "SELECT customer_id FROM book WHERE partition_name = 'validation'",
    "book",
)
def shown_rows_without_outcome(spark, folder):
    rows, outcomes = parted(spark, folder)
    partial = outcomes.join(
        rows.where("partition_name = 'train'").select("customer_id"), "customer_id", "left_semi"
    )
    return B.unlabelled_rows(rows, partial).select("customer_id")


@query(
    "c2_c3_b15_outcome_status_and_risk",
    f"WITH {SHOWN} SELECT customer_id, outcome, status, round(at_risk, 6) AS at_risk FROM shown",
    "book",
)
def outcome_status_risk(spark, folder):
    rows, outcomes = parted(spark, folder)
    table = B.with_outcomes(rows, outcomes).select("customer_id", "outcome", "status", "at_risk")
    return rounded(table, 6, "at_risk")


@query(
    "c4_book_assembly",
    """SELECT customer_id, CASE WHEN nation = 'NATION_3' THEN 'unknown' ELSE partition_name END AS partition_name,
  tenure_bucket, score, CASE WHEN partition_name <> 'test' AND nation <> 'NATION_3' THEN churn END AS shown_outcome FROM book""",
    "book",
)
def book_assembly(spark, folder):
    full = book(spark, folder)
    split = full.where("nation <> 'NATION_3'").select("customer_id", "partition_name")
    rows, outcomes = B.assemble(
        full.drop("churn", "partition_name"), split, full.select("customer_id", "churn")
    )
    return rows.join(outcomes, "customer_id", "left").select(
        "customer_id", "partition_name", "tenure_bucket", "score",
        F.col("churn").alias("shown_outcome"),
    )


@query(
    "c4_book_without_outcomes",
    """SELECT customer_id, 'synthetic' AS partition_name, 'withheld' AS outcome, 'active' AS status,
  round(score * monthly_charges, 6) AS at_risk FROM book""",
    "book",
)
def book_without_outcomes(spark, folder):
    rows, outcomes = B.synthetic_book(book(spark, folder).drop("churn", "partition_name"))
    table = B.with_outcomes(rows, outcomes).select(
        "customer_id", "partition_name", "outcome", "status", "at_risk"
    )
    return rounded(table, 6, "at_risk")


@query(
    "c4_training_inputs",
    "SELECT customer_id, segment, tenure FROM book WHERE partition_name = 'train'",
    "book",
)
def training_inputs(spark, folder):
    rows, _ = parted(spark, folder)
    return B.training_rows(rows, ["segment", "tenure"])


INPUTS = ["segment", "region", "in_debit", "orders", "tenure"]


@query(
    "c5_held_out_match",
    f"""WITH held AS (SELECT * FROM book WHERE partition_name = 'test')
SELECT customer_id AS row FROM book b WHERE customer_id IN (SELECT customer_id FROM held WHERE in_debit = 'No')
  OR ({', '.join(f'b.{c}' for c in INPUTS)}) IN (SELECT {', '.join(INPUTS)} FROM held)""",
    "book",
)
def held_out_match(spark, folder):
    full = book(spark, folder)
    # An upload whose IDs are messy, and missing for customers in debit.
    uploaded = full.select(
        F.col("customer_id").alias("row"),
        F.when(
            F.col("in_debit") == "No", F.concat(F.lit(" c"), F.col("customer_id").cast("string"))
        ).otherwise("unknown").alias("customer_id"),
        *INPUTS,
    )
    held = full.where("partition_name = 'test'").withColumn(
        "customer_id", F.concat(F.lit("C"), F.col("customer_id").cast("string"))
    )
    return B.held_out_rows(uploaded, held, INPUTS, row="row")


@query(
    "c6_shared_rows",
    f"""SELECT count(*) AS shared FROM book b WHERE partition_name = 'train' AND EXISTS (SELECT 1 FROM book t
  WHERE t.partition_name = 'test' AND {' AND '.join(f't.{c} IS NOT DISTINCT FROM b.{c}' for c in INPUTS)})""",
    "book",
)
def shared_rows(spark, folder):
    full = book(spark, folder)
    return B.shared_count(
        full.where("partition_name = 'train'"), full.where("partition_name = 'test'"), INPUTS
    )


# --- filters --------------------------------------------------------------------------------------

LISTED = "customer_id, segment, region, tenure, score, risk_band, partition_name, outcome, status"
LIST = [c.strip() for c in LISTED.split(",")]

FILTER = B.BookFilter(
    query="1",
    bands=("Low", "Moderate"),
    equals=(("segment", "BUILDING"), ("in_debit", "No")),
    partition="validation",
    tenure_min=24,
    tenure_max=60,
    exclude_churned=True,
)
FILTER_SQL = """contains(CAST(customer_id AS VARCHAR), '1') AND segment = 'BUILDING' AND in_debit = 'No'
  AND partition_name = 'validation' AND tenure BETWEEN 24 AND 60 AND outcome <> 'churned'"""


@query(
    "b13_book_filter",
    f"WITH {SHOWN} SELECT {LISTED} FROM shown WHERE risk_band IN ('Low', 'Moderate') AND {FILTER_SQL}",
    "book",
)
def book_filter(spark, folder):
    return B.select_rows(shown(spark, folder), FILTER).select(*LIST)


@query(
    "b13_book_filter_by_ids",
    f"WITH {SHOWN} SELECT {LISTED} FROM shown WHERE customer_id IN (3, 77, 101)",
    "book",
)
def book_filter_ids(spark, folder):
    return B.select_rows(shown(spark, folder), B.BookFilter(ids=(3, 77, 101))).select(*LIST)


@query(
    "b14_explorer_ranges",
    """SELECT customer_id, segment, region, score, tenure FROM book WHERE segment IN ('BUILDING', 'MACHINERY')
  AND score BETWEEN 0.1 AND 0.3 AND tenure BETWEEN 12 AND 70""",
    "book",
)
def explorer_ranges(spark, folder):
    kept = B.explore(
        plain(spark, folder),
        {"segment": ("BUILDING", "MACHINERY"), "region": ()},
        score=(0.1, 0.3),
        tenure=(12, 70),
    )
    return kept.select("customer_id", "segment", "region", "score", "tenure")


@query(
    "b16_flag_at_threshold",
    """SELECT customer_id, score, risk_band, score >= 0.25 AS flagged FROM book""",
    "book",
)
def flag_at_threshold(spark, folder):
    return B.flag(plain(spark, folder), 0.25).select("customer_id", "score", "risk_band", "flagged")


@query("b17_point_lookup", "SELECT customer_id, segment, score, churn FROM book WHERE customer_id = 77", "book")
def point_lookup(spark, folder):
    return B.by_id(plain(spark, folder), 77).select("customer_id", "segment", "score", "churn")


# --- counts and summaries ---------------------------------------------------------------------------

NAMES = [name for name, _, _ in fixed.RISK_BANDS]
NAMES_VALUES = ", ".join(f"('{n}')" for n in NAMES)


@query(
    "d16_band_counts",
    f"""WITH {SHOWN}, names(risk_band) AS (VALUES {NAMES_VALUES}),
s AS (SELECT risk_band, count(*) AS n FROM shown WHERE {FILTER_SQL} GROUP BY 1)
SELECT risk_band, coalesce(n, 0) AS customers FROM names LEFT JOIN s USING (risk_band)""",
    "book",
)
def band_counts(spark, folder):
    return B.band_counts(shown(spark, folder), FILTER, NAMES)


@query(
    "d16_status_counts",
    f"""WITH {SHOWN}, names(status) AS (VALUES ('active'), ('churned'), ('unknown')),
s AS (SELECT status, count(*) AS n FROM shown WHERE segment = 'BUILDING' GROUP BY 1)
SELECT status, coalesce(n, 0) AS customers FROM names LEFT JOIN s USING (status)""",
    "book",
)
def status_counts(spark, folder):
    return B.status_counts(shown(spark, folder).where("segment = 'BUILDING'"))


HISTOGRAM = ", ".join(f"count(*) FILTER (least(19, floor(score * 20)) = {i})" for i in range(20))


@query(
    "d17_selection_summary",
    f"""WITH {SHOWN}, s AS (SELECT * FROM shown WHERE segment = 'BUILDING'),
t AS (SELECT count(*) AS customers, count(*) / 1000.0e0 AS share_of_book, count(*) FILTER (flagged) AS flagged,
  {ratio_sql('count(*) FILTER (flagged)', 'count(*)')} AS flagged_share, round(avg(score), 9) AS mean_probability,
  round(sum(score), 6) AS expected_churners, count(*) FILTER (outcome <> 'withheld') AS seen,
  count(*) FILTER (outcome = 'churned') AS y, {money_sql('monthly_charges')} AS monthly_charges,
  coalesce({money_sql("CASE WHEN status = 'active' THEN monthly_charges END")}, 0.0e0) AS active_monthly_charges,
  round(coalesce(sum(at_risk), 0.0e0), 4) AS at_risk, [{HISTOGRAM}] AS histogram FROM s)
SELECT customers, share_of_book, flagged, flagged_share, mean_probability, expected_churners,
  seen AS observed_customers, CASE WHEN seen >= 20 THEN y END AS observed_churned,
  CASE WHEN seen >= 20 THEN CAST(y AS DOUBLE) / seen END AS observed_rate, monthly_charges, active_monthly_charges,
  at_risk, histogram FROM t""",
    "book",
)
def selection_summary(spark, folder):
    rows, outcomes = parted(spark, folder)
    selection = shown(spark, folder).where("segment = 'BUILDING'").drop("churn")
    table = B.summarise(selection, outcomes, 1000)
    return rounded(rounded(rounded(table, 9, "mean_probability"), 6, "expected_churners"), 4, "at_risk")


@query(
    "d18_batch_summary",
    f"""SELECT count(*) AS rows, count(*) FILTER (score >= {THRESHOLD}) AS flagged,
  {ratio_sql(f'count(*) FILTER (score >= {THRESHOLD})', 'count(*)')} AS flagged_share, round(avg(score), 9) AS mean_probability,
  round(sum(score), 6) AS expected_churners, round(sum(score * monthly_charges), 4) AS at_risk,
  {', '.join(f"count(*) FILTER (risk_band = '{n}') AS band_{n.lower()}" for n in NAMES)} FROM book""",
    "book",
)
def batch_summary(spark, folder):
    table = B.batch_summary(B.flag(plain(spark, folder), THRESHOLD), NAMES)
    return rounded(rounded(rounded(table, 9, "mean_probability"), 6, "expected_churners"), 4, "at_risk")


@query(
    "d19_label_check",
    f"""WITH {SHOWN}, c AS (SELECT count(*) FILTER (outcome <> 'withheld') AS labelled,
  count(*) FILTER (outcome = 'withheld') AS excluded_test,
  count(*) FILTER (outcome <> 'withheld' AND flagged AND churn = 1) AS tp,
  count(*) FILTER (outcome <> 'withheld' AND flagged AND churn = 0) AS fp,
  count(*) FILTER (outcome <> 'withheld' AND NOT flagged AND churn = 1) AS fn FROM shown)
SELECT labelled, excluded_test, CASE WHEN labelled >= 20 THEN {ratio_sql('tp', 'tp + fp')} END AS precision,
  CASE WHEN labelled >= 20 THEN {ratio_sql('tp', 'tp + fn')} END AS recall,
  CASE WHEN labelled < 20 THEN 'Fewer than 20 rows carry a label.' END AS reason FROM c""",
    "book",
)
def label_check(spark, folder):
    return B.label_check(shown(spark, folder), F.col("partition_name") == "test")


@query(
    "d19_label_check_without_flags",
    """SELECT count(*) AS labelled, CAST(0 AS BIGINT) AS excluded_test, CAST(NULL AS DOUBLE) AS precision, 0.0e0 AS recall,
  'Among the labelled rows nobody is flagged: precision lacks a base.' AS reason FROM book""",
    "book",
)
def label_check_without_flags(spark, folder):
    return B.label_check(plain(spark, folder).withColumn("flagged", F.lit(False)), F.lit(False))


# --- order, pages, projections ---------------------------------------------------------------------


@query(
    "i1_stable_sort",
    f"WITH {SHOWN} SELECT customer_id, at_risk FROM shown ORDER BY at_risk DESC NULLS LAST, customer_id",
    "book",
)
def stable_sort(spark, folder):
    return B.ordered(shown(spark, folder).select("customer_id", "at_risk"), "at_risk", True)


def page_sql(page: int, size: int) -> str:
    return f"""WITH t AS (SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / {size}.0)) AS BIGINT) AS pages FROM book),
r AS (SELECT customer_id, tenure, row_number() OVER (ORDER BY tenure DESC, customer_id) AS position FROM book)
SELECT customer_id, tenure, position, CAST(least({page}, pages) AS INT) AS page, pages, total FROM r, t
WHERE position > (least({page}, pages) - 1) * {size} AND position <= least({page}, pages) * {size}"""


def one_page(spark, folder, page: int):
    rows = plain(spark, folder).select("customer_id", "tenure")
    return B.page_of(rows, sort="tenure", descending=True, page=page, page_size=25)


@query("i2_first_page", page_sql(1, 25), "book")
def first_page(spark, folder):
    return one_page(spark, folder, 1)


@query("i2_page_past_the_end", page_sql(10**6, 25), "book")
def page_past_end(spark, folder):
    return one_page(spark, folder, 10**6)


@query(
    "i3_flagged_only_in_order",
    "SELECT customer_id AS row, score, monthly_charges, TRUE AS flagged FROM book WHERE score >= 0.25 ORDER BY score DESC, row",
    "book",
)
def flagged_only(spark, folder):
    scored = B.flag(plain(spark, folder), 0.25).select(
        F.col("customer_id").alias("row"), "score", "monthly_charges", "flagged"
    )
    return B.arrange(scored, flagged_only=True, sort="score", descending=True)


@query(
    "i4_head_of_a_ranking",
    "SELECT customer_id, total_charges FROM book ORDER BY total_charges DESC, customer_id LIMIT 12",
    "book",
)
def head_of_ranking(spark, folder):
    rows = plain(spark, folder).select("customer_id", "total_charges")
    return B.head(rows, 12, F.col("total_charges").desc(), F.col("customer_id"))


@query(
    "h4_example_customers",
    """WITH g AS (SELECT risk_band, score >= 0.2 AS flagged, customer_id, score,
  row_number() OVER (PARTITION BY risk_band, score >= 0.2 ORDER BY score, customer_id) AS rn,
  count(*) OVER (PARTITION BY risk_band, score >= 0.2) AS n FROM book WHERE partition_name = 'validation')
SELECT risk_band, flagged, customer_id, score FROM g WHERE rn = (n - 1) // 2 + 1
  AND (risk_band, flagged) IN (('Low', FALSE), ('Low', TRUE), ('Moderate', TRUE), ('High', TRUE))""",
    "book",
)
def example_customers(spark, folder):
    cases = (("Low", False), ("Low", True), ("Moderate", True), ("High", True))
    return B.example_rows(shown(spark, folder), cases)


@query(
    "h2_neighbour_scores",
    """WITH r AS (SELECT score, count(*) AS n FROM lines GROUP BY score)
SELECT score, n, CAST(sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_or_above FROM r""",
    "lines",
)
def neighbour_scores(spark, folder):
    from scorebook.operators.prefix import running_totals

    counted = lines(spark, folder).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, "score", {"at_or_above": "n"}, descending=True).drop(
        "all_at_or_above"
    )


@query(
    "a7_row_positions",
    "SELECT customer_id, row_number() OVER (ORDER BY score DESC, customer_id) AS position FROM book",
    "book",
)
def row_positions(spark, folder):
    rows = plain(spark, folder).select("customer_id", "score")
    return positions(rows, [F.col("score").desc(), F.col("customer_id")]).drop("score")


@query(
    "a8_export_rows",
    f"""WITH {SHOWN} SELECT customer_id, segment, tenure, score, risk_band, flagged, partition_name, outcome, status FROM shown""",
    "book",
)
def export_rows(spark, folder):
    return B.export_rows(shown(spark, folder), ["segment", "tenure"])


@query(
    "a8_explorer_table",
    f"WITH {SHOWN} SELECT customer_id, score, segment, tenure, outcome FROM shown ORDER BY score DESC, customer_id",
    "book",
)
def explorer_table(spark, folder):
    return B.explorer_table(shown(spark, folder), ["customer_id", "score", "segment", "tenure", "outcome"])


@query(
    "a8_contact_list",
    "SELECT customer_id, score, tenure, monthly_charges FROM book WHERE score >= 0.3 ORDER BY score DESC, customer_id",
    "book",
)
def contact_list(spark, folder):
    return B.contact_list(plain(spark, folder), 0.3, ["customer_id", "score", "tenure", "monthly_charges"])


@query(
    "c4_lookups_in_the_stored_book",
    """SELECT b.segment, b.partition_name, b.customer_id IS NOT NULL AS found, count(*) AS lookups, count(DISTINCT o.o_custkey * 2) AS ids
FROM orders o LEFT JOIN book b ON b.customer_id = o.o_custkey * 2 GROUP BY 1, 2, 3""",
    "book",
)
def lookups_in_the_stored_book(spark, folder):
    """The book stored in buckets by ID, and one lookup per order, of an ID that may not be there."""
    kept = T.store_book(books.book_orders(spark, folder), scratch_path(spark, "book"), id="customer_id")
    asked = books.table(spark, folder, "orders").select((F.col("o_custkey") * 2).alias("customer_id"))
    found = T.looked_up(T.read_book(spark, kept), asked, id="customer_id")
    return found.groupBy("segment", "partition_name", "found").agg(
        F.count("*").alias("lookups"), F.count_distinct("customer_id").alias("ids")
    )
