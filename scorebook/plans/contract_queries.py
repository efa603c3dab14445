"""Queries over cleaning, checking, sources and sinks.

The raw table is the order book as text with defects put in by nation, so the checks have something
to find at every scale.  Source and sink queries write files derived from the tables to a fresh
path in the shared folder and read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.operators import book as B
from scorebook.operators import validation as V
from scorebook.operators.tables import beside, named_rows
from scorebook.plans import books
from scorebook.plans.registry import SHOWN, book, plain, lines, query, shown, train
from scorebook.session import scratch_path
from scorebook.sources import files, sinks

CONTRACT = V.Contract(
    id="customer_id",
    label="churn",
    numbers={"tenure": (0.0, 120.0), "monthly_charges": (0.0, 1e7), "total_charges": (0.0, 1e9)},
    categories={
        "segment": books.SEGMENTS,
        "region": books.REGIONS,
        "in_debit": books.YES_NO,
        "buyer": books.YES_NO,
        "order_size": ("none", "small", "large"),
    },
    integers=("tenure",),
    exactly_when=(("order_size", "none", "buyer", "No"),),
    zero_together=(("total_charges", "tenure"),),
)


def raw(spark, folder):
    """The order book as text, with defects."""
    nation = F.col("nation")
    money = F.format_string("%.2f", "total_charges")
    size = F.when(F.col("orders") == 0, "none").when(F.col("orders") < 8, "small").otherwise("large")
    return plain(spark, folder).select(
        F.concat(F.lit("c"), F.col("customer_id").cast("string")).alias("customer_id"),
        F.when(nation == "NATION_3", F.concat(F.lit("UNLISTED "), "region"))
        .when(nation == "NATION_5", F.concat(F.lit("  "), "segment", F.lit(" ")))
        .otherwise(F.col("segment")).alias("segment"),
        "region",
        F.when(nation != "NATION_12", F.col("in_debit")).alias("in_debit"),
        F.when(F.col("orders") == 0, "No").otherwise("Yes").alias("buyer"),
        F.when(nation == "NATION_4", "none").otherwise(size).alias("order_size"),
        F.when(nation == "NATION_7", "-5").when(nation == "NATION_8", "abc")
        .when(nation == "NATION_10", "7.5").otherwise(F.col("tenure").cast("string")).alias("tenure"),
        F.col("monthly_charges").cast("string").alias("monthly_charges"),
        F.when((nation == "NATION_9") | (F.col("orders") == 0), " ")
        .when(nation == "NATION_14", "n/a").otherwise(money).alias("total_charges"),
        F.when(F.col("churn") == 1, "Yes").otherwise("No").alias("churn"),
    )


RAW = """raw AS (SELECT 'c' || CAST(customer_id AS VARCHAR) AS customer_id,
  CASE nation WHEN 'NATION_3' THEN 'UNLISTED ' || region WHEN 'NATION_5' THEN '  ' || segment || ' ' ELSE segment END AS segment,
  region, CASE WHEN nation <> 'NATION_12' THEN in_debit END AS in_debit,
  CASE WHEN orders = 0 THEN 'No' ELSE 'Yes' END AS buyer,
  CASE WHEN nation = 'NATION_4' THEN 'none' WHEN orders = 0 THEN 'none' WHEN orders < 8 THEN 'small' ELSE 'large' END AS order_size,
  CASE nation WHEN 'NATION_7' THEN '-5' WHEN 'NATION_8' THEN 'abc' WHEN 'NATION_10' THEN '7.5' ELSE CAST(tenure AS VARCHAR) END AS tenure,
  CAST(monthly_charges AS VARCHAR) AS monthly_charges,
  CASE WHEN nation = 'NATION_9' OR orders = 0 THEN ' ' WHEN nation = 'NATION_14' THEN 'n/a'
    ELSE printf('%.2f', total_charges) END AS total_charges,
  CASE WHEN churn = 1 THEN 'Yes' ELSE 'No' END AS churn FROM book)"""


def clean_sql(derive: bool) -> str:
    filled = "WHEN trim(total_charges) = '' THEN TRY_CAST(tenure AS DOUBLE) * TRY_CAST(monthly_charges AS DOUBLE)" if derive else ""
    return f"""tidy AS (SELECT DISTINCT customer_id, trim(segment) AS segment, region, in_debit, buyer, order_size,
  TRY_CAST(tenure AS DOUBLE) AS tenure, TRY_CAST(monthly_charges AS DOUBLE) AS monthly_charges,
  CASE WHEN trim(total_charges) = '' AND TRY_CAST(tenure AS DOUBLE) IS NOT DISTINCT FROM 0 THEN 0.0e0 {filled}
    ELSE TRY_CAST(trim(total_charges) AS DOUBLE) END AS total_charges, churn FROM raw)"""


@query(
    "b1_b2_clean",
    f"""WITH {RAW}, {clean_sql(True)} SELECT * EXCLUDE (churn), CAST(CASE churn WHEN 'Yes' THEN 1 ELSE 0 END AS TINYINT) AS churn FROM tidy""",
    "book",
)
def clean(spark, folder):
    doubled = raw(spark, folder)
    doubled = doubled.unionByName(doubled.where("region = 'ASIA'"))
    return V.encode_label(V.clean(doubled, CONTRACT), CONTRACT)


@query(
    "b1_unknown_label_encodes_nothing",
    """SELECT CAST(NULL AS TINYINT) AS churn, count(*) AS rows FROM book""",
    "book",
)
def unknown_label(spark, folder):
    odd = raw(spark, folder).withColumn(
        "churn", F.when(F.col("region") == "ASIA", "maybe").otherwise(F.col("churn"))
    )
    table = V.encode_label(V.clean(odd, CONTRACT, deduplicate=False), CONTRACT)
    return table.groupBy("churn").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "b3_cleaning_report",
    f"""WITH {RAW}, two AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE region = 'ASIA'),
blank AS (SELECT *, trim(total_charges) = '' AS blank, TRY_CAST(tenure AS DOUBLE) IS NOT DISTINCT FROM 0 AS zero FROM raw)
SELECT (SELECT count(*) FROM two) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM two) - count(*) AS duplicates_dropped,
  count(*) FILTER (blank) AS blank_totals, count(*) FILTER (blank AND zero) AS filled_zero,
  count(*) FILTER (blank AND NOT zero) AS filled_derived, 'segment,total_charges' AS stripped_columns FROM blank""",
    "book",
)
def cleaning_report(spark, folder):
    doubled = raw(spark, folder)
    return V.cleaning_report(doubled.unionByName(doubled.where("region = 'ASIA'")), CONTRACT)


@query(
    "b4_required_columns",
    """SELECT 'missing column' AS "check", c AS "column", CAST(1 AS BIGINT) AS n, (SELECT count(*) FROM book) AS "rows"
FROM (VALUES ('score'), ('amount')) v(c)""",
    "book",
)
def required_columns(spark, folder):
    """Columns the contract asks for and the file lacks, and how many rows go without them."""
    rows = raw(spark, folder).select("customer_id", "segment")
    found = V.problems(rows, CONTRACT, columns=["customer_id", "segment", "score", "amount"])
    missing = found.where(F.col("check") == "missing column").select("check", "column", "n")
    return beside(missing, rows.agg(F.count("*").alias("rows")))


@query(
    "b5_label_check",
    """SELECT 'missing label' AS "check", 'churn' AS "column", count(*) AS n, CAST(NULL AS VARCHAR) AS examples FROM book WHERE region = 'EUROPE'
UNION ALL SELECT 'unexpected value', 'churn', count(*), 'maybe' FROM book WHERE region = 'ASIA'""",
    "book",
)
def label_check(spark, folder):
    region = F.col("region")
    odd = raw(spark, folder).withColumn(
        "churn", F.when(region == "ASIA", "maybe").when(region != "EUROPE", F.col("churn"))
    )
    found = V.problems(V.clean(odd, CONTRACT, deduplicate=False), CONTRACT, columns=["churn"])
    return found.select("check", "column", "n", F.array_join("examples", ",").alias("examples"))


@query(
    "b5_mixed_labels",
    """SELECT 'mixes Yes/No with 0/1' AS "check", 'churn' AS "column", count(*) AS n FROM book WHERE region = 'ASIA'""",
    "book",
)
def mixed_labels(spark, folder):
    mixed = raw(spark, folder).withColumn(
        "churn", F.when(F.col("region") == "ASIA", "0").otherwise(F.col("churn"))
    )
    return V.problems(mixed, CONTRACT, columns=["churn"]).select("check", "column", "n")


@query(
    "b6_b8_number_and_consistency_checks",
    f"""WITH {RAW}, {clean_sql(True)}, p AS (
SELECT 'missing or not a number' AS "check", 'tenure' AS "column", count(*) FILTER (tenure IS NULL) AS n FROM tidy
UNION ALL SELECT 'not a whole number', 'tenure', count(*) FILTER (tenure <> floor(tenure)) FROM tidy
UNION ALL SELECT 'outside the valid range', 'tenure', count(*) FILTER (tenure < 0 OR tenure > 120) FROM tidy
UNION ALL SELECT 'missing or not a number', 'total_charges', count(*) FILTER (total_charges IS NULL) FROM tidy
UNION ALL SELECT 'outside the valid range', 'total_charges', count(*) FILTER (total_charges < 0 OR total_charges > 1e9) FROM tidy
UNION ALL SELECT 'contradicts buyer', 'order_size', count(*) FILTER ((order_size = 'none') <> (buyer = 'No')) FROM tidy
UNION ALL SELECT 'contradicts tenure', 'total_charges', count(*) FILTER ((total_charges = 0) <> (tenure = 0)) FROM tidy
UNION ALL SELECT 'missing value', 'in_debit', count(*) FILTER (in_debit IS NULL) FROM tidy)
SELECT * FROM p WHERE n > 0""",
    "book",
)
def number_checks(spark, folder):
    found = V.problems(V.clean(raw(spark, folder), CONTRACT), CONTRACT)
    return found.where("check <> 'unexpected value'").select("check", "column", "n")


@query(
    "b7_b9_vocabulary_check",
    f"""WITH {RAW}, b AS (SELECT trim(segment) AS v, count(*) AS n FROM raw WHERE segment LIKE 'UNLISTED%' GROUP BY 1)
SELECT 'unexpected value' AS "check", 'segment' AS "column", CAST(sum(n) AS BIGINT) AS n,
  array_to_string((list_sort(list(v)))[1:5], ',') AS examples, CAST(greatest(count(*) - 5, 0) AS INT) AS more FROM b HAVING count(*) > 0""",
    "book",
)
def vocabulary_check(spark, folder):
    found = V.unexpected_values(
        V.clean(raw(spark, folder), CONTRACT, deduplicate=False), CONTRACT.categories
    )
    return found.withColumn("examples", F.array_join("examples", ","))


@query(
    "b9_bounded_quoting",
    """WITH v AS (SELECT 'a rather long value that goes on: ' || source || ' ' || lang AS v, count(*) AS n FROM docs GROUP BY 1),
t AS (SELECT list_transform((list_sort(list(v)))[1:5], lambda x: CASE WHEN length(x) > 40 THEN x[1:40] || '…' ELSE x END) AS e,
  count(*) AS d, CAST(sum(n) AS BIGINT) AS n FROM v)
SELECT 'unexpected value' AS "check", 'note' AS "column", n, array_to_string(e, '|') AS examples, CAST(d - len(e) AS INT) AS more FROM t""",
    "docs",
)
def bounded_quoting(spark, folder):
    note = F.concat(F.lit("a rather long value that goes on: "), "source", F.lit(" "), "lang")
    rows = books.book_docs(spark, folder).select(note.alias("note"))
    return V.unexpected_values(rows, {"note": ("none",)}).withColumn(
        "examples", F.array_join("examples", "|")
    )


@query("b10_model_input_columns", "SELECT region, in_debit, buyer, tenure FROM (SELECT region, in_debit, CASE WHEN orders = 0 THEN 'No' ELSE 'Yes' END AS buyer, tenure FROM book)", "book")
def model_input_columns(spark, folder):
    rows = plain(spark, folder).withColumn(
        "buyer", F.when(F.col("orders") == 0, "No").otherwise("Yes")
    )
    columns = V.model_input_columns(
        CONTRACT, drop=("segment", "order_size", "monthly_charges"), optional=("total_charges",)
    )
    return rows.select(*columns)


@query(
    "b11_key_uniqueness",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS m FROM lines GROUP BY 1, 2 HAVING count(*) > 1)
SELECT count(*) AS repeated_ids, CAST(coalesce(sum(m - 1), 0) AS BIGINT) AS extra_rows FROM k""",
    "lines",
)
def key_uniqueness(spark, folder):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return V.repeated_keys(lines(spark, folder).select(key.alias("line")), "line")


@query(
    "b11_features_and_target",
    "SELECT customer_id, segment, tenure, churn FROM book",
    "book",
)
def features_and_target(spark, folder):
    x, y = V.features_and_target(plain(spark, folder), ["segment", "tenure"], CONTRACT)
    return x.join(y, "customer_id")


@query(
    "b12_model_inputs",
    f"""WITH {RAW} SELECT customer_id, trim(segment) AS segment, in_debit, TRY_CAST(tenure AS DOUBLE) AS tenure,
  TRY_CAST(trim(total_charges) AS DOUBLE) AS total_charges FROM raw""",
    "book",
)
def model_inputs(spark, folder):
    columns = ["segment", "in_debit", "tenure", "total_charges"]
    return V.model_inputs(raw(spark, folder), columns, CONTRACT).select("customer_id", *columns)


@query(
    "j1_distinct_and_dropped",
    """WITH d AS (SELECT l_orderkey, l_linenumber, quantity_band, count(*) AS m FROM lines GROUP BY ALL)
SELECT CAST(sum(m) AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(sum(m) - count(*) AS BIGINT) AS dropped FROM d""",
    "lines",
)
def distinct_and_dropped(spark, folder):
    return V.duplicate_count(lines(spark, folder), ["l_orderkey", "l_linenumber", "quantity_band"])


@query(
    "j3_seen_except_allowed",
    "SELECT DISTINCT nation FROM book WHERE nation NOT IN ('NATION_0', 'NATION_1', 'NATION_2')",
    "book",
)
def seen_except_allowed(spark, folder):
    allowed = named_rows(spark, "nation string", [("NATION_0",), ("NATION_1",), ("NATION_2",)])
    return plain(spark, folder).select("nation").subtract(allowed)


# --- files -----------------------------------------------------------------------------------------


def text_book(spark, folder):
    """The book as text columns that print alike everywhere."""
    return plain(spark, folder).select(
        F.concat(F.lit("c"), F.col("customer_id").cast("string")).alias("customer_id"),
        "segment",
        "region",
        "in_debit",
        F.when(F.col("orders") > 0, F.col("tenure").cast("string")).otherwise(" ").alias("tenure"),
        F.col("monthly_charges").cast("string").alias("monthly_charges"),
        F.when(F.col("churn") == 1, "Yes").otherwise("No").alias("churn"),
    )


TEXT = """SELECT 'c' || CAST(customer_id AS VARCHAR) AS customer_id, segment, region, in_debit,
  CASE WHEN orders > 0 THEN CAST(tenure AS VARCHAR) ELSE ' ' END AS tenure,
  CAST(monthly_charges AS VARCHAR) AS monthly_charges, CASE WHEN churn = 1 THEN 'Yes' ELSE 'No' END AS churn FROM book"""


@query("a1_raw_csv_scan", TEXT, "book")
def raw_csv_scan(spark, folder):
    rows = text_book(spark, folder)
    path = scratch_path(spark, "raw")
    rows.write.csv(path, header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return files.read_raw(spark, path, rows.columns)


@query("a2_pinned_source_check", "SELECT 'another content' AS reason, CAST(1 AS BIGINT) AS files FROM region LIMIT 1")
def pinned_source(spark, folder):
    """A folder pinned as it is, with one file's pin changed."""
    path = scratch_path(spark, "pinned")
    text_book(spark, folder).repartition(4, "customer_id").write.csv(path, header=True)
    facts = files.file_facts(spark, path)
    first = facts.agg(F.min("file").alias("f"))
    pins = beside(facts, first).select(
        "file",
        F.when(F.col("file") == F.col("f"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
        "rows",
    )
    return (
        files.pin_differences(spark, path, pins)
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def messy_file(spark, folder, name: str):
    """A CSV of the book with marks, blank lines, unknown columns, short and wide rows."""
    rows = text_book(spark, folder)
    asia, africa = F.col("region") == "ASIA", F.col("region") == "AFRICA"
    line = F.concat_ws(",", "customer_id", F.lit('"x, y"'), "segment", "region", "tenure", "in_debit")
    line = F.when(asia, F.concat_ws(",", "customer_id", F.lit("z"), "segment")).otherwise(line)
    line = F.when(africa, F.concat(line, F.lit(",extra"))).otherwise(line)
    header = files.BOM + "customer_id,remark,segment,region,tenure,in_debit"
    marked = rows.select(
        F.explode(F.array(F.concat(F.lit(files.BOM), line), F.lit("   "))).alias(header)
    )
    path = scratch_path(spark, name)
    # One unquoted column per line: every part file starts with the header, as an upload does.
    marked.write.csv(
        path, header=True, sep="\u0001", quote="\u0000",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


@query(
    "a3_contract_csv_rows",
    """SELECT 'c' || CAST(customer_id AS VARCHAR) AS customer_id, segment, CASE WHEN region = 'ASIA' THEN '' ELSE region END AS region,
  CASE WHEN region = 'ASIA' THEN '' ELSE in_debit END AS in_debit,
  CASE WHEN region = 'ASIA' THEN '' WHEN orders > 0 THEN CAST(tenure AS VARCHAR) ELSE ' ' END AS tenure
FROM book WHERE region <> 'AFRICA'""",
    "book",
)
def contract_csv_rows(spark, folder):
    rows, _ = files.contract_rows(spark, messy_file(spark, folder, "contract"), CONTRACT)
    return rows.select("customer_id", "segment", "region", "in_debit", "tenure")


@query(
    "a3_contract_csv_refused",
    "SELECT 'too many fields' AS reason, count(*) AS rows FROM book WHERE region = 'AFRICA'",
    "book",
)
def contract_csv_refused(spark, folder):
    _, refused = files.contract_rows(spark, messy_file(spark, folder, "refused"), CONTRACT)
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


UPLOAD = V.Contract(
    id="customer_id",
    label="churn",
    numbers={"tenure": (0.0, 1200.0), "monthly_charges": (0.0, 1e7)},
    categories={"segment": books.SEGMENTS, "region": books.REGIONS, "in_debit": books.YES_NO},
    integers=("tenure",),
)


@query(
    "a4_upload_gate",
    """SELECT 'c' || CAST(customer_id AS VARCHAR) AS customer_id, segment, region, in_debit,
  CAST(tenure AS DOUBLE) AS tenure, CAST(monthly_charges AS DOUBLE) AS monthly_charges, TRUE AS numbered FROM book""",
    "book",
)
def upload_gate(spark, folder):
    path = scratch_path(spark, "upload")
    filled = F.when(F.trim("tenure") == "", "0").otherwise(F.col("tenure"))
    text_book(spark, folder).drop("churn").withColumn("tenure", filled).write.csv(path, header=True)
    big = files.Caps(bytes=1 << 50, rows=2**31 - 2)
    columns = ["segment", "region", "in_debit", "tenure", "monthly_charges"]
    ready = files.validate_upload(spark, path, UPLOAD, columns=columns, caps=big)
    return ready.select("customer_id", *columns, (F.col("row") >= 1).alias("numbered"))


@query(
    "a5_report_source",
    """SELECT segment AS model, round(CAST(sum(churn) AS DOUBLE) / count(*), 6) AS strength, count(*) AS customers FROM book GROUP BY 1""",
    "book",
)
def report_source(spark, folder):
    path = scratch_path(spark, "report")
    (
        plain(spark, folder)
        .groupBy(F.col("segment").alias("model"))
        .agg(F.round(E.ratio(F.sum("churn"), F.count(F.lit(1))), 6).alias("strength"), F.count(F.lit(1)).alias("customers"))
        .write.csv(path, header=True)
    )
    return files.read_report(
        spark, path, "model string, strength double, customers bigint",
        numbers=["strength", "customers"], shares=["strength"],
    )


@query(
    "a6_k9_spreadsheet_safe_csv",
    """SELECT doc_id, '''=' || source AS lead, 'a;''+' || lang AS inner_part, CAST(-n_chars AS BIGINT) AS number FROM docs""",
    "docs",
)
def spreadsheet_safe(spark, folder):
    path = scratch_path(spark, "safe")
    rows = books.book_docs(spark, folder).select(
        "doc_id",
        F.concat(F.lit("="), "source").alias("lead"),
        F.concat(F.lit("a;+"), "lang").alias("inner_part"),
        (-F.col("n_chars")).alias("number"),
    )
    sinks.write_csv(rows, path)
    back = files.read_raw(spark, path, rows.columns)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lead", "inner_part",
        F.col("number").cast("bigint").alias("number"),
    )


def defused_sql(source: str, text: str, key: str) -> str:
    """The rule without look-behind: its two character classes share no character."""
    inner = rf"""regexp_replace({text}, '([;\t\r\n"])([=+\-@])', '\1''\2', 'g')"""
    lead = r"regexp_matches(t, '^[=+\-@\t\r]')"
    return f"""WITH d AS (SELECT {key}, {text} AS t, {inner} AS x FROM {source}),
e AS (SELECT {key}, t, CASE WHEN {lead} THEN '''' || x ELSE x END AS y FROM d)
SELECT {key}, count(*) AS texts, count(*) FILTER (y <> t) AS changed,
  CAST(sum(length(y) - length(t)) AS BIGINT) AS marks FROM e GROUP BY 1"""


def defused_counts(df, text: str, key: str):
    safe = E.defuse(text)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(safe != F.col(text)).alias("changed"),
        F.sum(F.length(safe) - F.length(text)).cast("bigint").alias("marks"),
    )


@query("k9_formula_defusing_of_texts", defused_sql("documents", "text", "lang"))
def defused_texts(spark, folder):
    rows = books.table(spark, folder, "documents").select("lang", "text")
    return defused_counts(rows, "text", "lang")


@query("k9_formula_defusing_of_pages", defused_sql("pages", "html", "page_id"))
def defused_pages(spark, folder):
    rows = books.table(spark, folder, "pages").select("page_id", "html")
    return defused_counts(rows, "html", "page_id")


SAID = """(SELECT role, CASE WHEN length(text) > 40 THEN '=' ELSE 'a;-' END || text AS said FROM conversations)"""


@query("k9_formula_defusing_of_turns", defused_sql(SAID, "said", "role"))
def defused_turns(spark, folder):
    turns = books.table(spark, folder, "conversations")
    lead = F.when(F.length("text") > 40, "=").otherwise("a;-")
    return defused_counts(turns.select("role", F.concat(lead, "text").alias("said")), "said", "role")


@query(
    "a7_scored_file",
    """SELECT row_number() OVER (ORDER BY customer_id) AS row, customer_id, score, risk_band, score >= 0.25 AS flagged, segment, tenure FROM book""",
    "book",
)
def scored_file(spark, folder):
    from scorebook.operators.prefix import positions

    scored = B.flag(plain(spark, folder), 0.25)
    columns = ["customer_id", "score", "risk_band", "flagged", "segment", "tenure", "churn"]
    numbered = positions(scored.select(*columns), [F.col("customer_id")], output="row")
    path = scratch_path(spark, "scored")
    sinks.write_csv(sinks.scored_file(numbered, ["segment", "tenure"], id="customer_id"), path)
    schema = "row bigint, customer_id bigint, score double, risk_band string, flagged boolean, segment string, tenure int"
    return spark.read.schema(schema).csv(path, header=True)


FORMAT = {"segment": "text", "customers": "count", "churned": "count?", "rate": "share?", "threshold": "share"}


@query(
    "a9_a10_json_aggregate",
    """SELECT segment, count(*) AS customers, CASE WHEN count(*) >= 300 THEN CAST(sum(churn) AS BIGINT) END AS churned,
  CASE WHEN count(*) >= 300 THEN round(CAST(sum(churn) AS DOUBLE) / count(*), 9) END AS rate, 0.36e0 AS threshold FROM book GROUP BY 1""",
    "book",
)
def json_aggregate(spark, folder):
    enough = F.col("customers") >= 300
    table = (
        plain(spark, folder)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("churn").alias("c"))
        .select(
            "segment",
            "customers",
            F.when(enough, F.col("c")).alias("churned"),
            F.when(enough, F.round(E.ratio("c", "customers"), 9)).alias("rate"),
            F.lit(0.36).alias("threshold"),
        )
    )
    path = scratch_path(spark, "aggregate")
    sinks.write_json(table, path)
    return files.read_closed_json(spark, path, FORMAT, {"threshold": 0.36})


@query(
    "a10_closed_format_refusals",
    """SELECT CASE segment WHEN 'BUILDING' THEN 'other keys' WHEN 'FURNITURE' THEN 'not of the stated types'
  WHEN 'MACHINERY' THEN 'a value outside its kind' ELSE 'bound to another threshold' END AS reason, count(DISTINCT segment) AS records
FROM book WHERE segment <> 'AUTOMOBILE' GROUP BY 1""",
    "book",
)
def closed_format_refusals(spark, folder):
    s = F.col("segment")
    counted = plain(spark, folder).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    record = F.concat(
        F.lit('{"segment":"'), s, F.lit('","customers":'),
        F.when(s == "FURNITURE", F.lit('"many"')).when(s == "MACHINERY", F.lit("-1")).otherwise(F.col("n").cast("string")),
        F.lit(',"churned":null,"rate":null,"threshold":'),
        F.when(s == "HOUSEHOLD", "0.4").otherwise("0.36"),
        F.when(s == "BUILDING", F.lit(',"more":1}')).otherwise(F.lit("}")),
    )
    path = scratch_path(spark, "refusals")
    counted.select(record.alias("value")).write.text(path)
    found = files.closed_json_problems(spark, path, FORMAT, {"threshold": 0.36})
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@query(
    "a12_attribution_source",
    """SELECT customer_id AS id, 'segment' AS feature, segment AS value, round(score - 0.1, 6) AS contribution, 'abc' AS model_hash FROM book
UNION ALL SELECT customer_id, 'tenure', CAST(tenure AS VARCHAR), 0.5e0, 'abc' FROM book""",
    "book",
)
def attribution_source(spark, folder):
    rows = plain(spark, folder)
    one = rows.select(
        F.col("customer_id").alias("id"), F.lit("segment").alias("feature"), F.col("segment").alias("value"),
        F.round(F.col("score") - 0.1, 6).alias("contribution"), F.lit("abc").alias("model_hash"),
    )
    two = rows.select(
        F.col("customer_id").alias("id"), F.lit("tenure").alias("feature"), F.col("tenure").cast("string").alias("value"),
        F.lit(0.5).alias("contribution"), F.lit("abc").alias("model_hash"),
    )
    path = scratch_path(spark, "attributions")
    one.unionByName(two).write.parquet(path)
    return files.read_attributions(
        spark, path, model_hash="abc", features=["segment", "tenure"],
        vocabularies={"segment": books.SEGMENTS},
    )
