"""Queries over disclosure control: suppression, guards, audits, stored aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.operators import disclosure as D
from scorebook.operators import economics as X
from scorebook.operators import joint as J
from scorebook.operators import publish as P
from scorebook.operators import quality as Q
from scorebook.operators import segments as S
from scorebook.operators.prefix import medians
from scorebook.operators.tables import beside, named_rows
from scorebook.plans import books
from scorebook.plans.quality_queries import BASIS, CELLS, VALID, basis_sql, validation_basis
from scorebook.plans.registry import (
    SHOWN, THRESHOLD, book, docs, keeps_sql, lines, query, ratio_sql, rounded, shown, train, validation,
)
from scorebook.plans.segment_queries import DIMS, TRAIN, cells_sql
from scorebook.session import durable, scratch_path

JOINT = {k: books.DIMENSIONS[k] for k in ("segment", "region", "in_debit", "tenure_bucket")}
ALWAYS_HIDDEN = {"region": ("EUROPE",)}


def training_cells(spark, folder, dims=DIMS):
    """Dense training cells and the total, written once: the guards read them many times."""
    found = durable(S.breakdown_counts(train(spark, folder), list(dims), label="churn"))
    return durable(S.dense(found, S.level_grid(spark, dims))), S.total_of(found)


def reason_sql(crossed: str = "FALSE", hidden: str = "FALSE") -> str:
    return f"""CASE WHEN customers < 20 THEN 'too_few' WHEN {crossed} THEN 'cross_partition'
  WHEN {hidden} OR churned IS NULL OR NOT {keeps_sql('churned', 'customers - churned')} THEN 'withheld' END"""


CROSSED = """(("rows" = 'region' AND "row" = 'EUROPE') OR coalesce(cols = 'region' AND col = 'EUROPE', FALSE))"""


@query(
    "g1_g3_minimum_cell_suppression",
    f"""WITH {cells_sql(TRAIN)}, r AS (SELECT *, {reason_sql(CROSSED)} AS reason FROM cells)
SELECT "rows", cols, "row", col, customers, CASE WHEN reason IS NULL THEN churned END AS churned, reason FROM r""",
    "book",
)
def minimum_cell(spark, folder):
    cells, _ = training_cells(spark, folder)
    marked = D.suppressed(cells, hidden_levels=ALWAYS_HIDDEN)
    return marked.select(
        "rows", "cols", "row", "col", "customers",
        F.when(F.col("reason").isNull(), F.col("churned")).alias("churned"), "reason",
    )


@query(
    "g2_two_sided_rule",
    f"""SELECT lang, source, count(*) AS customers, {keeps_sql('sum(toxic)', 'count(*) - sum(toxic)')} AS keeps
FROM docs GROUP BY 1, 2""",
    "docs",
)
def two_sided_rule(spark, folder):
    y, n = F.sum("toxic"), F.count(F.lit(1))
    return docs(spark, folder).groupBy("lang", "source").agg(
        n.alias("customers"), E.two_sided(y, n - y).alias("keeps")
    )


def prefix_sql(source: str, keys: str, hidden: str, order: str, keeps: str, sums: dict[str, str]) -> str:
    """Rows of ``source`` with ``hide``: hidden ones first, then in ``order`` until ``keeps``."""
    part = f"PARTITION BY {keys}" if keys else ""
    running = ", ".join(
        f"sum({c}) OVER ({part} ORDER BY CASE WHEN hid THEN 0 ELSE 1 END, {order} ROWS UNBOUNDED PRECEDING) AS {n}"
        for n, c in sums.items()
    )
    return f"""h AS (SELECT *, {hidden} AS hid FROM {source}),
p AS (SELECT *, {running}, row_number() OVER ({part} ORDER BY CASE WHEN hid THEN 0 ELSE 1 END, {order}) AS place,
  count(*) FILTER (hid) OVER ({part}) AS m FROM h),
q AS (SELECT *, ({keeps}) AND place >= m AS settles FROM p),
guarded AS (SELECT *, hid OR (m > 0 AND NOT coalesce(bool_or(settles) OVER ({part}
  ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)) AS hide FROM q)"""


@query(
    "g4_one_way_complementary",
    f"""WITH {cells_sql(TRAIN)}, one AS (SELECT *, {reason_sql(CROSSED)} AS reason0,
    CAST({CROSSED} AS INT) AS lone FROM cells WHERE cols IS NULL AND customers > 0),
{prefix_sql('one', '"rows"', 'reason0 IS NOT NULL', 'customers, "row"', keeps_sql('rc', 'rn - rc') + ' AND ra < place', {'rn': 'customers', 'rc': 'churned', 'ra': 'lone'})}
SELECT "rows", "row", customers, CASE WHEN hide AND reason0 IS NULL THEN 'withheld' ELSE reason0 END AS reason FROM guarded
UNION ALL SELECT "rows", "row", customers, 'too_few' FROM cells WHERE cols IS NULL AND customers = 0""",
    "book",
)
def one_way_complementary(spark, folder):
    cells, _ = training_cells(spark, folder)
    table = D.guard_one_way(cells.where("cols IS NULL"), hidden_levels=ALWAYS_HIDDEN)
    return table.select("rows", "row", "customers", "reason")


def margins_guarded(spark, folder, dims):
    """Cells whose one-way counts are hidden as their own tables hide them."""
    cells, total = training_cells(spark, folder, dims)
    one = D.guard_one_way(cells.where("cols IS NULL"))
    hidden = one.where(F.col("reason").isNotNull()).select("rows", "row", F.lit(True).alias("__h"))
    joined = cells.join(hidden, ["rows", "row"], "left")
    unknown = F.col("cols").isNull() & F.coalesce("__h", F.lit(False)) & (F.col("customers") > 0)
    guarded = joined.withColumn("churned", F.when(~unknown, F.col("churned"))).drop("__h")
    return cells, durable(guarded), total


@query("g5_two_way_complementary")
def two_way_complementary(spark, folder):
    """The tables of all pairs of dimensions, each guarded on its own."""
    _, cells, total = margins_guarded(spark, folder, DIMS)
    return J.guard_two_way(cells, total).select("rows", "cols", "row", "col", "customers", "churned", "reason")


def joint_tables(spark, folder):
    truth, cells, total = margins_guarded(spark, folder, JOINT)
    settled = J.guard(J.system_of(cells, total))
    return truth, J.guarded_cells(cells, settled), total, settled


@query("g6_joint_guard")
def joint_guard(spark, folder):
    _, cells, _, _ = joint_tables(spark, folder)
    return cells.select("rows", "cols", "row", "col", "customers", "churned", "reason")


@query(
    "g6_joint_guard_hides_what_breaks_the_rule",
    f"""SELECT CAST(0 AS BIGINT) AS shown_and_breaking, count(*) AS cells FROM (WITH {cells_sql(TRAIN)} SELECT * FROM cells
  WHERE "rows" IN ('segment', 'region', 'in_debit', 'tenure_bucket')
    AND (cols IS NULL OR cols IN ('segment', 'region', 'in_debit', 'tenure_bucket')))""",
    "book",
)
def joint_guard_property(spark, folder):
    _, cells, _, _ = joint_tables(spark, folder)
    keeps = E.two_sided(F.col("churned"), F.col("customers") - F.col("churned"))
    return cells.agg(
        F.count_if(F.col("churned").isNotNull() & (F.col("customers") > 0) & ~keeps).alias("shown_and_breaking"),
        F.count(F.lit(1)).alias("cells"),
    )


EVERY = {**DIMS, "nation": tuple(f"NATION_{i}" for i in range(25))}


def guarded_with_medians(spark, folder, dims):
    """The joint guard of all tables over ``dims``, read with the published medians of tenure."""
    truth, cells, total = margins_guarded(spark, folder, dims)
    found = {r["churn"]: r["median"] for r in medians(train(spark, folder), "tenure", keys=["churn"]).collect()}
    size = total.first()
    capped = J.median_caps(
        J.system_of(cells, total), "tenure_bucket", books.TENURE_LABELS, books.TENURE_EDGES,
        churned=found.get(1), stayed=found.get(0), customers=size["customers"], churners=size["churned"],
    )
    settled = J.guard(capped)
    return truth, J.guarded_cells(cells, settled), settled


@query(
    "g6_joint_guard_of_every_dimension",
    f"""SELECT CAST(0 AS BIGINT) AS shown_and_breaking, CAST(0 AS BIGINT) AS bounds_wrong, CAST(0 AS BIGINT) AS given_away,
  CAST({sum(len(v) for v in EVERY.values()) + sum(len(EVERY[a]) * len(EVERY[b]) for a, b in itertools.combinations(EVERY, 2))} AS BIGINT) AS cells
FROM region LIMIT 1""",
)
def joint_guard_of_every_dimension(spark, folder):
    """All fifteen tables of six dimensions, nations within regions among them, with medians: no
    shown count breaks the rule, bounds hold the true counts and fix none that breaks it."""
    truth, cells, settled = guarded_with_medians(spark, folder, EVERY)
    keeps = E.two_sided(F.col("churned"), F.col("customers") - F.col("churned"))
    shown = cells.agg(
        F.count_if(F.col("churned").isNotNull() & (F.col("customers") > 0) & ~keeps).alias("shown_and_breaking"),
        F.count(F.lit(1)).alias("cells"),
    )
    audit = J.bounds(settled)
    known = truth.select(J.node_of().alias("node"), F.col("churned").alias("true"))
    outside = audit.join(known, "node").agg(
        F.count_if(~F.col("true").between(F.col("lo"), F.col("hi"))).alias("bounds_wrong")
    )
    given = J.determined(settled, audit=audit).where("breaks").agg(F.count(F.lit(1)).alias("given_away"))
    return beside(shown, outside, given)


@query("g7_guard_again_changes_nothing", "SELECT CAST(0 AS BIGINT) AS changed FROM region LIMIT 1")
def guard_again(spark, folder):
    _, cells, total, _ = joint_tables(spark, folder)
    published = durable(cells.withColumn("before", F.col("churned").isNull()))
    again = J.guard_published(published.drop("reason"), total)
    hides_more = F.col("churned").isNull() & ~F.col("before")
    return again.agg(F.count_if(hides_more).alias("changed"))


@query("g8_bounds_audit")
def bounds_audit(spark, folder):
    truth, _, total, settled = joint_tables(spark, folder)
    one = medians(train(spark, folder), "tenure", keys=["churn"])
    found = {r["churn"]: r["median"] for r in one.collect()}
    size = total.first()
    capped = J.median_caps(
        settled, "tenure_bucket", books.TENURE_LABELS, books.TENURE_EDGES,
        churned=found.get(1), stayed=found.get(0), customers=size["customers"], churners=size["churned"],
    )
    return J.bounds(capped).where("hidden").select("node", "n", "lo", "hi")


@query(
    "g8_bounds_hold_the_true_counts",
    "SELECT CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS determined_and_breaking FROM region LIMIT 1",
)
def bounds_hold(spark, folder):
    truth, _, _, settled = joint_tables(spark, folder)
    audit = J.bounds(settled)
    known = truth.select(J.node_of().alias("node"), F.col("churned").alias("true"))
    joined = audit.join(known, "node")
    breaking = J.determined(settled, audit=audit).where("breaks").agg(F.count(F.lit(1)).alias("b"))
    return joined.agg(
        F.count_if(~F.col("true").between(F.col("lo"), F.col("hi"))).alias("outside")
    ).withColumn("determined_and_breaking", breaking.scalar())


# --- cuts ---------------------------------------------------------------------------------------------

LINES_BASIS = basis_sql("lines", "returned", "amount")


def lines_basis(spark, folder):
    return X.sweep_basis(lines(spark, folder), score="score", label="returned", amount="amount")


STEPS = """steps AS (SELECT threshold AS low, coalesce(lead(threshold) OVER (ORDER BY threshold), 1.0e0) AS high,
  true_positives - coalesce(lead(true_positives) OVER (ORDER BY threshold), 0) AS churners,
  false_positives - coalesce(lead(false_positives) OVER (ORDER BY threshold), 0) AS stayers FROM basis)"""


@query("g9_h2_sweep_intervals", f"WITH {LINES_BASIS}, {STEPS} SELECT * FROM steps", "lines")
def sweep_intervals(spark, folder):
    return D.intervals(lines_basis(spark, folder))


@query(
    "g10_interval_rule",
    f"WITH {LINES_BASIS}, {STEPS} SELECT bool_and(churners >= 20 AND stayers >= 20) AND min(low) = 0 AS holds FROM steps",
    "lines",
)
def interval_rule(spark, folder):
    return D.holds(lines_basis(spark, folder))


def safe_cuts_sql(minimum: int, stop: int) -> str:
    """The walk as a recursion: each cut looks up the first later one it can step to."""
    def enough(a: str, b: str) -> str:
        return (
            f"{a}.true_positives - {b}.true_positives >= {minimum} AND {a}.false_positives - {b}.false_positives >= {minimum}"
        )

    ahead = f"CASE WHEN w.cut < {stop} THEN (SELECT cut FROM basis WHERE cut = {stop}) END"
    return f"""nxt AS (SELECT w.cut, (SELECT min(b.cut) FROM basis b, basis s WHERE b.cut > w.cut AND {enough('w', 'b')}
    AND s.cut = CASE WHEN b.cut < {stop} THEN {stop} ELSE 100 END
    AND CASE WHEN w.cut < {stop} THEN b.cut <= {stop} ELSE TRUE END
    AND (b.cut = {stop} OR CASE WHEN b.cut < {stop} THEN {enough('b', 's')}
      ELSE b.true_positives >= {minimum} AND b.false_positives >= {minimum} END)) AS nx FROM basis w),
walk AS (SELECT 0 AS cut UNION ALL SELECT nxt.nx FROM walk JOIN nxt ON nxt.cut = walk.cut WHERE nxt.nx IS NOT NULL)"""


@query(
    "g11_safe_cuts",
    f"WITH RECURSIVE {LINES_BASIS}, {safe_cuts_sql(100, 29)} SELECT basis.threshold FROM walk JOIN basis USING (cut)",
    "lines",
)
def safe_cuts(spark, folder):
    return D.safe_cuts(lines_basis(spark, folder), required=(0.29,), minimum=100)


@query("g11_safe_cuts_per_segment")
def safe_cuts_per_segment(spark, folder):
    basis = X.sweep_basis(
        lines(spark, folder), score="score", label="returned", amount="amount", keys=["quantity_band"]
    )
    return D.safe_cuts(basis, required=(0.2,), preferred=(0.3, 0.5), minimum=20, keys=["quantity_band"])


# Thresholds a report might state the same sweep at: flagged counts exactly, churners roughly.
STATED = (0.10, 0.25, 0.40)


def stated_points(spark, folder):
    """The sweep at ``STATED`` as a reader of a rounded report knows it."""
    basis = X.at_cuts(lines_basis(spark, folder), STATED)
    flagged = F.col("true_positives") + F.col("false_positives")
    return basis.select(
        "threshold", flagged.alias("flagged"),
        F.greatest(F.col("true_positives") - 5, F.lit(0)).alias("low"),
        F.least(F.col("true_positives") + 5, flagged).alias("high"),
    )


OWN = (0.0, 0.11, 0.29, 0.41)


@query(
    "g12_pieces_with_stated_cuts",
    f"""WITH {LINES_BASIS}, own AS (SELECT threshold, true_positives + false_positives AS flagged, true_positives AS low,
  true_positives AS high, TRUE AS own FROM basis WHERE cut IN (0, 11, 29, 41)),
stated AS (SELECT threshold, true_positives + false_positives AS flagged, greatest(true_positives - 5, 0) AS low,
  least(true_positives + 5, true_positives + false_positives) AS high, FALSE AS own FROM basis WHERE cut IN (10, 25, 40)),
e AS (SELECT * FROM own UNION ALL SELECT * FROM stated),
p AS (SELECT threshold AS "from", own, lead(threshold) OVER w AS "to", flagged, low, high,
  coalesce(lead(flagged) OVER w, 0) AS bf, coalesce(lead(low) OVER w, 0) AS bl, coalesce(lead(high) OVER w, 0) AS bh,
  coalesce(lead(own) OVER w, FALSE) AS bo FROM e WINDOW w AS (ORDER BY threshold))
SELECT "from", "to", low - bh AS churners, (flagged - high) - (bf - bl) AS stayers, (own AND "from" <> 0) OR bo AS answers FROM p""",
    "lines",
)
def pieces_with_stated(spark, folder):
    return D.pieces(X.at_cuts(lines_basis(spark, folder), OWN), stated_points(spark, folder))


@query("g12_cuts_safe_with_stated_ones", "SELECT TRUE AS holds FROM region LIMIT 1")
def cuts_safe_with_stated(spark, folder):
    basis = lines_basis(spark, folder)
    stated = stated_points(spark, folder)
    cuts = D.safe_cuts(
        basis, required=(0.2,), minimum=20, forbidden=D.forbidden_steps(basis, stated)
    )
    return D.legacy_holds(D.basis_on(basis, cuts), stated)


# Thresholds off the grid of cuts, some just above or below a cut, so the step between is thin.
OFF_GRID = (0.0451, 0.1234, 0.2003, 0.2897, 0.3499, 0.405)


def off_grid_points(spark, folder):
    """What lies at or above ``OFF_GRID``: flagged rows exactly, churners to within three."""
    rows = lines(spark, folder)
    at = F.explode(F.array(*[F.lit(t) for t in OFF_GRID])).alias("threshold")
    known = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("returned").alias("k"))
    each = known.select("*", at).where(F.col("score") >= F.col("threshold"))
    sums = each.groupBy("threshold").agg(F.sum("n").alias("flagged"), F.sum("k").alias("k"))
    return sums.select(
        "threshold", "flagged", F.greatest(F.col("k") - 3, F.lit(0)).alias("low"), F.least(F.col("k") + 3, F.col("flagged")).alias("high")
    )


OFF_GRID_SQL = f"""stated AS (SELECT threshold, CAST(n AS BIGINT) AS flagged, greatest(CAST(k AS BIGINT) - 3, 0) AS low, least(CAST(k AS BIGINT) + 3, n) AS high
  FROM (SELECT t.threshold, count(*) AS n, sum(l.returned) AS k FROM lines l JOIN
    (SELECT unnest([{", ".join(f"{t!r}e0" for t in OFF_GRID)}]) AS threshold) t ON l.score >= t.threshold GROUP BY t.threshold))"""


@query(
    "g12_steps_forbidden_off_the_grid",
    f"""WITH {LINES_BASIS}, {OFF_GRID_SQL},
own AS (SELECT threshold AS t, true_positives + false_positives AS flagged, true_positives AS low, true_positives AS high FROM basis
  UNION ALL SELECT 2.0e0, 0, 0, 0),
steps AS (SELECT a.t AS a, b.t AS b FROM own a JOIN own b ON a.t < b.t),
edges AS (
  SELECT s.a, s.b, o.t, o.flagged, o.low, o.high FROM steps s JOIN own o ON o.t IN (s.a, s.b) UNION ALL
  SELECT s.a, s.b, x.threshold, x.flagged, x.low, x.high FROM steps s JOIN stated x ON x.threshold > s.a + 1e-9 AND x.threshold < s.b - 1e-9),
pieces AS (
  SELECT a, b, t, lead(t) OVER w AS t2, low - lead(high) OVER w AS churners,
    (flagged - high) - (lead(flagged) OVER w - lead(low) OVER w) AS stayers FROM edges WINDOW w AS (PARTITION BY a, b ORDER BY t))
SELECT DISTINCT a AS low, CASE WHEN b < 2 THEN b END AS high FROM pieces
WHERE t2 IS NOT NULL AND (churners < 20 OR stayers < 20) AND ((t = a AND a <> 0) OR (t2 = b AND b < 2))""",
    "lines",
)
def steps_forbidden_off_the_grid(spark, folder):
    return D.forbidden_steps(lines_basis(spark, folder), off_grid_points(spark, folder))


@query("g11_safe_cuts_beside_off_grid_ones")
def safe_cuts_off_the_grid(spark, folder):
    """The cuts to publish beside thresholds off the grid, and whether the two together keep the rule."""
    basis = durable(lines_basis(spark, folder))
    stated = durable(off_grid_points(spark, folder))
    cuts = D.safe_cuts(basis, minimum=20, forbidden=D.forbidden_steps(basis, stated))
    holds = D.legacy_holds(D.basis_on(basis, cuts), stated)
    return beside(cuts, holds)


PRINTED = "SELECT cut, threshold, true_positives + false_positives AS flagged, round(true_positives / CAST(true_positives + false_positives AS DOUBLE), 2) AS precision, round(true_positives / CAST(true_positives + false_negatives AS DOUBLE), 2) AS recall, true_positives + false_negatives AS positives FROM basis WHERE cut % 10 = 0 AND true_positives + false_positives > 0"


def printed_points(spark, folder, basis):
    """Every tenth cut as a report prints it, to two decimals."""
    flagged = F.col("true_positives") + F.col("false_positives")
    return basis.where((F.col("cut") % 10 == 0) & (flagged > 0)).select(
        "threshold", flagged.alias("flagged"),
        F.round(E.ratio("true_positives", flagged), 2).alias("precision"),
        F.round(E.ratio("true_positives", F.col("true_positives") + F.col("false_negatives")), 2).alias("recall"),
        (F.col("true_positives") + F.col("false_negatives")).alias("positives"),
    )


@query(
    "g13_count_range_from_rounded_rates",
    f"""WITH {BASIS}, pts AS ({PRINTED}), c AS (SELECT threshold, flagged, precision, recall,
  unnest(range(0, CAST(least(flagged, positives) AS BIGINT) + 1)) AS tp, positives FROM pts)
SELECT threshold, min(tp) AS low, max(tp) AS high FROM c
WHERE abs(tp / CAST(flagged AS DOUBLE) - precision) <= 0.005e0 + 1e-9
  AND abs(tp / CAST(positives AS DOUBLE) - recall) <= 0.005e0 + 1e-9 GROUP BY threshold""",
    "book",
)
def count_range(spark, folder):
    points = printed_points(spark, folder, validation_basis(spark, folder))
    return D.churner_range(points, F.col("positives")).select("threshold", "low", "high")


@query("g24_transcribed_figures", "SELECT 0.3e0 AS threshold, 'other rows flagged' AS reason FROM region LIMIT 1")
def transcribed_figures(spark, folder):
    basis = durable(lines_basis(spark, folder))
    points = printed_points(spark, folder, basis).drop("positives")
    wrong = points.withColumn(
        "flagged",
        F.when(F.abs(F.col("threshold") - 0.3) < 1e-9, F.col("flagged") + 1).otherwise(F.col("flagged")),
    )
    return D.transcription_differences(basis, wrong).select(
        F.round("threshold", 2).alias("threshold"), "reason"
    )


# --- segments and bands ---------------------------------------------------------------------------------

FOUR = ("tp", "fp", "fn", "tn")
SEGMENT_KEEPS = f"{keeps_sql('tp', 'fp')} AND {keeps_sql('fn', 'tn')}"
RUNNING_KEEPS = f"{keeps_sql('r_tp', 'r_fp')} AND {keeps_sql('r_fn', 'r_tn')}"


def doc_cells_sql(dims=("lang", "source", "size_band"), threshold: float = 0.25) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS segment, toxic AS y, score >= {threshold!r}e0 AS hit FROM docs" for d in dims
    )
    return f"""l AS ({union}), cells AS (SELECT dimension, segment, {CELLS} FROM l GROUP BY 1, 2),
sized AS (SELECT *, tp + fp + fn + tn AS size FROM cells),
{prefix_sql('sized', 'dimension', f'NOT ({SEGMENT_KEEPS})', 'size, segment', RUNNING_KEEPS, {f'r_{c}': c for c in FOUR})}"""


def doc_segments(spark, folder):
    rows = docs(spark, folder)
    dims = ["lang", "source", "size_band"]
    kwargs = {"score": "score", "label": "toxic", "threshold": 0.25}
    return (
        Q.segment_performance(rows, dims, **kwargs),
        Q.segment_cells(rows, dims, **kwargs),
        Q.confusion(rows, **kwargs),
    )


@query(
    "g14_segment_guard",
    f"""WITH {doc_cells_sql()} SELECT dimension, segment, size AS customers, tp + fp AS flagged,
  CASE WHEN NOT hide THEN tp + fn END AS churners FROM guarded""",
    "docs",
)
def segment_guard(spark, folder):
    segments, cells, _ = doc_segments(spark, folder)
    return D.guard_segments(segments, cells).select("dimension", "segment", "customers", "flagged", "churners")


BAND_SUMS = f"""{SHOWN}, bands AS (SELECT risk_band AS name, count(*) AS observed_customers,
    CAST(sum(churn) AS BIGINT) AS c FROM shown WHERE outcome <> 'withheld' GROUP BY 1),
seen AS (SELECT name, observed_customers, CASE WHEN observed_customers >= 20 THEN c END AS observed_churned FROM bands)"""


def seen_bands(spark, folder):
    table = S.band_summaries(shown(spark, folder), score="score", amount="monthly_charges")
    overall = S.observed_overall(
        book(spark, folder).where(F.col("partition_name").isin(*fixed.SHOWN_PARTITIONS)), label="churn"
    )
    return table, overall


@query(
    "g15_band_guard",
    f"""WITH {BAND_SUMS}, o AS (SELECT count(*) AS an, CAST(sum(churn) AS BIGINT) AS ac FROM shown WHERE outcome <> 'withheld'),
k AS (SELECT *, observed_churned IS NOT NULL AND {keeps_sql('observed_churned', 'observed_customers - observed_churned')} AS shown FROM seen),
s AS (SELECT k.*, an - sum(CASE WHEN shown THEN observed_customers ELSE 0 END) OVER () AS rn0,
  ac - sum(CASE WHEN shown THEN observed_churned ELSE 0 END) OVER () AS rc0,
  CASE WHEN shown THEN observed_customers ELSE 0 END AS add_n, CASE WHEN shown THEN observed_churned ELSE 0 END AS add_c FROM k, o),
{prefix_sql('s', '', 'NOT shown', 'observed_customers, name', keeps_sql('rc0 + xc', 'rn0 + xn - rc0 - xc'), {'xn': 'add_n', 'xc': 'add_c'})}
SELECT name, observed_customers, CASE WHEN NOT hide THEN observed_churned END AS observed_churned,
  CASE WHEN NOT hide THEN CAST(observed_churned AS DOUBLE) / observed_customers END AS observed_rate FROM guarded""",
    "book",
)
def band_guard(spark, folder):
    table, overall = seen_bands(spark, folder)
    return D.guard_bands(table.where("observed_customers > 0"), overall)


@query(
    "g16_guarded_report_table",
    f"""WITH t AS (SELECT nation, count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churned FROM book GROUP BY 1)
SELECT nation, customers, CASE WHEN {keeps_sql('churned', 'customers - churned')} THEN churned END AS churned,
  CASE WHEN {keeps_sql('churned', 'customers - churned')} THEN CAST(churned AS DOUBLE) / customers END AS churn_rate FROM t""",
    "book",
)
def guarded_report(spark, folder):
    table = S.rate_by(book(spark, folder), "nation", label="churn")
    keeps = E.two_sided("churned", F.col("customers") - F.col("churned"))
    reasons = table.select(
        F.col("nation").alias("level"), F.when(~keeps, "withheld").alias("reason")
    )
    return D.guarded_report(table, reasons, "nation")


@query(
    "g16_published_ranking",
    """WITH t AS (SELECT 'lines of ' || quantity_band AS feature, sum(returned) / CAST(count(*) AS DOUBLE) AS s FROM lines GROUP BY 1)
SELECT feature, round(s, 2) AS strength, CAST(row_number() OVER (ORDER BY s DESC, feature) AS INT) AS place FROM t""",
    "lines",
)
def published_ranking(spark, folder):
    table = S.rate_by(lines(spark, folder), "quantity_band", label="returned")
    ranking = table.select(
        F.concat(F.lit("lines of "), "quantity_band").alias("feature"), F.col("churn_rate").alias("strength")
    )
    return D.published_ranking(ranking)


@query(
    "g17_one_table_release",
    f"""WITH l AS (SELECT nation, churn AS y, score >= 0.1 AS hit FROM book UNION ALL SELECT 'everyone', churn, score >= 0.1 FROM book),
c AS (SELECT nation, {CELLS}, count(*) AS n FROM l GROUP BY 1), k AS (SELECT *, least(tn, fp, fn, tp) >= 20 AS ok FROM c)
SELECT nation, 0.1e0 AS threshold, TRUE AS adds_up, ok AS published, CASE WHEN ok THEN n END AS n, CASE WHEN ok THEN tp + fn END AS positives,
  CASE WHEN ok THEN tn END AS tn, CASE WHEN ok THEN fp END AS fp, CASE WHEN ok THEN fn END AS fn, CASE WHEN ok THEN tp END AS tp,
  CASE WHEN ok THEN round(CAST(tp + tn AS DOUBLE) / n, 4) END AS accuracy, CASE WHEN ok THEN round(CAST(tp AS DOUBLE) / (tp + fp), 4) END AS precision,
  CASE WHEN ok THEN round(CAST(tp AS DOUBLE) / (tp + fn), 4) END AS recall, CASE WHEN ok THEN round(2.0e0 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM k""",
    "book",
)
def one_table_release(spark, folder):
    rows = book(spark, folder).select("nation", "churn", "score")
    rows = rows.unionByName(rows.withColumn("nation", F.lit("everyone")))
    cells = Q.with_rates(Q.confusion(rows, score="score", label="churn", threshold=0.1, keys=["nation"]))
    table = cells.drop("accuracy", "precision", "recall", "f1").withColumn("threshold", F.lit(0.1))
    return D.released(table)


@query(
    "g17_stored_record_is_a_release",
    f"""WITH l AS (SELECT churn AS y, score >= 0.1 AS hit FROM book), c AS (SELECT {CELLS} FROM l)
SELECT 'as written' AS record, least(tn, fp, fn, tp) >= 20 AS exact FROM c UNION ALL SELECT 'rate changed', FALSE FROM c""",
    "book",
)
def stored_record(spark, folder):
    cells = Q.with_rates(Q.confusion(book(spark, folder), score="score", label="churn", threshold=0.1))
    table = cells.drop("accuracy", "precision", "recall", "f1").withColumn("threshold", F.lit(0.1))
    good = D.released(table).drop("adds_up", "published")
    both = good.withColumn("record", F.lit("as written")).unionByName(
        good.withColumn("recall", F.col("recall") + 0.01).withColumn("record", F.lit("rate changed"))
    )
    return D.is_released(both).select("record", "exact")


# --- audits ---------------------------------------------------------------------------------------------

CUTS = (0.0, 0.11, 0.29, 0.41)
BANDS_VALUES = ", ".join(f"('{n}', {lo!r}e0, {hi!r}e0)" for n, lo, hi in fixed.RISK_BANDS)


@query(
    "g18_published_facts",
    f"""WITH {BASIS}, {BAND_SUMS}, b(name, min, max) AS (VALUES {BANDS_VALUES}),
k AS (SELECT b.*, coalesce(observed_customers, 0) AS n, observed_churned AS c FROM b LEFT JOIN seen USING (name))
SELECT 'validation' AS partitions, 'churned' AS outcomes, threshold AS low, 2.0e0 AS high, true_positives AS value FROM basis WHERE cut IN (0, 11, 29, 41)
UNION ALL SELECT 'validation', 'stayed', threshold, 2.0e0, false_positives FROM basis WHERE cut IN (0, 11, 29, 41)
UNION ALL SELECT 'train,validation', 'all', min, max, n FROM k
UNION ALL SELECT 'train,validation', 'churned', min, max, c FROM k WHERE c IS NOT NULL
UNION ALL SELECT 'train,validation', 'all', 0.0e0, 2.0e0, count(*) FROM shown WHERE outcome <> 'withheld'
UNION ALL SELECT 'train,validation', 'churned', 0.0e0, 2.0e0, CAST(sum(churn) AS BIGINT) FROM shown WHERE outcome <> 'withheld'""",
    "book",
)
def published_facts(spark, folder):
    bands, overall = seen_bands(spark, folder)
    # At most 101 rows, read in several branches: written once, so the book is scanned once.
    basis = durable(validation_basis(spark, folder))
    return D.facts(basis=X.at_cuts(basis, CUTS), bands=bands, overall=overall)


def runs_sql(cuts: str) -> str:
    return f"""k AS (SELECT * FROM basis WHERE cut IN ({cuts})),
r AS (SELECT a.threshold AS low, b.threshold AS high, a.true_positives - b.true_positives AS c, a.false_positives - b.false_positives AS s
  FROM k a JOIN k b ON b.cut > a.cut UNION ALL SELECT threshold, 1.0e0, true_positives, false_positives FROM k),
v AS (SELECT round(low, 9) AS low, round(high, 9) AS high, 'churned' AS outcome, c AS value FROM r WHERE NOT (c >= 20 OR (c = 0 AND s = 0))
UNION ALL SELECT round(low, 9), round(high, 9), 'stayed', s FROM r WHERE NOT (s >= 20 OR (c = 0 AND s = 0)))"""


THIN = (0.0, 0.05, 0.06, 0.11, 0.29, 0.41)


@query("g19_cut_difference_audit", f"WITH {BASIS}, {runs_sql('0, 5, 6, 11, 29, 41')} SELECT * FROM v", "book")
def cut_difference_audit(spark, folder):
    basis = durable(validation_basis(spark, folder))
    return D.run_violations(durable(D.facts(basis=X.at_cuts(basis, THIN))))


@query(
    "j4_new_findings_only",
    f"""WITH {BASIS}, {runs_sql('0, 5, 6, 11, 29, 41')} SELECT * FROM v WHERE NOT (low IN (0.0, 0.06, 0.41) AND high IN (0.06, 0.41, 1.0))""",
    "book",
)
def new_findings(spark, folder):
    basis = durable(validation_basis(spark, folder))
    already = D.run_violations(D.facts(basis=X.at_cuts(basis, (0.0, 0.06, 0.41))))
    published = D.run_violations(D.facts(basis=X.at_cuts(basis, THIN)))
    return D.new_violations(published, already)


def union_audit_sql(shown_rows: str) -> str:
    return f"""t AS (SELECT count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp,
    count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn FROM l WHERE dimension = 'lang'),
known AS (SELECT dimension, segment, tp, fp, fn, tn FROM cells WHERE {shown_rows}),
rest AS (SELECT c.dimension, '(hidden together)' AS segment, t.tp - coalesce(k.tp, 0) AS tp, t.fp - coalesce(k.fp, 0) AS fp,
    t.fn - coalesce(k.fn, 0) AS fn, t.tn - coalesce(k.tn, 0) AS tn
  FROM (SELECT DISTINCT dimension FROM cells WHERE NOT ({shown_rows})) c
  LEFT JOIN (SELECT dimension, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM known GROUP BY 1) k USING (dimension), t),
u AS (SELECT * FROM known UNION ALL SELECT * FROM rest),
s AS (SELECT dimension, segment, 'flagged' AS side, tp AS churners, fp AS stayers FROM u
  UNION ALL SELECT dimension, segment, 'left', fn, tn FROM u UNION ALL SELECT dimension, segment, 'whole', tp + fn, fp + tn FROM u)
SELECT dimension, segment, side, CAST(churners AS BIGINT) AS churners, CAST(stayers AS BIGINT) AS stayers FROM s WHERE NOT {keeps_sql('churners', 'stayers')}"""


@query(
    "g20_segment_union_audit",
    f"WITH {doc_cells_sql()}, {union_audit_sql('tp + fp + fn + tn >= 60')}",
    "docs",
)
def segment_union_audit(spark, folder):
    segments, cells, totals = doc_segments(spark, folder)
    # Published by size alone, as a careless report would.
    careless = segments.withColumn(
        "churners", F.when(F.col("customers") >= 60, F.col("churners"))
    )
    return D.segment_violations(careless, cells, totals)


@query(
    "g20_guarded_segments_give_nothing_away",
    f"WITH {doc_cells_sql()}, {union_audit_sql('FALSE')} AND segment <> '(hidden together)'",
    "docs",
)
def guarded_segments_audit(spark, folder):
    segments, cells, totals = doc_segments(spark, folder)
    found = D.segment_violations(D.guard_segments(segments, cells), cells, totals)
    # With a partition too small to keep the rule everything is hidden together.
    return found.where("segment <> '(hidden together)'")


EXTERNAL = """one AS (SELECT segment AS level, count(*) FILTER (partition_name = 'train') AS n,
  sum(churn) FILTER (partition_name = 'train') AS c, sum(churn) FILTER (partition_name = 'test') AS t, sum(churn) AS p,
  sum(churn) FILTER (partition_name = 'validation') AS v FROM book GROUP BY 1)"""


@query(
    "c16_cross_source_subtraction",
    f"""WITH {EXTERNAL} SELECT 'segment' AS dimension, level AS members, CAST(v AS BIGINT) AS churners FROM one WHERE level NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'segment', 'BUILDING|MACHINERY', CAST(sum(v) AS BIGINT) FROM one WHERE level IN ('BUILDING', 'MACHINERY')""",
    "book",
)
def cross_source_subtraction(spark, folder):
    rows = durable(book(spark, folder).select("segment", "partition_name", "churn"))
    by = rows.groupBy(F.lit("segment").alias("dimension"), F.col("segment").alias("level"))
    training = by.agg(F.sum(F.when(F.col("partition_name") == "train", F.col("churn"))).alias("churned")).withColumn(
        "churned", F.when(~F.col("level").isin("BUILDING", "MACHINERY"), F.col("churned"))
    )
    test = by.agg(F.sum(F.when(F.col("partition_name") == "test", F.col("churn"))).alias("churners"))
    population = by.agg(F.sum("churn").alias("churners"))
    total = rows.where("partition_name = 'train'").agg(F.sum("churn").alias("c"))
    return D.external_sets(training, total.scalar(), test, population)


@query(
    "c16_external_sets_that_break_the_rule",
    f"""WITH {EXTERNAL}, n AS (SELECT segment AS level, count(*) AS n FROM book WHERE partition_name = 'validation' GROUP BY 1)
SELECT 'segment' AS dimension, level AS members, CAST(v AS BIGINT) AS churners, n.n AS customers FROM one JOIN n USING (level)
WHERE NOT {keeps_sql('v', 'n.n - v')}""",
    "book",
)
def external_sets(spark, folder):
    rows = durable(book(spark, folder).select("segment", "partition_name", "churn"))
    by = rows.groupBy(F.lit("segment").alias("dimension"), F.col("segment").alias("level"))

    def count(partition: str, name: str):
        return by.agg(F.sum(F.when(F.col("partition_name") == partition, F.col("churn"))).alias(name))

    sets = D.external_sets(count("train", "churned"), 0, count("test", "churners"), by.agg(F.sum("churn").alias("churners")))
    sizes = by.agg(F.count_if(F.col("partition_name") == "validation").alias("customers"))
    return D.external_violations(sets, sizes)


# --- stored aggregates --------------------------------------------------------------------------------

OLD, NEW = (0.0, 0.05, 0.11, 0.2, 0.29, 0.41, 0.5), (0.0, 0.11, 0.29, 0.5)


@query(
    "c15_merged_reliability",
    """WITH c(low, high) AS (VALUES (0.0e0, 0.11e0), (0.11e0, 0.29e0), (0.29e0, 0.5e0), (0.5e0, 1.0e0)),
t AS (SELECT low, high, count(*) AS customers, avg(score) AS m, CAST(sum(returned) AS BIGINT) AS churned
  FROM lines JOIN c ON score >= low AND (score < high OR high = 1.0) GROUP BY 1, 2)
SELECT low, high, customers, round(m, 9) AS mean_predicted, churned, CAST(churned AS DOUBLE) / customers AS rate, TRUE AS aligned FROM t""",
    "lines",
)
def merged_reliability(spark, folder):
    bins = Q.reliability_on(lines(spark, folder), score="score", label="returned", cuts=OLD)
    return rounded(D.merged_reliability(bins, NEW), 9, "mean_predicted")


def stored(spark, folder):
    """A set of stored aggregates of the validation rows, read on three cuts."""
    rows = durable(validation(spark, folder).select("customer_id", "segment", "region", "score", "churn", "monthly_charges"))
    basis = durable(X.at_cuts(X.sweep_basis(rows, score="score", label="churn", amount="monthly_charges"), (0.0, 0.11, 0.29)))
    metrics = Q.with_rates(Q.confusion(rows, score="score", label="churn", threshold=0.11)).withColumn(
        "threshold", F.lit(0.11)
    )
    reliability = Q.reliability_on(rows, score="score", label="churn", cuts=(0.0, 0.11, 0.29))
    segments = Q.segment_performance(rows, ["segment", "region"], score="score", label="churn", threshold=0.11)
    return basis, metrics, reliability, segments


@query("c19_aggregate_integrity", 'SELECT \'x\' AS "check", \'x\' AS at FROM region WHERE FALSE')
def aggregate_integrity(spark, folder):
    basis, metrics, reliability, segments = stored(spark, folder)
    return D.integrity(basis=basis, metrics=metrics, reliability=reliability, segments=segments)


@query(
    "c19_integrity_finds_changed_figures",
    """SELECT 'the operating point is not the sweep at its cut' AS "check", '0.11' AS at FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'the bins are not the sweep''s intervals', '0.11' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'a dimension does not add up', 'region' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'a segment''s rate is not its counts''', 'ASIA' FROM region WHERE r_regionkey = 0""",
)
def integrity_changed(spark, folder):
    basis, metrics, reliability, segments = stored(spark, folder)
    n = F.col("customers")
    return D.integrity(
        basis=basis,
        metrics=metrics.withColumns({"fp": F.col("fp") + 1, "tn": F.col("tn") - 1}).drop(
            "accuracy", "precision", "recall", "f1"
        ).transform(Q.with_rates),
        reliability=reliability.withColumn("churned", F.when(F.col("low") == 0.11, F.col("churned") + 1).otherwise(F.col("churned"))),
        segments=segments.withColumn("customers", F.when(F.col("segment") == "ASIA", n + 1).otherwise(n)),
    )


@query("g21_republished_under_stricter_rules")
def republished(spark, folder):
    """Cuts restricted and bins merged, from the stored aggregates alone."""
    old = (0.0, 0.05, 0.11, 0.2, 0.29, 0.35, 0.41, 0.5, 0.55)
    basis = durable(X.at_cuts(lines_basis(spark, folder), old))
    bins = durable(Q.reliability_on(lines(spark, folder), score="score", label="returned", cuts=old))
    cuts = [r["threshold"] for r in D.safe_cuts(basis, required=(0.29,), minimum=1000).collect()]
    return D.merged_reliability(bins, sorted(cuts))


@query("g22_validation_on_safe_cuts")
def validation_on_safe_cuts(spark, folder):
    """Bins and guarded segments read on the safe cuts only, as one published table; nothing where
    no cut is safe."""
    rows = durable(docs(spark, folder))
    fine = X.sweep_basis(rows.withColumn("amount", F.lit(1)), score="score", label="toxic", amount="amount")
    # At most 101 thresholds: the cuts decide which plan reads the rows next.
    cuts = sorted(r["threshold"] for r in D.safe_cuts(fine, required=(), preferred=(0.5,)).collect())
    bins = Q.reliability_on(rows, score="score", label="toxic", cuts=cuts or [0.0])
    segments, cells, _ = doc_segments(spark, folder)
    guarded = D.guard_segments(segments, cells)
    published = bins.select(
        F.lit("score").alias("dimension"), F.concat_ws(" to ", F.round("low", 2).cast("string"), F.round("high", 2).cast("string")).alias("segment"),
        "customers", F.col("churned").alias("churners"),
    ).unionByName(guarded.select("dimension", "segment", "customers", "churners"))
    return published if cuts else published.limit(0)


@query("g23_publish_gate", 'SELECT \'x\' AS "check", \'x\' AS at FROM region WHERE FALSE')
def publish_gate(spark, folder):
    """Every reason not to publish the guarded tables and the safe sweep; nothing when there is none."""
    _, cells, total, _ = joint_tables(spark, folder)
    published = durable(cells.withColumn("before", F.col("churned").isNull()))
    again = J.guard_published(published.drop("reason"), total)
    hides_more = again.where(F.col("churned").isNull() & ~F.col("before")).select(
        F.lit("a table would hide more").alias("check"), J.node_of().alias("at")
    )
    fine = durable(lines_basis(spark, folder))
    basis = durable(D.basis_on(fine, D.safe_cuts(fine, required=(0.29,))))
    differenced = D.run_violations(D.facts(basis=basis)).select(
        F.lit("a group can be differenced").alias("check"), F.col("low").cast("string").alias("at")
    )
    return hides_more.unionByName(differenced).unionByName(D.integrity(basis=basis))


# --- publications ---------------------------------------------------------------------------------------

LINE_DIMENSIONS = ("l_linestatus", "ship_year", "quantity_band")


def offer_sql(cuts: str = "TRUE", minimum: int = 20) -> str:
    """``cuts_to_publish`` as SQL: the walk for each way to keep the peak and one half, the first
    that reaches the top.  Number 101 stands for the top, which every walk has to step to."""
    def enough(a: str, b: str) -> str:
        return f"{a}.tp - {b}.tp >= {minimum} AND {a}.fp - {b}.fp >= {minimum}"

    return f"""own AS (SELECT * FROM basis WHERE {cuts}),
worth AS (SELECT cut, threshold, 0.65e0 * 0.3e0 * 12 * flagged_churner_charges - 50 * (true_positives + false_positives) AS net FROM own),
best AS (SELECT cut AS peak FROM worth ORDER BY net DESC, threshold LIMIT 1),
pts AS (SELECT cut, true_positives AS tp, false_positives AS fp FROM own UNION ALL SELECT 101, 0, 0),
options AS (SELECT 0 AS o, [29, peak, 50, 101] AS stops FROM best UNION ALL SELECT 1, [29, peak, 101] FROM best
  UNION ALL SELECT 2, [29, 50, 101] UNION ALL SELECT 3, [29, 101]),
nxt AS (SELECT p.o, w.cut, min(b.cut) AS nx FROM options p, pts w, pts b, pts s
  WHERE s.cut = list_min(list_filter(p.stops, lambda x: x > w.cut)) AND b.cut > w.cut AND b.cut <= s.cut AND {enough('w', 'b')}
    AND (b.cut = s.cut OR ({enough('b', 's')})) GROUP BY p.o, w.cut),
walk AS (SELECT o, 0 AS cut FROM options UNION ALL SELECT nxt.o, nxt.nx FROM walk JOIN nxt ON nxt.o = walk.o AND nxt.cut = walk.cut),
kept AS (SELECT cut FROM walk WHERE cut < 101 AND o = (SELECT min(o) FROM walk WHERE cut = 101)),
cuts AS (SELECT b.*, coalesce(lead(b.threshold) OVER (ORDER BY b.cut), 1.0e0) AS high FROM own b JOIN kept USING (cut))"""


ON_CUTS = """SELECT c.threshold AS low, c.high, c.true_positives, c.false_positives, c.false_negatives,
  (SELECT count(*) FROM lines l WHERE l.score >= c.threshold AND (l.score < c.high OR c.high = 1)) AS customers,
  (SELECT CAST(sum(l.returned) AS BIGINT) FROM lines l WHERE l.score >= c.threshold AND (l.score < c.high OR c.high = 1)) AS churned
FROM cuts c"""


def on_cuts(publication: P.Publication):
    """A publication's sweep and bins side by side."""
    place = F.round(F.col("low") * 100).cast("int")
    bins = publication.reliability.select(place.alias("cut"), "low", "high", "customers", "churned")
    sums = publication.basis.select("cut", "true_positives", "false_positives", "false_negatives")
    return bins.join(sums, "cut").drop("cut")


def line_publication(spark, folder):
    rows = lines(spark, folder).withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return P.figures_on_safe_cuts(
        rows, LINE_DIMENSIONS, score="score", label="returned", amount="amount", id="line", threshold=0.29
    )


@query("g22_figures_on_safe_cuts", f"WITH RECURSIVE {LINES_BASIS}, {offer_sql()} {ON_CUTS}", "lines")
def figures_on_safe_cuts(spark, folder):
    """The sweep and its bins on the cuts that may be published beside the served one."""
    return on_cuts(line_publication(spark, folder))


OLD_CUTS = (0.0, 0.05, 0.11, 0.2, 0.29, 0.35, 0.41, 0.5, 0.55)


def old_publication(spark, folder):
    """What an earlier release, under looser rules, left behind: aggregates only."""
    basis = durable(X.at_cuts(lines_basis(spark, folder), OLD_CUTS))
    # The bins lie between the sweep's own thresholds, to the last bit.
    cuts = sorted(r["threshold"] for r in basis.select("threshold").collect())
    return P.Publication(
        basis=basis,
        reliability=durable(Q.reliability_on(lines(spark, folder), score="score", label="returned", cuts=cuts)),
    )


@query(
    "g21_republished_from_its_own_tables",
    f"WITH RECURSIVE {LINES_BASIS}, {offer_sql('cut IN (0, 5, 11, 20, 29, 35, 41, 50, 55)', 100)} {ON_CUTS}",
    "lines",
)
def republished_from_its_own_tables(spark, folder):
    """An old release under a stricter rule: cuts dropped and bins summed, from its own tables."""
    return on_cuts(P.republished(old_publication(spark, folder), threshold=0.29, minimum=100))


@query("g23_published_and_read_back", f"WITH RECURSIVE {LINES_BASIS}, {offer_sql()} {ON_CUTS}", "lines")
def published_and_read_back(spark, folder):
    """A publication through the gate: written, audited as written, committed, read by its commit."""
    path = scratch_path(spark, "publication")
    P.publish(spark, line_publication(spark, folder), path)
    return on_cuts(P.published(spark, path))


@query(
    "g23_refused_with_findings",
    f"""WITH {BASIS}, {runs_sql('0, 5, 6, 11, 29, 41')}
SELECT 'a group can be differenced' AS "check", CAST(low AS VARCHAR) AS at FROM v
UNION ALL SELECT 'the operating point is not the sweep at its cut', '0.11' FROM (SELECT 1 FROM book LIMIT 1)""",
    "book",
)
def refused_with_findings(spark, folder):
    """A sweep on cuts too close together, with a changed operating point: why it is not published."""
    rows = validation(spark, folder)
    cuts = (0.0, 0.05, 0.06, 0.11, 0.29, 0.41)
    metrics = Q.confusion(rows, score="score", label="churn", threshold=0.11).withColumns(
        {"fp": F.col("fp") + 1, "tn": F.col("tn") - 1, "threshold": F.lit(0.11)}
    )
    thin = P.Publication(basis=X.at_cuts(validation_basis(spark, folder), cuts), metrics=Q.with_rates(metrics))
    try:
        P.publish(spark, thin, scratch_path(spark, "publication"))
    except P.Refused as refused:
        return named_rows(spark, "check string, at string", refused.findings)
    return spark.createDataFrame([], "check string, at string")
