"""Suppression and audits against brute force on random small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scorebook.operators import disclosure as D
from scorebook.operators import economics as X
from scorebook.operators import joint as J
from scorebook.operators.tables import named_rows

MIN = 5


def keeps(c, s, minimum=MIN):
    return (c == 0 and s == 0) or (c >= minimum and s >= minimum)


# --- prefix guards --------------------------------------------------------------------------------------


def test_segment_guard_agrees_with_the_loop_on_random_dimensions(spark):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        for s in range(rng.randint(2, 6)):
            rows.append((f"d{d:02d}", f"s{s}", *(rng.randrange(14) for _ in range(4))))
    cells = named_rows(spark, "dimension string, segment string, tp bigint, fp bigint, fn bigint, tn bigint", rows)
    segments = cells.select("dimension", "segment", (F.col("tp") + F.col("fn")).alias("churners"))
    got = {
        (r["dimension"], r["segment"])
        for r in D.guard_segments(segments, cells, MIN).where("churners IS NULL").collect()
    }
    want = set()
    for d in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == d]

        def both(group):
            tp, fp, fn, tn = (sum(r[i] for r in group) for i in range(2, 6))
            return keeps(tp, fp) and keeps(fn, tn)

        hidden = [r for r in mine if not both([r])]
        shown = sorted((r for r in mine if r not in hidden), key=lambda r: (sum(r[2:]), r[1]))
        while hidden and not both(hidden) and shown:
            hidden.append(shown.pop(0))
        want |= {(r[0], r[1]) for r in hidden}
    assert got == want


def test_band_guard_hides_what_the_rest_gives_back(spark):
    bands = named_rows(
        spark, "name string, observed_customers bigint, observed_churned bigint",
        [("Low", 100, 10), ("Moderate", 60, 30), ("High", 40, 20), ("Critical", 8, 6)],
    )
    overall = named_rows(spark, "customers bigint, churned bigint", [(208, 66)])
    got = {r["name"]: r["observed_churned"] for r in D.guard_bands(bands, overall, MIN).collect()}
    # Critical has 2 stayers; with High the hidden rows hold 26 and 22.
    assert got == {"Low": 10, "Moderate": 30, "High": None, "Critical": None}


def test_one_way_guard_never_leaves_always_hidden_levels_alone(spark):
    cells = named_rows(
        spark, "rows string, cols string, row string, col string, customers bigint, churned bigint",
        [("plan", None, "a", None, 100, 40), ("plan", None, "b", None, 50, 20), ("plan", None, "c", None, 60, 30)],
    )
    got = {r["row"]: r["reason"] for r in D.guard_one_way(cells, hidden_levels={"plan": ("c",)}, minimum=MIN).collect()}
    assert got == {"a": None, "b": "withheld", "c": "cross_partition"}


# --- cuts -------------------------------------------------------------------------------------------------


def random_basis(spark, seed, cuts=12):
    rng = random.Random(seed)
    steps = [(rng.randrange(12), rng.randrange(12)) for _ in range(cuts)]
    rows = []
    for i in range(cuts):
        tp, fp = sum(s[0] for s in steps[i:]), sum(s[1] for s in steps[i:])
        rows.append((i, i * 0.01, tp, fp, sum(s[0] for s in steps) - tp, 0.0))
    schema = "cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    return rows, named_rows(spark, schema, rows)


def safe(rows, chosen):
    picked = [rows[i] for i in chosen]
    ends = picked[1:] + [(0, 0, 0, 0)]
    return all(a[2] - b[2] >= MIN and a[3] - b[3] >= MIN for a, b in zip(picked, ends, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_safe_cuts_are_the_most_that_keep_the_rule(spark, seed):
    rows, basis = random_basis(spark, seed)
    required = [0.04]
    got = sorted(r["threshold"] for r in D.safe_cuts(basis, required, minimum=MIN).collect())
    best = 0
    for size in range(len(rows), 0, -1):
        options = [c for c in itertools.combinations(range(1, len(rows)), size - 1) if 4 in c]
        if any(safe(rows, (0, *c)) for c in options):
            best = size
            break
    assert len(got) == best
    if got:
        assert got[0] == 0.0 and 0.04 in got
        assert safe(rows, [round(t * 100) for t in got])
        assert D.holds(D.basis_on(basis, named_rows(spark, "threshold double", [(t,) for t in got])), MIN).first()[0]


def test_a_preferred_cut_that_does_not_fit_is_dropped_alone(spark):
    # Steps of ten each at 0.00 .. 0.03, then one too thin above 0.04.
    rows = [(i, i * 0.01, 42 - 10 * i, 42 - 10 * i, 10 * i, 0.0) for i in range(5)]
    schema = "cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    basis = named_rows(spark, schema, rows)
    got = sorted(r[0] for r in D.safe_cuts(basis, (0.01,), (0.04, 0.03), minimum=MIN).collect())
    assert got == [0.0, 0.01, 0.02, 0.03]


def test_no_cuts_where_none_keep_the_rule(spark):
    _, basis = random_basis(spark, 1)
    assert D.safe_cuts(basis, (), minimum=10**6).isEmpty()
    assert D.safe_cuts(basis, (0.555,), minimum=1).isEmpty()


def test_stated_thresholds_forbid_thin_steps(spark):
    rows = [(i, i * 0.01, 100 - 10 * i, 100 - 10 * i, 10 * i, 0.0) for i in range(10)]
    schema = "cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    basis = named_rows(spark, schema, rows)
    # Just above 0.05: a cut there would leave a piece of at most two rows.
    stated = named_rows(spark, "threshold double, flagged bigint, low bigint, high bigint", [(0.05, 96, 47, 49)])
    cuts = D.safe_cuts(basis, minimum=MIN, forbidden=D.forbidden_steps(basis, stated, MIN))
    got = sorted(round(r[0], 2) for r in cuts.collect())
    assert D.legacy_holds(D.basis_on(basis, cuts), stated, MIN).first()[0]
    assert len(got) > 2
    # At an own cut the own counts are exact, whatever is stated there.
    same = named_rows(spark, "threshold double, flagged bigint, low bigint, high bigint", [(0.05, 90, 40, 41)])
    assert D.legacy_holds(X.at_cuts(basis, [0.0, 0.04, 0.05, 0.06]), same, MIN).first()[0]


@pytest.mark.parametrize("at", [0.045, 0.041, 0.0499])
def test_stated_thresholds_off_the_grid(spark, at):
    rows = [(i, i * 0.01, 100 - 10 * i, 100 - 10 * i, 10 * i, 0.0) for i in range(10)]
    schema = "cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    basis = named_rows(spark, schema, rows)
    # Two rows of each outcome lie between the stated threshold and the cut at 0.05.
    stated = named_rows(spark, "threshold double, flagged bigint, low bigint, high bigint", [(at, 104, 52, 52)])
    steps = D.forbidden_steps(basis, stated, MIN)
    assert {(round(r[0], 2), r[1] and round(r[1], 2)) for r in steps.collect()} >= {(0.04, 0.05), (0.03, 0.05)}
    cuts = D.safe_cuts(basis, minimum=MIN, forbidden=steps)
    got = sorted(round(r[0], 2) for r in cuts.collect())
    assert 0.05 not in got and len(got) > 2
    assert D.legacy_holds(D.basis_on(basis, cuts), stated, MIN).first()[0]
    assert not D.legacy_holds(X.at_cuts(basis, [0.0, 0.04, 0.05, 0.06]), stated, MIN).first()[0]


def plain_step(cuts, stated, i, j):
    """Whether the pieces between two cuts (the top is None) keep the rule, edge by edge."""
    low, high = cuts[i][0], None if j is None else cuts[j][0]
    exact = {c[0]: (c[1] + c[2], c[1], c[1]) for c in cuts}
    inner = [s for s in sorted(stated) if s[0] > low + 1e-9 and (high is None or s[0] < high - 1e-9)]
    edges = [(low, *exact[low]), *inner, (None, 0, 0, 0) if high is None else (high, *exact[high])]
    for a, b in itertools.pairwise(edges):
        churners, stayers = a[2] - b[3], (a[1] - a[3]) - (b[1] - b[2])
        own = (a[0] == low and low != 0.0) or (b[0] is not None and b[0] == high)
        if min(churners, stayers) < MIN and own:
            return False
    return True


def test_many_books_are_cut_beside_their_own_stated_thresholds(spark):
    rng = random.Random(41)
    basis, stated, plain = [], [], {}
    for seed in range(50):
        tp, fp, cuts, points = 0, 0, [], []
        for k in reversed(range(12)):
            if rng.random() < 0.5:
                exact = (tp + rng.randint(0, 9), fp + rng.randint(0, 9))
                slack = rng.choice([0, 0, 1, 3])
                at = 0.01 * k + rng.choice([0.0051, 0.0001, 0.01 - 1e-10, 0.0099])
                points.append((at, sum(exact), max(exact[0] - slack, 0), min(exact[0] + slack, sum(exact))))
                tp, fp = exact
            tp, fp = tp + rng.randint(0, 12), fp + rng.randint(0, 12)
            cuts.append((0.01 * k, tp, fp))
        cuts.sort()
        basis += [(seed, i, t, a, b, tp - a, 0.0) for i, (t, a, b) in enumerate(cuts)]
        stated += [(seed, *p) for p in points]
        plain[seed] = (cuts, points)
    schema = "seed int, cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    books = named_rows(spark, schema, basis)
    known = named_rows(spark, "seed int, threshold double, flagged bigint, low bigint, high bigint", stated)
    steps = D.forbidden_steps(books, known, MIN, keys=["seed"])
    got = {(r["seed"], r["low"], r["high"]) for r in steps.collect()}
    want = set()
    for seed, (cuts, points) in plain.items():
        for i in range(len(cuts)):
            for j in [*range(i + 1, len(cuts)), None]:
                if not plain_step(cuts, points, i, j):
                    want.add((seed, cuts[i][0], None if j is None else cuts[j][0]))
    assert got == want
    chosen = D.safe_cuts(books, minimum=MIN, forbidden=steps, keys=["seed"])
    held = D.legacy_holds(D.basis_on(books, chosen, ["seed"]), known, MIN, keys=["seed"]).collect()
    assert len(held) > 20 and all(r["holds"] for r in held)
    free = D.basis_on(books, D.safe_cuts(books, minimum=MIN, keys=["seed"]), ["seed"])
    assert not all(r["holds"] for r in D.legacy_holds(free, known, MIN, keys=["seed"]).collect())


@pytest.mark.parametrize("tp", [3, 40, 77])
def test_count_ranges_hold_the_true_count(spark, tp):
    flagged, positives = 100, 90
    points = named_rows(
        spark, "threshold double, flagged bigint, precision double, recall double",
        [(0.3, flagged, round(tp / flagged, 2), round(tp / positives, 2))],
    )
    row = D.churner_range(points, F.lit(positives)).first()
    fits = [
        k for k in range(0, 91)
        if abs(k / flagged - round(tp / flagged, 2)) <= 0.005 + 1e-9
        and abs(k / positives - round(tp / positives, 2)) <= 0.005 + 1e-9
    ]
    assert (row["low"], row["high"]) == (fits[0], fits[-1]) and row["low"] <= tp <= row["high"]


# --- release ------------------------------------------------------------------------------------------------


def test_one_table_is_released_whole_or_not_at_all(spark):
    schema = "threshold double, n bigint, positives bigint, tn bigint, fp bigint, fn bigint, tp bigint"
    df = named_rows(
        spark, schema,
        [(0.36, 1409, 374, 822, 213, 111, 263), (0.5, 60, 21, 20, 19, 1, 20), (0.5, 61, 21, 20, 19, 1, 20)],
    )
    good, thin, wrong = D.released(df).collect()
    assert (good["precision"], good["recall"], good["f1"], good["accuracy"]) == (0.5525, 0.7032, 0.6188, 0.77)
    assert thin["adds_up"] and not thin["published"] and thin["tp"] is None
    assert not wrong["adds_up"] and wrong["n"] is None


# --- joint guard ---------------------------------------------------------------------------------------------


def population(spark, seed, n=160):
    """Rows with three dimensions; ``b`` lies inside a level of ``a`` for some seeds."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.choice(["a0", "a1", "a2"])
        b = "b0" if a == "a0" and seed % 2 else rng.choice(["b1", "b2", "b3"])
        rows.append((a, b, rng.choice(["c0", "c1"]), int(rng.random() < 0.45)))
    levels = {"a": ("a0", "a1", "a2"), "b": ("b0", "b1", "b2", "b3"), "c": ("c0", "c1")}
    return rows, levels, spark.createDataFrame(rows, "a string, b string, c string, y int")


def guarded_population(spark, seed):
    from scorebook.operators import segments as S
    from scorebook.session import durable

    rows, levels, df = population(spark, seed)
    found = durable(S.breakdown_counts(df, list(levels), label="y"))
    cells = durable(S.dense(found, S.level_grid(spark, levels)))
    one = D.guard_one_way(cells.where("cols IS NULL"), minimum=MIN)
    hidden = one.where(F.col("reason").isNotNull()).select("rows", "row", F.lit(True).alias("h"))
    start = cells.join(hidden, ["rows", "row"], "left")
    unknown = F.col("cols").isNull() & F.coalesce("h", F.lit(False)) & (F.col("customers") > 0)
    start = durable(start.withColumn("churned", F.when(~unknown, F.col("churned"))).drop("h"))
    total = S.total_of(found)
    settled = J.guard(J.system_of(start, total, minimum=MIN), minimum=MIN)
    return rows, cells, total, settled




@pytest.mark.parametrize("seed", [0, 1])
def test_joint_guard_keeps_every_line_and_bound(spark, seed):
    rows, cells, total, settled = guarded_population(spark, seed)
    truth = {r["node"]: (r["customers"], r["churned"]) for r in cells.select(J.node_of().alias("node"), "customers", "churned").collect()}
    hidden = {r["node"] for r in settled.nodes.where("hidden").collect()}
    # Every shown group keeps the rule.
    for node, (n, c) in truth.items():
        if n and node not in hidden:
            assert keeps(c, n - c), node
    # Of every line with a shown total, the hidden members together keep the rule.
    lines = {}
    for r in settled.lines.collect():
        lines.setdefault((r["line"], r["total"]), []).append(r["node"])
    for (line, tot), members in lines.items():
        inside = [m for m in members if m in hidden]
        if inside and tot not in hidden:
            n = sum(truth[m][0] for m in inside)
            c = sum(truth[m][1] for m in inside)
            assert keeps(c, n - c), line
    # Bounds hold the truth, and fix no hidden count that breaks the rule.
    audit = J.bounds(settled)
    for r in audit.where("hidden").collect():
        n, c = truth[r["node"]]
        assert r["lo"] <= c <= r["hi"] <= n
        if r["lo"] == r["hi"]:
            assert keeps(c, n - c)
    # The same members are hidden under every name.
    for r in settled.same.collect():
        assert (r["a"] in hidden) == (r["b"] in hidden)


def test_guard_again_changes_nothing_and_twins_agree(spark):
    rows, cells, total, settled = guarded_population(spark, 1)
    published = J.guarded_cells(cells, settled, minimum=MIN)
    again = J.guard_published(published.drop("reason"), total, minimum=MIN)
    before = {tuple(r) for r in published.select("rows", "cols", "row", "col", "churned").collect()}
    after = {tuple(r) for r in again.select("rows", "cols", "row", "col", "churned").collect()}
    assert before == after


def test_bounds_find_a_count_a_margin_gives_back(spark):
    """Two hidden cells in a row whose margin holds every member as churned."""
    schema = "rows string, cols string, row string, col string, customers bigint, churned bigint"
    cells = named_rows(
        spark, schema,
        [
            ("a", None, "x", None, 10, 10), ("a", None, "y", None, 90, 40),
            ("b", None, "u", None, 60, 30), ("b", None, "v", None, 40, 20),
            ("a", "b", "x", "u", 6, None), ("a", "b", "x", "v", 4, None),
            ("a", "b", "y", "u", 54, None), ("a", "b", "y", "v", 36, None),
        ],
    )
    total = named_rows(spark, "customers bigint, churned bigint", [(100, 50)])
    system = J.system_of(cells, total, minimum=1)
    state = {r["node"]: (r["lo"], r["hi"]) for r in J.bounds(system).collect()}
    # With the margin x shown, "all of them churned" fixes both cells, and then the other row.
    shown = J.System(
        system.nodes.withColumn("c", F.when(F.col("node") == "m|a|x", 10).otherwise(F.col("c"))).withColumn(
            "hidden", F.when(F.col("node") == "m|a|x", False).otherwise(F.col("hidden"))
        ),
        system.lines, system.same, system.inside,
    )
    fixed = {r["node"]: (r["lo"], r["hi"]) for r in J.bounds(shown).collect()}
    assert fixed["c|a|x|b|u"] == (6, 6) and fixed["c|a|x|b|v"] == (4, 4)
    assert fixed["c|a|y|b|u"] == (24, 24)
    assert state["m|a|x"][0] <= 10 <= state["m|a|x"][1]


def test_unprotectable_is_said(spark):
    """A single level as large as the partition cannot be hidden from its own total."""
    schema = "rows string, cols string, row string, col string, customers bigint, churned bigint"
    cells = named_rows(spark, schema, [("a", None, "x", None, 10, 1)])
    total = named_rows(spark, "customers bigint, churned bigint", [(10, 1)])
    with pytest.raises(J.Unprotectable):
        J.guard(J.system_of(cells, total, minimum=MIN), minimum=MIN)


def test_published_medians_bound_the_buckets(spark):
    schema = "rows string, cols string, row string, col string, customers bigint, churned bigint"
    cells = named_rows(
        spark, schema,
        [("t", None, "0-3", None, 30, None), ("t", None, "4-6", None, 30, None), ("t", None, "7-12", None, 40, None)],
    )
    total = named_rows(spark, "customers bigint, churned bigint", [(100, 40)])
    system = J.system_of(cells, total, minimum=MIN)
    capped = J.median_caps(
        system, "t", ("0-3", "4-6", "7-12"), (-1, 3, 6, 12), churned=9.0, stayed=2.0, customers=100, churners=40
    )
    free = {r["node"]: (r["lo"], r["hi"]) for r in J.bounds(system).collect()}
    held = {r["node"]: (r["lo"], r["hi"]) for r in J.bounds(capped).collect()}
    assert held["m|t|7-12"][0] >= 20 > free["m|t|7-12"][0]
    assert held["m|t|0-3"][1] <= 20


def test_many_single_steps_are_found_by_few_searches(spark, monkeypatch):
    """``t0`` is fixed by a group around it, far along a line whose counts go cheapest first."""
    written, write = [], J.settled

    def counted(df):
        written.append(1)
        assert len(written) <= 60
        return write(df)

    monkeypatch.setattr(J, "settled", counted)
    levels, far = 24, 20
    sizes = {f"u{k:02}": (100 + k, 50) for k in range(levels)}
    big = f"u{far}"
    n_big = sizes[big][0]
    sizes[big] = (n_big, n_big - 25)
    n, c = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    first = ("u00", "u01")
    nodes = [("total", n, c, False, True, False), ("t0", 40, None, True, True, False), ("t1", n - 40, None, True, True, False)]
    nodes += [(u, m, None if u in first else k, u in first, True, False) for u, (m, k) in sizes.items()]
    system = J.System(
        named_rows(spark, "node string, n bigint, c bigint, hidden boolean, margin boolean, alone boolean", nodes),
        named_rows(
            spark, "line string, node string, total string",
            [("t", t, "total") for t in ("t0", "t1")] + [("u", u, "total") for u in sizes],
        ),
        named_rows(spark, "a string, b string", []),
        named_rows(spark, "small string, large string, gap bigint", [("t0", big, n_big - 40)]),
        named_rows(spark, "cap string, node string, bound bigint, upper boolean", [("below", "t0", 15, True)]),
    )
    settled = J.guard(system, minimum=20)
    # No count dearer than the one that fixed it goes, and none cheaper stays.
    assert {r["node"] for r in settled.nodes.where("hidden").collect()} == {"t0", "t1"} | {u for u in sizes if u <= big}
    assert settled.nodes.where("hidden AND c IS NOT NULL").count() == 0


# --- audits -----------------------------------------------------------------------------------------------------


def test_runs_between_cuts_are_audited(spark):
    rows = [(0, 0.0, 100, 100, 0, 0.0), (10, 0.1, 97, 60, 3, 0.0), (50, 0.5, 40, 30, 60, 0.0)]
    schema = "cut int, threshold double, true_positives bigint, false_positives bigint, false_negatives bigint, flagged_churner_charges double"
    found = D.run_violations(D.facts(basis=named_rows(spark, schema, rows)), MIN).collect()
    assert [(r["low"], r["high"], r["outcome"], r["value"]) for r in found] == [(0.0, 0.1, "churned", 3)]


def test_hidden_segments_are_audited_together(spark):
    cells = named_rows(
        spark, "dimension string, segment string, tp bigint, fp bigint, fn bigint, tn bigint",
        [("d", "a", 20, 20, 20, 20), ("d", "b", 2, 9, 9, 9), ("d", "c", 2, 9, 9, 9)],
    )
    totals = named_rows(spark, "tp bigint, fp bigint, fn bigint, tn bigint", [(24, 38, 38, 38)])
    segments = named_rows(spark, "dimension string, segment string, churners bigint", [("d", "a", 40), ("d", "b", None), ("d", "c", None)])
    found = D.segment_violations(segments, cells, totals, MIN).collect()
    assert {(r["segment"], r["side"]) for r in found} == {("(hidden together)", "flagged")}
