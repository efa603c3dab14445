"""Every published breakdown guarded as one system.

One- and two-way tables add to each other: cells add up to margins, the same members appear under
several names, and one group inside another makes their difference a group of its own.  The system
is four small tables - nodes (published counts), lines (a total and its members), pairs of nodes
with the same members, and pairs where one lies inside the other.  Their size is set by the declared
levels.  ``guard`` hides further counts round by round until no line, pair or bound gives one away.

What is guaranteed: each line's hidden counts together keep the rule, hidden members are hidden
under every name, differences of nested groups keep the rule, and interval bounds (the "shuttle"
method, Buzzigoli and Giusti 1999) fix no hidden count that breaks it.  An exact integer solver may
still find a combination of lines that these do not; that is weaker, and not claimed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions.fixed import MIN_CELL
from scorebook.operators.disclosure import crossed, reason_of
from scorebook.operators.segments import nesting
from scorebook.operators.tables import named_rows
from scorebook.session import durable


class Unprotectable(ValueError):
    """Nothing published is left to hide and a group can still be worked out."""


@dataclass(frozen=True)
class System:
    """The published tables as an outsider reads them."""

    nodes: DataFrame  # node, n, c (null when hidden), hidden, margin, alone
    lines: DataFrame  # line, node (a member), total (node)
    same: DataFrame  # a, b
    inside: DataFrame  # small, large, gap
    caps: DataFrame | None = None  # cap, node, bound, upper


TOTAL = "total"


def settled(df: DataFrame) -> DataFrame:
    """A table of the system, written; small partitions are merged by the adaptive plan."""
    return durable(df)


def node_of(rows: str = "rows", row: str = "row", cols: str = "cols", col: str = "col") -> Column:
    one = F.concat_ws("|", F.lit("m"), rows, row)
    two = F.concat_ws("|", F.lit("c"), rows, row, cols, col)
    return F.when(F.col(cols).isNull(), one).otherwise(two)


def margin_node(dimension: str, level: str) -> Column:
    return F.concat_ws("|", F.lit("m"), dimension, level)


def system_of(
    cells: DataFrame,
    total: DataFrame,
    *,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
    minimum: int = MIN_CELL,
    joint: bool = True,
) -> System:
    """The system of dense one- and two-way cells.

    ``cells`` is (rows, cols, row, col, customers, churned) with ``churned`` null where a count is
    already hidden; ``total`` one row (customers, churned).  A count is hidden from the start
    where it is unknown or its own group breaks the rule.  ``joint=False`` leaves out what other
    tables and names give away.
    """
    spark = cells.sparkSession
    alone = crossed(hidden_levels or {})
    n, c = F.col("customers"), F.col("churned")
    hidden = (n > 0) & (c.isNull() | alone | ~E.two_sided(c, n - c, minimum))
    based = settled(
        cells.select(
            "rows", "row", "cols", "col", "customers", "churned",
            node_of().alias("node"), hidden.alias("hidden"), alone.alias("alone"),
        )
    )
    whole = total.select(
        F.lit(TOTAL).alias("node"), F.col("customers").alias("n"), F.col("churned").alias("c"),
        F.lit(False).alias("hidden"), F.lit(True).alias("margin"), F.lit(False).alias("alone"),
    )
    nodes = based.where("customers > 0").select(
        "node", F.col("customers").alias("n"), F.when(~F.col("hidden"), c).alias("c"),
        "hidden", F.col("cols").isNull().alias("margin"), "alone",
    )
    two = based.where("cols IS NOT NULL AND customers > 0")
    one = based.where("cols IS NULL AND customers > 0")
    lines = (
        two.select(
            F.concat_ws("|", "rows", "row", "cols").alias("line"), "node",
            margin_node("rows", "row").alias("total"),
        )
        .unionByName(
            two.select(
                F.concat_ws("|", "cols", "col", "rows").alias("line"), "node",
                margin_node("cols", "col").alias("total"),
            )
        )
        .unionByName(one.select(F.col("rows").alias("line"), "node", F.lit(TOTAL).alias("total")))
    )
    pair = "a string, b string"
    nest = "small string, large string, gap bigint"
    if not joint:
        empty = System(nodes.unionByName(whole), lines, named_rows(spark, pair, []), named_rows(spark, nest, []))
        return written(empty)
    related = nesting(based.select("rows", "row", "cols", "col", "customers", "churned"))
    row_first = F.col("relation").isin("same", "row inside col")
    oriented = related.select(
        F.when(row_first, F.col("rows")).otherwise(F.col("cols")).alias("sd"),
        F.when(row_first, F.col("row")).otherwise(F.col("col")).alias("sl"),
        F.when(row_first, F.col("cols")).otherwise(F.col("rows")).alias("ld"),
        F.when(row_first, F.col("col")).otherwise(F.col("row")).alias("ll"),
        F.abs(F.col("n_row") - F.col("n_col")).alias("gap"),
    )
    margins = oriented.select(
        margin_node("sd", "sl").alias("small"), margin_node("ld", "ll").alias("large"), "gap"
    )
    # A cell as large as one of its margins is that margin.
    sizes = one.select(F.col("rows").alias("d"), F.col("row").alias("l"), F.col("customers").alias("m"), F.col("node").alias("margin"))
    cell_margin = None
    for d, l in (("rows", "row"), ("cols", "col")):
        part = (
            two.join(sizes, (F.col(d) == F.col("d")) & (F.col(l) == F.col("l")))
            .where(F.col("customers") == F.col("m"))
            .select(F.col("node").alias("a"), F.col("margin").alias("b"))
        )
        cell_margin = part if cell_margin is None else cell_margin.unionByName(part)
    # In every third dimension, the smaller group's cell lies inside the larger one's.
    sides = two.select(
        F.col("rows").alias("d"), F.col("row").alias("l"), F.col("cols").alias("x"),
        F.col("col").alias("k"), "node", F.col("customers").alias("m"),
    ).unionByName(
        two.select(
            F.col("cols").alias("d"), F.col("col").alias("l"), F.col("rows").alias("x"),
            F.col("row").alias("k"), "node", F.col("customers").alias("m"),
        )
    )
    small = sides.withColumnsRenamed({"d": "sd", "l": "sl", "node": "small", "m": "ms"})
    large = sides.withColumnsRenamed({"d": "ld", "l": "ll", "node": "large", "m": "ml"})
    thirds = (
        oriented.drop("gap").join(small, ["sd", "sl"]).join(large, ["ld", "ll", "x", "k"])
        .where((F.col("x") != F.col("ld")) & (F.col("x") != F.col("sd")))
        .select("small", "large", (F.col("ml") - F.col("ms")).alias("gap"))
    )
    every = margins.unionByName(thirds).where(F.col("small") != F.col("large")).distinct()
    same = cell_margin.unionByName(
        every.where("gap = 0").select(F.col("small").alias("a"), F.col("large").alias("b"))
    )
    both = same.unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inside = every.where("gap > 0")
    # Groups inside an always-hidden one are always hidden too.
    inner = inside.join(
        nodes.where("alone").select(F.col("node").alias("large")), "large", "left_semi"
    ).select(F.col("small").alias("node"), F.lit(True).alias("__in")).distinct()
    nodes = (
        nodes.join(inner, "node", "left")
        .withColumn("alone", F.col("alone") | F.coalesce("__in", F.lit(False)))
        .drop("__in")
    )
    return written(System(nodes.unionByName(whole), lines, both, inside))


def written(s: System) -> System:
    return replace(
        s, nodes=settled(s.nodes), lines=settled(s.lines), same=settled(s.same), inside=settled(s.inside)
    )


def median_caps(
    system: System,
    dimension: str,
    labels: Sequence[str],
    edges: Sequence[float],
    *,
    churned: float | None,
    stayed: float | None,
    customers: int,
    churners: int,
) -> System:
    """What published medians add: at most half of an outcome lies strictly below its median, and
    at most half strictly above.  Values are whole, so a bucket ``(low, high]`` starts at ``low + 1``."""
    rows = []
    stayers = customers - churners
    for name, median, size in (("churned", churned, churners), ("stayed", stayed, stayers)):
        if median is None:
            continue
        below = [l for k, l in enumerate(labels) if edges[k + 1] < median]
        above = [l for k, l in enumerate(labels) if edges[k] + 1 > median]
        for side, chosen in (("below", below), ("above", above)):
            rows += [
                (f"{name} {side}", f"m|{dimension}|{l}", size // 2, name == "churned") for l in chosen
            ]
    spark = system.nodes.sparkSession
    return replace(system, caps=named_rows(spark, "cap string, node string, bound bigint, upper boolean", rows))


# --- rounds -------------------------------------------------------------------------------------------

#: Rounds, and sweeps of the bounds, that one written table holds: what comes after the last one
#: that moves something changes nothing.
ROUNDS = 2
SWEEPS = 6
#: The terms are few, as levels are, and a shuffle into many partitions costs more than its rows:
#: some partitions at least, and one more for so many terms.
PARTS, TERMS_IN_A_PART = 4, 20_000

#: Extents of further hiding that are tried at once, and single steps between two such searches.
TRIALS = 8
STEPS = 8


def per_rule() -> WindowSpec:
    return Window.partitionBy("trial", "on")


def per_count() -> WindowSpec:
    return Window.partitionBy("trial", "node")


def terms_of(system: System) -> DataFrame:
    """Every count under each rule it takes part in, with what is known of it.

    A rule (``on``) holds ``low <= sum(sign * count) <= high``: a line is its members less their
    total, twins and nested groups are differences of two, a cap bounds a sum.  Each count also
    stands alone once (``kind`` own).  A round is then two windows over one small table: over the
    terms of a rule, and over the terms of a count.
    """
    bound = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def rows(df: DataFrame, kind: str, key: Column, node: str, sign: int, low: Column, high: Column) -> DataFrame:
        return df.select(
            F.concat_ws("|", F.lit(kind), key).alias("on"), F.lit(kind).alias("kind"), F.col(node).alias("node"),
            F.lit(sign).alias("sign"), low.alias("low"), high.alias("high"), F.lit(0).alias("trial"),
        )

    totals = system.lines.select("line", "total").distinct()
    pairs = system.same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pair, nest = F.concat_ws(" ", "a", "b"), F.concat_ws(" ", "small", "large")
    parts = [
        rows(system.lines, "line", F.col("line"), "node", 1, zero, zero),
        rows(totals, "line", F.col("line"), "total", -1, zero, zero),
        rows(pairs, "same", pair, "a", 1, zero, zero),
        rows(pairs, "same", pair, "b", -1, zero, zero),
        rows(system.inside, "inside", nest, "large", 1, zero, F.col("gap")),
        rows(system.inside, "inside", nest, "small", -1, zero, F.col("gap")),
        rows(system.nodes, "own", F.col("node"), "node", 1, bound, bound),
    ]
    if system.caps is not None:
        sized = system.caps.join(system.nodes.select("node", "n"), "node").withColumn(
            "sn", F.sum("n").over(Window.partitionBy("cap"))
        )
        upper, least = F.col("upper"), F.col("sn") - F.col("bound")
        parts.append(
            rows(sized, "cap", F.col("cap"), "node", 1, F.when(~upper, least), F.when(upper, F.col("bound")))
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # A rule of which one side is not published says nothing.
    found = found.join(system.nodes, "node")
    whole = F.col("kind").isin("own", "cap") | ((F.max("sign").over(per_rule()) > 0) & (F.min("sign").over(per_rule()) < 0))
    return settled(found.withColumn("__whole", whole).where("__whole").drop("__whole"))


def parts_of(terms: DataFrame) -> int:
    """Partitions that a round spreads the terms over."""
    return PARTS + terms.count() // TERMS_IN_A_PART


def with_broken(terms: DataFrame, minimum: int) -> DataFrame:
    """``broken``: the line gives its hidden counts away together."""
    member, hidden = F.col("sign") > 0, F.col("hidden")
    total = ~member
    known = terms.withColumns(
        {
            "__sn": F.sum(F.when(member & ~hidden, F.col("n")).otherwise(0)).over(per_rule()),
            "__sc": F.sum(F.when(member & ~hidden, F.col("c")).otherwise(0)).over(per_rule()),
            "__hidden": F.count_if(member & hidden).over(per_rule()),
            "__alone": F.count_if(member & hidden & F.col("alone")).over(per_rule()),
            "__tn": F.max(F.when(total, F.col("n"))).over(per_rule()),
            "__tc": F.max(F.when(total, F.col("c"))).over(per_rule()),
            "__th": F.count_if(total & hidden).over(per_rule()) > 0,
            "__ta": F.count_if(total & F.col("alone")).over(per_rule()) > 0,
        }
    )
    sn, sc = F.col("__sn"), F.col("__sc")
    rest_n, rest_c = F.col("__tn") - sn, F.col("__tc") - sc
    # A shown total gives the hidden members' sum; a hidden total with every member shown is
    # itself their sum.
    by_total = (
        ~F.col("__th") & (F.col("__hidden") > 0)
        & (~E.two_sided(rest_c, rest_n - rest_c, minimum) | (F.col("__alone") == F.col("__hidden")))
    )
    by_members = (
        F.col("__th") & (F.col("__hidden") == 0) & (~E.two_sided(sc, sn - sc, minimum) | F.col("__ta"))
    )
    broken = (F.col("kind") == "line") & F.coalesce(by_total | by_members, F.lit(False))
    return known.withColumn("broken", broken).drop(
        "__sn", "__sc", "__hidden", "__alone", "__tn", "__tc", "__th", "__ta"
    )


def smallest_shown(hide_margins: bool) -> Column:
    """Whether a term is what its line hides next: the smallest shown member, or with
    ``hide_margins`` the total where no member is left."""
    total = F.col("sign") < 0
    open_ = ~total | (F.lit(hide_margins) & (F.col("node") != TOTAL))
    order = F.struct(total.alias("rank"), F.col("margin"), F.col("n"), F.col("node"))
    first = F.min(F.when((F.col("kind") == "line") & ~F.col("hidden") & open_, order)).over(per_rule())
    return (F.col("kind") == "line") & F.coalesce(F.col("node") == first["node"], F.lit(False))


def hidden_more(terms: DataFrame, chosen: str, parts: int) -> DataFrame:
    """The counts ``chosen`` under any rule hidden under all; ``more`` marks them."""
    terms = terms.repartition(parts, "trial", "node")
    more = F.bool_or(F.col(chosen) & ~F.col("hidden") & (F.col("node") != TOTAL)).over(per_count())
    out = terms.withColumn("more", more)
    return out.withColumns({"hidden": F.col("hidden") | F.col("more"), "c": F.when(~F.col("more"), F.col("c"))})


def hiding_round(
    terms: DataFrame, minimum: int, hide_margins: bool, parts: int, within: Column | None = None
) -> DataFrame:
    """One round: what breaks the rule now is hidden, and what lies ``within`` on a line with a
    hidden count."""
    terms = with_broken(terms.repartition(parts, "trial", "on"), minimum)
    hidden = F.count_if("hidden").over(per_rule())
    # The same members are hidden under every name.
    twins = (F.col("kind") == "same") & (hidden > 0)
    # A difference of two shown nested groups must keep the rule: the smaller one goes.
    gap_c = F.sum(F.col("sign") * F.col("c")).over(per_rule())
    keeps = E.two_sided(gap_c, F.col("high") - gap_c, minimum)
    gaps = (F.col("kind") == "inside") & (F.col("sign") < 0) & (hidden == 0) & ~F.coalesce(keeps, F.lit(True))
    by_line = F.col("broken") & smallest_shown(hide_margins)
    chosen = twins | gaps | by_line
    if within is not None:
        open_ = (F.col("sign") > 0) | F.lit(hide_margins)
        chosen = chosen | ((F.col("kind") == "line") & (hidden > 0) & open_ & within)
    return hidden_more(terms.withColumn("__chosen", chosen), "__chosen", parts).drop("__chosen")


def rounds_done(terms: DataFrame, minimum: int, hide_margins: bool, parts: int) -> DataFrame:
    """Rounds until one hides nothing.  Raises ``Unprotectable`` for a line left broken."""
    while True:
        for _ in range(ROUNDS):
            terms = hiding_round(terms.drop("more", "broken"), minimum, hide_margins, parts)
        terms = settled(terms)
        found = terms.agg(F.bool_or("more").alias("more"), F.min(F.when(F.col("broken"), F.col("on"))).alias("line")).first()
        if found["more"]:
            continue
        if found["line"] is not None:
            raise Unprotectable(f"nothing is left to hide on line {found['line'].removeprefix('line|')}")
        return terms.drop("more", "broken")


def bounded(terms: DataFrame, parts: int) -> DataFrame:
    """``terms`` with the tightest interval (``lo``, ``hi``) of each count, by passing bounds
    along every rule until nothing moves."""
    state = terms.withColumns(
        {
            "lo": F.when(F.col("hidden"), F.lit(0)).otherwise(F.col("c")).cast("bigint"),
            "hi": F.when(F.col("hidden"), F.col("n")).otherwise(F.col("c")).cast("bigint"),
        }
    )
    added = F.col("sign") > 0
    least, most = F.when(added, F.col("lo")).otherwise(-F.col("hi")), F.when(added, F.col("hi")).otherwise(-F.col("lo"))
    # What the other terms of the rule leave to this one.
    up = F.col("high") - (F.sum("__least").over(per_rule()) - F.col("__least"))
    down = F.col("low") - (F.sum("__most").over(per_rule()) - F.col("__most"))
    while True:
        for _ in range(SWEEPS):
            state = (
                state.repartition(parts, "trial", "on")
                .withColumns({"__least": least, "__most": most})
                .withColumns({"__up": up, "__down": down})
                .withColumns(
                    {
                        "__lo": F.greatest("lo", F.when(added, F.col("__down")).otherwise(-F.col("__up"))),
                        "__hi": F.least("hi", F.when(added, F.col("__up")).otherwise(-F.col("__down"))),
                    }
                )
                .repartition(parts, "trial", "node")
                .withColumns({"__lo": F.max("__lo").over(per_count()), "__hi": F.min("__hi").over(per_count())})
                .withColumn("moved", (F.col("__lo") > F.col("lo")) | (F.col("__hi") < F.col("hi")))
                .withColumns({"lo": F.col("__lo"), "hi": F.col("__hi")})
                .drop("__least", "__most", "__up", "__down", "__lo", "__hi")
            )
        state = settled(state)
        if not state.agg(F.bool_or("moved")).first()[0]:
            return state.drop("moved")


def bounds(system: System) -> DataFrame:
    """The tightest interval each count has, by passing bounds along lines, twins, nestings and
    caps until nothing moves: (node, n, hidden, alone, lo, hi)."""
    terms = terms_of(system)
    return bounded(terms, parts_of(terms)).where("kind = 'own'").select("node", "n", "hidden", "alone", "lo", "hi")


def fixed_and_breaking(minimum: int) -> Column:
    """Whether a count's bounds fix it and the group so fixed breaks the rule."""
    return ~E.two_sided("lo", F.col("n") - F.col("lo"), minimum) | F.col("alone")


def determined(system: System, minimum: int = MIN_CELL, *, audit: DataFrame | None = None) -> DataFrame:
    """Hidden counts the bounds fix, with ``breaks`` where the fixed group breaks the rule."""
    state = bounds(system) if audit is None else audit
    fixed = state.where("hidden AND lo = hi")
    return fixed.withColumn("breaks", fixed_and_breaking(minimum)).select("node", "n", "lo", "breaks")


def given_away(minimum: int) -> Column:
    fixed = F.col("hidden") & (F.col("lo") == F.col("hi")) & fixed_and_breaking(minimum)
    return F.coalesce(fixed, F.lit(False))


def still_given(terms: DataFrame, minimum: int, hide_margins: bool, parts: int) -> DataFrame:
    """The terms after as many single steps of hiding the cheapest count beside a hidden one as
    leave a count given away; the step after them is the first that may settle it.

    The cheapest one goes first, so before a count dearer than ``x`` does, every count up to ``x``
    that can be reached along lines with hidden ones is hidden, and its twins.  That set grows with
    ``x`` and bounds only widen with it, so the last ``x`` that leaves something given away is
    found by trying a few at once.  Counts hidden here keep the rule, so none is given away itself;
    where a shown count is always to be hidden, that does not hold and no step is taken.
    """
    own = terms.where((F.col("kind") == "own") & ~F.col("hidden") & (F.col("node") != TOTAL))
    shown = own.select("margin", "n", "node", "alone").collect()
    if any(r["alone"] for r in shown):
        return terms
    order = sorted((r["margin"], r["n"], r["node"]) for r in shown)
    low, high = -1, len(order)
    within = F.struct("margin", "n", "node") <= F.struct("to_margin", "to_n", "to_node")
    while high - low > 1:
        tried = sorted({low + max(1, (high - low) * k // (TRIALS + 1)) for k in range(1, TRIALS + 1)} - {high})
        choices = F.array(
            *[
                F.struct(
                    F.lit(k).alias("trial"), F.lit(order[k][0]).alias("to_margin"),
                    F.lit(order[k][1]).cast("bigint").alias("to_n"), F.lit(order[k][2]).alias("to_node"),
                )
                for k in tried
            ]
        )
        trials = terms.drop("trial").withColumn("__trial", F.explode(choices)).select("*", "__trial.*").drop("__trial")
        while True:
            for _ in range(ROUNDS):
                trials = hiding_round(trials.drop("more", "broken"), minimum, hide_margins, parts, within)
            trials = settled(trials)
            if not trials.agg(F.bool_or("more")).first()[0]:
                break
        trials = trials.drop("more", "broken", "to_margin", "to_n", "to_node")
        left = bounded(trials, parts).where(given_away(minimum)).agg(F.max("trial")).first()[0]
        if left is not None:
            terms = trials.where(F.col("trial") == left)
            low = left
        high = min([k for k in tried if k > low], default=high)
    return terms


def guard(
    system: System, *, minimum: int = MIN_CELL, hide_margins: bool = True, audit: bool = True
) -> System:
    """Hide until nothing more is given away.  Raises ``Unprotectable`` when a group stays
    determined with nothing left to hide around it.  Every round hides at least one count, so it
    ends after at most as many rounds as there are counts."""
    terms = terms_of(system)
    parts = parts_of(terms)
    single = 0
    while True:
        terms = rounds_done(terms, minimum, hide_margins, parts)
        if not audit:
            break
        state = bounded(terms, parts).withColumn("__given", given_away(minimum)).drop("lo", "hi")
        given = state.agg(F.min(F.when(F.col("__given"), F.col("node")))).first()[0]
        if given is None:
            break
        around = (F.count_if("__given").over(per_rule()) > 0) & smallest_shown(hide_margins)
        beside = (F.count_if("hidden").over(per_rule()) > 0) & smallest_shown(hide_margins)
        spread = state.repartition(parts, "trial", "on")
        options = settled(spread.withColumns({"__around": around, "__beside": beside}).drop("__given"))
        order = F.struct("margin", "n", "node")
        found = options.agg(
            F.bool_or("__around").alias("any"), F.min(F.when(F.col("__beside"), order)).alias("first")
        ).first()
        if found["any"]:
            chosen = F.col("__around")
        elif found["first"] is not None:
            # Every count on its own lines is hidden: what fixes it comes over other hidden
            # counts, so the cheapest count next to any hidden one goes.
            if single % STEPS == 0:
                options = still_given(options, minimum, hide_margins, parts)
                beside = (F.count_if("hidden").over(per_rule()) > 0) & smallest_shown(hide_margins)
                found = options.withColumn("__beside", beside).agg(F.min(F.when(F.col("__beside"), order)).alias("first")).first()
                if found["first"] is None:
                    raise Unprotectable(f"{given} stays determined with nothing left to hide")
            single += 1
            chosen = F.col("node") == found["first"]["node"]
        else:
            raise Unprotectable(f"{given} stays determined with nothing left to hide")
        terms = hidden_more(options.withColumn("__chosen", chosen), "__chosen", parts)
        terms = terms.drop("__chosen", "__around", "__beside", "more")
    own = terms.where("kind = 'own'").select("node", "n", "c", "hidden", "margin", "alone")
    return replace(system, nodes=settled(own))


def guarded_cells(
    cells: DataFrame,
    system: System,
    *,
    hidden_levels: Mapping[str, Sequence[str]] | None = None,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """The cells with ``churned`` null and a ``reason`` wherever the guarded system hides them."""
    state = system.nodes.select("node", F.col("hidden").alias("__hidden"))
    joined = cells.withColumn("__node", node_of()).join(state, F.col("__node") == F.col("node"), "left")
    hidden = F.coalesce("__hidden", F.lit(False))
    reason = reason_of(
        F.col("customers"), F.col("churned"), crossed(hidden_levels or {}), hidden, minimum
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn("churned", F.when(F.col("reason").isNull(), F.col("churned")))
        .drop("__hidden", "__node", "node")
    )


def guard_two_way(cells: DataFrame, total: DataFrame, *, minimum: int = MIN_CELL, hidden_levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Two-way tables, each on its own: cells are hidden around the margins given.

    ``cells`` holds the one-way tables too, with the margins' own hiding (null ``churned``).
    """
    start = system_of(cells, total, minimum=minimum, joint=False, hidden_levels=hidden_levels)
    state = guard(start, minimum=minimum, hide_margins=False, audit=False)
    return guarded_cells(cells, state, minimum=minimum, hidden_levels=hidden_levels)


def guard_published(
    cells: DataFrame, total: DataFrame, *, minimum: int = MIN_CELL, hidden_levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Published tables guarded again: hidden counts are unknown, and only more may be hidden."""
    state = guard(
        system_of(cells, total, minimum=minimum, hidden_levels=hidden_levels), minimum=minimum
    )
    return guarded_cells(cells, state, minimum=minimum, hidden_levels=hidden_levels)
