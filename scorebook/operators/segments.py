"""Aggregates of an outcome over segments: one- and two-way breakdowns and what is read off them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import MIN_CELL
from scorebook.operators.prefix import medians
from scorebook.operators.split import checksum, half_sums, row_hash
from scorebook.operators.tables import beside, named_rows

Levels = Mapping[str, Sequence[str]]


def counts(label: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col(label).cast("bigint")).alias("churned"),
    ]


# --- tables of one or two keys ---------------------------------------------------------------


def rate_by(df: DataFrame, column: str, *, label: str, sort_by_rate: bool = False) -> DataFrame:
    """Size, positives and rate per level."""
    out = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(*counts(label))
        .withColumn("churn_rate", E.ratio("churned", "customers"))
    )
    return out.orderBy(F.col("churn_rate").desc(), column) if sort_by_rate else out


def cross_tab(
    df: DataFrame, keys: Sequence[str], *, label: str, min_cell: int = MIN_CELL
) -> DataFrame:
    """One row per non-empty cell; a small cell keeps its size only."""
    enough = F.col("customers") >= min_cell
    known = df.dropna(subset=list(keys))
    return (
        known.groupBy(*keys)
        .agg(*counts(label))
        .withColumn("churn_rate", F.when(enough, E.ratio("churned", "customers")))
        .withColumn("churned", F.when(enough, F.col("churned")))
    )


def rate_matrix(
    df: DataFrame,
    row: str,
    column: str,
    levels: Sequence[str],
    *,
    label: str,
    min_cell: int = MIN_CELL,
) -> DataFrame:
    """Counts and rates with one column per level; rates of small cells are null.

    The levels are given, so the pivot needs no extra job to find them.
    """
    sums = df.groupBy(row).agg(
        *[F.count_if(F.col(column) == level).alias(f"n_{i}") for i, level in enumerate(levels)],
        *[
            F.sum(F.when(F.col(column) == level, F.col(label))).alias(f"c_{i}")
            for i, level in enumerate(levels)
        ],
    )
    cells = [F.col(f"n_{i}").alias(f"n {level}") for i, level in enumerate(levels)]
    rates = [
        F.when(F.col(f"n_{i}") >= min_cell, E.ratio(f"c_{i}", f"n_{i}")).alias(f"rate {level}")
        for i, level in enumerate(levels)
    ]
    return sums.select(row, *cells, *rates)


def with_without(
    df: DataFrame,
    columns: Sequence[str],
    *,
    label: str,
    labels: Mapping[str, str] | None = None,
    yes: str = "Yes",
    no: str = "No",
) -> DataFrame:
    """Per add-on column: the rate with it, the rate without it, counts and difference.

    ``df`` is the population the add-ons are offered to; all columns are read in one pass.
    """
    long = df.select(F.col(label).alias("__y"), *columns).unpivot(
        "__y", list(columns), "addon", "__value"
    )
    has, lacks = F.col("__value") == yes, F.col("__value") == no
    sums = long.groupBy("addon").agg(
        F.count_if(has).alias("n_with"),
        F.count_if(lacks).alias("n_without"),
        F.sum(F.when(has, F.col("__y"))).alias("__with"),
        F.sum(F.when(lacks, F.col("__y"))).alias("__without"),
    )
    return sums.select(
        E.label_of("addon", labels or {}).alias("addon"),
        E.ratio("__with", "n_with").alias("with_addon"),
        E.ratio("__without", "n_without").alias("without_addon"),
        "n_with",
        "n_without",
        (E.ratio("__with", "n_with") - E.ratio("__without", "n_without")).alias("difference"),
    )


def subset_rate(df: DataFrame, condition: Column, *, label: str) -> DataFrame:
    """Size, positives and rate of the rows a predicate keeps."""
    return (
        df.where(condition)
        .agg(*counts(label))
        .withColumn("churn_rate", E.ratio("churned", "customers"))
    )


def median_by_outcome(df: DataFrame, value: str, *, label: str) -> DataFrame:
    return medians(df, value, keys=[label])


def overview(df: DataFrame, *, label: str, tenure: str, amount: str) -> DataFrame:
    """Book-level figures in one row."""
    y = F.col(label)
    totals = df.agg(
        *counts(label),
        E.money_sum(amount).alias("monthly_revenue"),
        F.coalesce(E.money_sum(F.when(y == 1, F.col(amount))), F.lit(0.0)).alias(
            "monthly_revenue_at_risk"
        ),
    )
    middle = [
        medians(df, column, keys=[label], output="m").agg(
            F.max(F.when(y == 1, F.col("m"))).alias(f"median_{name}_churned"),
            F.max(F.when(y == 0, F.col("m"))).alias(f"median_{name}_retained"),
        )
        for name, column in (("tenure", tenure), ("charges", amount))
    ]
    return (
        beside(totals, *middle)
        .withColumn("churn_rate", E.ratio("churned", "customers"))
        .withColumn("majority_class_accuracy", 1 - E.ratio("churned", "customers"))
    )


# --- scores ----------------------------------------------------------------------------------


def band_summaries(
    book: DataFrame,
    *,
    score: str,
    amount: str,
    outcome: str = "outcome",
    bands: Sequence[tuple] = fixed.RISK_BANDS,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """Per fixed score band: customers, charges, shares, flags and observed churn.

    ``book`` carries ``flagged`` and ``outcome`` (withheld where it may not be shown).
    """
    shown = F.col(outcome).isin("churned", "stayed")
    sums = (
        book.withColumn("name", E.score_band(score, bands))
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            E.money_sum(amount).alias("monthly_charges"),
            F.count_if("flagged").alias("flagged"),
            F.count_if(F.col("flagged") & (F.col(outcome) != "churned")).alias(
                "flagged_not_churned"
            ),
            F.count_if(shown).alias("__seen"),
            F.count_if(F.col(outcome) == "churned").alias("__churned"),
        )
    )
    declared = named_rows(
        book.sparkSession, "name string, min double, max double", [(n, lo, hi) for n, lo, hi in bands]
    )
    everything = Window.partitionBy()
    full = declared.join(sums, "name", "left").fillna(0)
    enough = F.col("__seen") >= minimum
    return full.select(
        "name",
        "min",
        "max",
        "customers",
        E.ratio("customers", F.sum("customers").over(everything)).alias("share"),
        "monthly_charges",
        E.ratio("monthly_charges", F.sum("monthly_charges").over(everything)).alias("monthly_share"),
        "flagged",
        "flagged_not_churned",
        F.col("__seen").alias("observed_customers"),
        F.when(enough, F.col("__churned")).alias("observed_churned"),
        F.when(enough, E.ratio("__churned", "__seen")).alias("observed_rate"),
    )


def score_histogram(
    book: DataFrame,
    *,
    score: str,
    amount: str,
    partition: str,
    outcome: str = "outcome",
    bands: Sequence[tuple] = fixed.RISK_BANDS,
    bins: int = fixed.HISTOGRAM_BINS,
    minimum: int = MIN_CELL,
) -> DataFrame:
    """Customers and charges per score bin; observed churn of the bin's validation rows."""
    seen = (F.col(partition) == "validation") & F.col(outcome).isin("churned", "stayed")
    sums = (
        book.groupBy(E.histogram_bin(score, bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            E.money_sum(amount).alias("monthly_charges"),
            F.count_if(seen).alias("observed_customers"),
            F.count_if(seen & (F.col(outcome) == "churned")).alias("__churned"),
            F.avg(F.when(seen, F.col(score))).alias("__mean"),
        )
    )
    declared = named_rows(
        book.sparkSession,
        "bin int, low double, high double",
        [(i, i / bins, (i + 1) / bins) for i in range(bins)],
    )
    enough = F.col("observed_customers") >= minimum
    full = declared.join(sums, "bin", "left").fillna(
        0, subset=["customers", "monthly_charges", "observed_customers", "__churned"]
    )
    return full.select(
        "bin",
        "low",
        "high",
        E.score_band("low", bands).alias("band"),
        "customers",
        "monthly_charges",
        "observed_customers",
        F.when(enough, F.col("__churned")).alias("observed_churned"),
        F.when(enough, E.ratio("__churned", "observed_customers")).alias("observed_rate"),
        F.when(enough, F.col("__mean")).alias("observed_mean"),
    )


def share_block(book: DataFrame, predicate: Column, *, amount: str) -> DataFrame:
    """A predicate's rows, their share and charges, and the flagged active or unknown among them."""
    rows = book.withColumn("__in", F.coalesce(predicate, F.lit(False)))
    inside, status = F.col("__in"), F.col("status")
    queued = inside & F.col("flagged")
    sums = rows.agg(
        F.count(F.lit(1)).alias("__all"),
        F.count_if(inside).alias("customers"),
        F.coalesce(E.money_sum(F.when(inside, F.col(amount))), F.lit(0.0)).alias("monthly_charges"),
        F.count_if(queued & (status == "active")).alias("in_queue_active"),
        F.count_if(queued & (status == "unknown")).alias("in_queue_unknown"),
        F.coalesce(
            E.money_sum(F.when(queued & (status == "active"), F.col(amount))), F.lit(0.0)
        ).alias("in_queue_monthly"),
    )
    queue = F.col("in_queue_active") + F.col("in_queue_unknown")
    return sums.select(
        "customers",
        E.ratio("customers", "__all").alias("share"),
        "monthly_charges",
        queue.alias("in_queue"),
        "in_queue_active",
        "in_queue_unknown",
        E.ratio(queue, "__all").alias("in_queue_share"),
        "in_queue_monthly",
    )


def status_totals(book: DataFrame, *, amount: str) -> DataFrame:
    """Charges of active rows (null when none is known active) and of unknown ones."""
    status = F.col("status")
    return book.agg(
        E.money_sum(F.when(status == "active", F.col(amount))).alias("current_monthly_charges"),
        F.count_if(status == "unknown").alias("unknown_customers"),
        F.coalesce(
            E.money_sum(F.when(status == "unknown", F.col(amount))), F.lit(0.0)
        ).alias("unknown_monthly_charges"),
    )


def observed_overall(labelled: DataFrame, *, label: str, minimum: int = MIN_CELL) -> DataFrame:
    """Positives and rate over every row whose outcome may be shown; null for too few."""
    enough = F.col("customers") >= minimum
    return labelled.agg(*counts(label)).select(
        "customers",
        F.when(enough, F.col("churned")).alias("churned"),
        F.when(enough, E.ratio("churned", "customers")).alias("rate"),
    )


# --- every one- and two-way breakdown ---------------------------------------------------------


#: Cells of one shared table of counts, at most, where the dimensions' sizes are known.
PARENT_CELLS = 100_000


def shared_parents(sizes: Mapping[str, int], most: int = PARENT_CELLS) -> list[list[str]]:
    """Groups of dimensions, each with at most ``most`` combinations of levels, that hold every pair
    of dimensions; one group where all of them fit, else as few as a greedy choice finds.

    A pair that is larger by itself is a group of its own.
    """
    names = list(sizes)
    open_ = set(itertools.combinations(range(len(names)), 2)) or {(i, i) for i in range(len(names))}
    out: list[list[str]] = []

    def cells(members: set[int]) -> int:
        return math.prod(sizes[names[i]] for i in members)

    def covered(members: set[int]) -> set[tuple[int, int]]:
        return {p for p in open_ if set(p) <= members}

    while open_:
        # The widest pair left is the hardest to place.
        members = set(max(sorted(open_), key=lambda p: cells(set(p))))
        while True:
            fits = [i for i in range(len(names)) if i not in members and cells(members | {i}) <= most]
            if not fits:
                break
            members.add(max(fits, key=lambda i: (len(covered(members | {i})), -sizes[names[i]], -i)))
        open_ -= covered(members)
        out.append([names[i] for i in sorted(members)])
    return out


def breakdown_counts(
    df: DataFrame, dimensions: Sequence[str], *, label: str, sizes: Mapping[str, int] | None = None, most: int = PARENT_CELLS
) -> DataFrame:
    """Size and positives of every level, every pair of levels and the whole, in one scan.

    The rows are first counted per combination of the dimensions, which the map side collapses;
    only that table is then expanded into the levels and pairs.  With ``sizes``, how many levels
    each dimension has, the combinations are those of a few groups of dimensions that share all
    pairs among them, so what is shuffled is bounded by ``most`` cells a group, however many
    dimensions there are; without, they are those of all dimensions.  Output: ``rows``, ``cols``
    (null for one-way), ``row``, ``col``, ``customers``, ``churned``; the total has null ``rows``.
    """
    dims = list(dimensions)
    parents = [dims] if sizes is None else shared_parents({d: sizes[d] for d in dims}, most)
    # The bits of the grouping number: set where a dimension is not grouped by.
    numbers = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in parent) for parent in parents]
    base = df.groupingSets(parents, *dims).agg(F.grouping_id().alias("__gid"), *counts(label))
    places: dict[tuple[str, ...], int] = {(): 0}
    for k, parent in enumerate(parents):
        for members in [*itertools.combinations(parent, 1), *itertools.combinations(parent, 2)]:
            places.setdefault(members, k)

    def cell(members: tuple[str, ...]) -> Column:
        texts = [F.col(d).cast("string") for d in members] + [F.lit(None).cast("string")] * (2 - len(members))
        names = [F.lit(d) for d in members] + [F.lit(None).cast("string")] * (2 - len(members))
        return F.struct(*[c.alias(a) for c, a in zip([*names, *texts], ("rows", "cols", "row", "col"), strict=True)])

    own = [F.array(*[cell(m) for m, at in places.items() if at == k]) for k in range(len(parents))]
    at = E.pick([(F.col("__gid") == number, cells) for number, cells in zip(numbers, own, strict=True)])
    each = base.select(F.explode(at).alias("__at"), "customers", "churned").select("__at.*", "customers", "churned")
    return each.groupBy("rows", "cols", "row", "col").agg(
        F.sum("customers").alias("customers"), F.sum("churned").alias("churned")
    )


def level_grid(spark: SparkSession, levels: Levels, *, pairs: bool = True) -> DataFrame:
    """Every declared level and pair of levels with display positions: a fixed, small table."""
    rows = [
        (d, None, level, None, i, None) for d, names in levels.items() for i, level in enumerate(names)
    ]
    if pairs:
        rows += [
            (a, b, x, y, i, j)
            for a, b in itertools.combinations(levels, 2)
            for i, x in enumerate(levels[a])
            for j, y in enumerate(levels[b])
        ]
    schema = "rows string, cols string, row string, col string, row_pos int, col_pos int"
    return named_rows(spark, schema, rows)


def dense(found: DataFrame, grid: DataFrame) -> DataFrame:
    """Every declared cell with its counts, empty ones with zero.

    A level in the data that the grid does not declare is an error, never a dropped group: the job
    that meets it fails and names it.
    """
    keyed = found.select(*[F.col(c).alias(f"__{c}") for c in ("rows", "cols", "row", "col")], "customers", "churned")
    same = (
        (F.col("rows") == F.col("__rows"))
        & F.col("cols").eqNullSafe(F.col("__cols"))
        & (F.col("row") == F.col("__row"))
        & F.col("col").eqNullSafe(F.col("__col"))
    )
    stray = F.col("rows").isNull()
    alone = stray & F.col("__rows").isNotNull() & F.col("__row").isNotNull() & F.col("__cols").isNull()
    told = F.concat(F.lit("undeclared level "), F.col("__row"), F.lit(" of "), F.col("__rows"))
    counts = F.when(alone, F.raise_error(told).cast("bigint")).otherwise(F.coalesce("customers", F.lit(0)))
    return (
        grid.join(keyed, same, "full")
        .where(~stray | alone)
        .withColumns({"customers": counts, "churned": F.coalesce("churned", F.lit(0))})
        .drop("__rows", "__cols", "__row", "__col")
    )


def unknown_levels(found: DataFrame, levels: Levels) -> DataFrame:
    """Levels in the data that no dimension declares: a data error, never a dropped group."""
    declared = named_rows(
        found.sparkSession,
        "rows string, row string",
        [(d, level) for d, names in levels.items() for level in names],
    )
    one_way = found.where(F.col("rows").isNotNull() & F.col("cols").isNull())
    return one_way.where(F.col("row").isNotNull()).join(declared, ["rows", "row"], "left_anti")


def decorated(cells: DataFrame, base: DataFrame) -> DataFrame:
    """Rate, lift over the partition's rate and Wilson interval; hidden cells (a non-null
    ``reason``) keep their size only.  ``base`` is one row (customers, churned)."""
    total = base.select(
        F.col("customers").alias("partition_customers"), F.col("churned").alias("partition_churned")
    )
    shown = F.col("reason").isNull() if "reason" in cells.columns else F.lit(True)
    rate = E.ratio("churned", "customers")
    low, high = E.wilson("churned", "customers")
    return (
        beside(cells, total)
        .withColumn("base_rate", E.ratio("partition_churned", "partition_customers"))
        .withColumns(
            {
                "rate": F.when(shown, rate),
                "lift": F.when(shown & (F.col("base_rate") != 0), rate / F.col("base_rate")),
                "low": F.when(shown, low),
                "high": F.when(shown, high),
                "churned": F.when(shown, F.col("churned")),
            }
        )
    )


def total_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("rows").isNull()).select("customers", "churned")


def both_orientations(cells: DataFrame) -> DataFrame:
    """A two-way table can be asked for either way round."""
    swap = {"rows": "cols", "cols": "rows", "row": "col", "col": "row", "row_pos": "col_pos", "col_pos": "row_pos"}
    swapped = cells.where(F.col("cols").isNotNull()).select(
        *[F.col(c).alias(swap.get(c, c)) for c in cells.columns]
    )
    return cells.unionByName(swapped)


def top_cells(cells: DataFrame, k: int = fixed.RANKED) -> DataFrame:
    """The ``k`` highest reported rates of each table; ties in level order."""
    order = Window.partitionBy("rows", "cols").orderBy(
        F.col("rate").desc(), F.col("row_pos").asc(), F.col("col_pos").asc()
    )
    return (
        cells.where(F.col("rate").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def lifecycle(cells: DataFrame, labelled: DataFrame, *, tenure: str, label: str, dimension: str) -> DataFrame:
    """The tenure breakdown with the median tenure of each outcome beside every bucket."""
    y = F.col(label)
    middle = medians(labelled, tenure, keys=[label], output="m").agg(
        F.max(F.when(y == 1, F.col("m"))).alias("median_tenure_churned"),
        F.max(F.when(y == 0, F.col("m"))).alias("median_tenure_stayed"),
    )
    buckets = cells.where((F.col("rows") == dimension) & F.col("cols").isNull())
    return beside(buckets, middle)


def spread_and_peak(cells: DataFrame) -> DataFrame:
    """Per one-way table: highest over lowest shown rate and the level it peaks at; null with
    fewer than two shown levels, the spread also where the lowest rate is zero."""
    shown = cells.where(F.col("cols").isNull() & F.col("rate").isNotNull())
    # Of equal rates, the first level in display order.
    top = F.max_by("row", F.struct(F.col("rate"), -F.col("row_pos")))
    grouped = shown.groupBy("rows").agg(
        F.count(F.lit(1)).alias("shown"),
        F.max("rate").alias("__high"),
        F.min("rate").alias("__low"),
        top.alias("__peak"),
    )
    several = F.col("shown") >= 2
    return grouped.select(
        "rows",
        "shown",
        F.when(several, E.ratio("__high", "__low")).alias("spread"),
        F.when(several, F.col("__peak")).alias("peak"),
    )


# --- identity and nesting of groups -------------------------------------------------------------


def members(df: DataFrame, columns: Sequence[str], *, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row and dimension: (dimension, segment, carried columns)."""
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    kept = [F.col(c).alias(f"__c_{c}") for c in carry]
    long = df.select(*kept, *texts).unpivot(
        [f"__c_{c}" for c in carry], list(columns), "dimension", "segment"
    )
    return long.withColumnsRenamed({f"__c_{c}": c for c in carry})


def identical_segments(df: DataFrame, columns: Sequence[str], *, id: str) -> DataFrame:
    """Segments of different dimensions with exactly the same members: one row per segment,
    with the group it shares.  Members are compared by an order-free fingerprint, so no member
    list is ever gathered.  Each row is hashed once, and rows with the same levels in every
    dimension are counted once before the dimensions are read off."""
    hashed = df.select(*columns, row_hash([id]).alias("__h"))
    upper, lower = half_sums(F.col("__h"))
    found = hashed.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("__n"), F.bit_xor("__h").alias("__x"), upper.alias("__u"), lower.alias("__l")
    )
    groups = (
        members(found, columns, carry=["__n", "__x", "__u", "__l"])
        .groupBy("dimension", "segment")
        .agg(
            F.sum("__n").alias("customers"), F.bit_xor("__x").alias("members"),
            checksum(F.sum("__u"), F.sum("__l")).alias("checksum"),
        )
    )
    same = Window.partitionBy("customers", "members", "checksum")
    return (
        groups.withColumn("names", F.count(F.lit(1)).over(same)).where(F.col("names") > 1)
    ).select("dimension", "segment", "customers", "members", "checksum", "names")


def betrayed(identical: DataFrame, shown: DataFrame) -> DataFrame:
    """Groups hidden under one name and shown under another.  ``shown`` is
    (dimension, segment, shown)."""
    return (
        identical.join(shown, ["dimension", "segment"])
        .groupBy("customers", "members", "checksum")
        .agg(F.min("shown").alias("__min"), F.max("shown").alias("__max"), F.count(F.lit(1)).alias("names"))
        .where(F.col("__min") != F.col("__max"))
        .drop("__min", "__max")
    )


def nesting(found: DataFrame) -> DataFrame:
    """Which levels are the same set, and which lie inside which, from sizes alone.

    ``found`` holds one- and two-way counts.  A pair cell as large as both its levels makes
    them one set; as large as one of them, that one lies inside the other.
    """
    one = found.where(F.col("rows").isNotNull() & F.col("cols").isNull())
    left = one.select(
        F.col("rows"), F.col("row"), F.col("customers").alias("n_row"), F.col("churned").alias("c_row")
    )
    right = one.select(
        F.col("rows").alias("cols"), F.col("row").alias("col"),
        F.col("customers").alias("n_col"), F.col("churned").alias("c_col"),
    )
    pairs = found.where(F.col("cols").isNotNull() & (F.col("customers") > 0)).select(
        "rows", "row", "cols", "col", F.col("customers").alias("n_both")
    )
    joined = pairs.join(left, ["rows", "row"]).join(right, ["cols", "col"])
    same = (F.col("n_both") == F.col("n_row")) & (F.col("n_both") == F.col("n_col"))
    relation = (
        F.when(same, "same")
        .when(F.col("n_both") == F.col("n_row"), "row inside col")
        .when(F.col("n_both") == F.col("n_col"), "col inside row")
    )
    return joined.withColumn("relation", relation).where(F.col("relation").isNotNull())


def nested_gaps(found: DataFrame) -> DataFrame:
    """The difference of every two nested levels: a group of its own, never published."""
    nested = nesting(found).where(F.col("relation") != "same")
    gap_n = F.abs(F.col("n_row") - F.col("n_col"))
    gap_c = F.when(F.col("relation") == "row inside col", F.col("c_col") - F.col("c_row")).otherwise(
        F.col("c_row") - F.col("c_col")
    )
    return nested.select(
        "rows", "row", "cols", "col", "relation", gap_n.alias("customers"), gap_c.alias("churned")
    )


def reconcile(cells: DataFrame, lifecycle_cells: DataFrame | None = None, dimension: str = "tenure") -> DataFrame:
    """Where published tables tell different stories: empty when they agree.

    ``cells`` is every table in both orientations with ``partition_customers`` and
    ``partition_churned``; ``churned`` is null where hidden.
    """
    where = ["rows", "cols", "row", "col"]

    def finding(df: DataFrame, check: str) -> DataFrame:
        have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in where]
        return df.select(F.lit(check).alias("check"), *have)

    first = cells.agg(
        F.min("partition_customers").alias("a"),
        F.max("partition_customers").alias("b"),
        F.min("partition_churned").alias("c"),
        F.max("partition_churned").alias("d"),
    ).where((F.col("a") != F.col("b")) | (F.col("c") != F.col("d")))
    found = finding(first, "another partition")

    two = cells.where(F.col("cols").isNotNull())
    twin = two.select(
        F.col("rows").alias("cols"), F.col("cols").alias("rows"),
        F.col("row").alias("col"), F.col("col").alias("row"),
        F.col("customers").alias("__n"), F.col("churned").alias("__c"),
    )
    disagree = two.join(twin, where).where(
        (F.col("customers") != F.col("__n")) | ~F.col("churned").eqNullSafe(F.col("__c"))
    )
    found = found.unionByName(finding(disagree, "orientations disagree"))

    margins = cells.where(F.col("cols").isNull()).select(
        "rows", "row", F.col("customers").alias("__n"), F.col("churned").alias("__c")
    )
    lines = two.groupBy("rows", "cols", "row").agg(
        F.sum("customers").alias("n"),
        F.sum("churned").alias("c"),
        F.count_if(F.col("churned").isNull()).alias("hidden"),
    )
    against = lines.join(margins, ["rows", "row"])
    found = found.unionByName(
        finding(against.where(F.col("n") != F.col("__n")), "cells do not add up to the margin")
    )
    found = found.unionByName(
        finding(
            against.where((F.col("hidden") == 0) & F.col("__c").isNotNull() & (F.col("c") != F.col("__c"))),
            "churn does not add up to the margin",
        )
    )
    whole = cells.where(F.col("cols").isNull()).groupBy("rows").agg(
        F.sum("customers").alias("n"), F.max("partition_customers").alias("__n")
    )
    found = found.unionByName(
        finding(whole.where(F.col("n") != F.col("__n")), "levels do not add up to the partition")
    )
    if lifecycle_cells is not None:
        other = lifecycle_cells.select(
            "row", F.col("customers").alias("__n"), F.col("churned").alias("__c")
        )
        table = cells.where((F.col("rows") == dimension) & F.col("cols").isNull())
        differ = table.join(other, "row", "full").where(
            ~F.col("customers").eqNullSafe(F.col("__n")) | ~F.col("churned").eqNullSafe(F.col("__c"))
        )
        found = found.unionByName(finding(differ, "lifecycle is not the tenure table"))
    return found
