"""Orderings over a whole table, without a window that puts every row in one task.

Two tools.  ``running_totals`` accumulates measures along an ordered numeric value: the value
line is cut into ranges of about equal weight, each range is accumulated on its own, and the
range totals - a bounded number of rows - carry the offset.  ``positions`` numbers rows in a
total order of any column types through a range-partitioned sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.session import durable

RANGE = "__range"


def range_count(df: DataFrame) -> int:
    """How many ranges to cut a value line into: enough for the cluster, and bounded."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(4 * partitions, 4096))


def value_cuts(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Cut points that split ``df`` into ranges of about equal row counts.

    They only balance the work: any cut points give the same result.  One aggregate over one
    column, and at most ``ranges`` numbers come back.  They are read eagerly and put into the
    plan as literals: an approximate quantile computed again inside the plan could differ.
    """
    n = ranges or range_count(df)
    shares = [i / n for i in range(1, n)]
    row = df.agg(
        F.percentile_approx(F.col(value).cast("double"), shares, F.lit(max(10_000, 10 * n))).alias("c")
    ).first()
    return sorted(set(row["c"] or []))


def with_range(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """``df`` with the number of the range its value lies in."""
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = df.withColumn("__value", F.col(value).cast("double"))
    cutter = Bucketizer(
        splits=splits, inputCol="__value", outputCol=RANGE, handleInvalid="keep"
    )
    return cutter.transform(keyed).drop("__value").withColumn(RANGE, F.col(RANGE).cast("int"))


def running_totals(
    df: DataFrame,
    value: str,
    measures: Mapping[str, str],
    *,
    keys: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` (output name -> column) along ``value``, and each
    measure's grand total per key as ``all_<output>``.

    ``df`` holds one row per ``keys`` and ``value``.  Within a range the sum is a window over
    ``(keys, range)``; between ranges it is a window over the range totals, of which there are
    at most ``range_count`` per key.  ``df`` is written once, as three passes read it.
    """
    df = durable(df)
    cuts = value_cuts(df, value) if cuts is None else cuts
    # The keys as one never-null struct, so a missing level joins like any other.
    ranged = with_range(df, value, cuts).withColumn("__k", key_struct(keys))
    order = F.col(value).desc() if descending else F.col(value).asc()
    range_order = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    inside = (
        Window.partitionBy("__k", RANGE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy("__k").orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = ranged.groupBy("__k", RANGE).agg(
        *[F.sum(c).alias(f"__total_{out}") for out, c in measures.items()]
    )
    whole = Window.partitionBy("__k")
    offsets = totals.select(
        "__k",
        RANGE,
        *[
            F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__before_{out}")
            for out in measures
        ],
        *[F.sum(f"__total_{out}").over(whole).alias(f"all_{out}") for out in measures],
    )
    local = ranged.withColumns({out: F.sum(c).over(inside) for out, c in measures.items()})
    return (
        local.join(offsets, ["__k", RANGE])
        .withColumns({out: F.col(out) + F.col(f"__before_{out}") for out in measures})
        .drop(RANGE, "__k", *[f"__before_{o}" for o in measures])
    )


def key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def value_at_position(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = (),
    wanted: Mapping[str, Column],
) -> DataFrame:
    """Per key, the values at 1-based positions in ascending order of ``value``.

    ``wanted`` gives each output's position as an expression over ``n``, the key's row count
    (nulls of ``value`` are left out).  Rows are first counted per distinct value.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    run = running_totals(counted, value, {"__upto": "__m"}, keys=keys)
    joined = run.withColumnRenamed("all___upto", "n")
    holds = {
        out: (F.col("__upto") - F.col("__m") < position) & (position <= F.col("__upto"))
        for out, position in wanted.items()
    }
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(h, F.col(value))).alias(o) for o, h in holds.items()]
    )


def medians(df: DataFrame, value: str, *, keys: Sequence[str] = (), output: str = "median") -> DataFrame:
    """The exact median per key, the mean of the two middle values for an even count."""
    n = F.col("n")
    found = value_at_position(
        df,
        value,
        keys=keys,
        wanted={
            "__low": F.floor((n + 1) / 2).cast("bigint"),
            "__high": (F.floor(n / 2) + 1).cast("bigint"),
        },
    )
    middle = (F.col("__low").cast("double") + F.col("__high").cast("double")) / 2
    return found.select(*keys, middle.alias(output))


def positions(
    df: DataFrame,
    order: Sequence[Column],
    *,
    output: str = "position",
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Each row's 1-based place in a total order (``order`` must end in a unique column).

    The rows are sorted across range partitions and written once; a partition's row count is
    all that crosses partitions.  Ties cannot pile up in one task as the unique column is part
    of the range key.  With ``keys`` the numbering restarts per key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = [F.col(k).asc() for k in keys]
    placed = durable(
        df.repartitionByRange(n, *lead, *order)
        .sortWithinPartitions(*lead, *order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumns(
            {
                "__part": F.shiftright("__id", 33).cast("int"),
                "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("__id")
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("__part"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    numbered = placed.join(starts, "__part").withColumn(
        output, F.col("__start") + F.col("__row") + 1
    )
    if keys:
        firsts = numbered.groupBy(*keys).agg(F.min(output).alias("__first"))
        numbered = numbered.join(firsts, list(keys)).withColumn(
            output, F.col(output) - F.col("__first") + 1
        )
    return numbered.select(*df.columns, output)
