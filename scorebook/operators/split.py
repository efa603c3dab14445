"""Reproducible stratified splits and folds, their summary and their fingerprint."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.expr import col, ratio

def hash_digits(df: DataFrame) -> int:
    """Leading hash digits that cut a stratum into ranges: at least four ranges per shuffle
    partition, of equal expected size whatever the IDs are, as the hash is uniform."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(2, math.ceil(math.log(4 * partitions, 16))), 5)


def seeded_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(col(id_col).cast("string"), F.lit(f":{seed}")))


def stratum_places(df: DataFrame, *, id: str, label: str, seed: int) -> DataFrame:
    """``df`` with ``__rn``, each row's place within its label in hash order, and ``__nc``.

    Ranks are taken within (label, leading hash digits) and shifted by the sizes of the
    ranges before: the same numbers as one window per label, in as many tasks as the cluster
    has.  The table of range sizes is bounded by the number of ranges.
    """
    hashed = df.withColumns(
        {
            "__hash": seeded_hash(id, seed),
            # A missing label is a stratum of its own, so no row is lost in the join.
            "__stratum": F.coalesce(col(label).cast("string"), F.lit("")),
        }
    ).withColumn("__range", F.substring("__hash", 1, hash_digits(df)))
    sizes = hashed.groupBy("__stratum", "__range").agg(F.count(F.lit(1)).alias("__size"))
    stratum = Window.partitionBy("__stratum")
    before = stratum.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__stratum",
        "__range",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
        F.sum("__size").over(stratum).alias("__nc"),
    )
    local = Window.partitionBy("__stratum", "__range").orderBy("__hash", id)
    ranked = hashed.withColumn("__local", F.row_number().over(local))
    return (
        ranked.join(offsets, ["__stratum", "__range"])
        .withColumn("__rn", F.col("__before") + F.col("__local"))
        .drop("__hash", "__stratum", "__range", "__before", "__local")
    )


def stratified_split(
    df: DataFrame,
    *,
    id: str,
    label: str,
    seed: int = 42,
    test_share: float = 0.2,
    validation_share: float = 0.2,
    output: str = "partition_name",
) -> DataFrame:
    """``df`` with a train / validation / test column.

    Shares are of the whole table and hold within each label; the same ID, label and seed
    always give the same partition.
    """
    placed = stratum_places(df, id=id, label=label, seed=seed)
    test = F.floor(F.lit(test_share) * F.col("__nc") + 0.5)
    validation = F.floor(F.lit(validation_share) * F.col("__nc") + 0.5)
    name = (
        F.when(F.col("__rn") <= test, "test")
        .when(F.col("__rn") <= test + validation, "validation")
        .otherwise("train")
    )
    return placed.withColumn(output, name).drop("__rn", "__nc")


def stratified_folds(
    df: DataFrame, *, id: str, label: str, folds: int = 5, seed: int = 42, output: str = "fold"
) -> DataFrame:
    """``df`` with a fold number 0..folds-1, balanced within each label."""
    placed = stratum_places(df, id=id, label=label, seed=seed)
    return placed.withColumn(output, F.pmod(F.col("__rn") - 1, F.lit(folds)).cast("int")).drop(
        "__rn", "__nc"
    )


def split_summary(df: DataFrame, *, label: str, partition: str = "partition_name") -> DataFrame:
    """Size, share of the whole, positives and positive rate per partition."""
    sizes = df.groupBy(partition).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )
    total = F.sum("n").over(Window.partitionBy())
    return sizes.select(
        partition,
        "n",
        F.round(ratio("n", total), 4).alias("share"),
        "positives",
        F.round(ratio("positives", "n"), 4).alias("positive_rate"),
    )


def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of a row's MD5 as a number.  Every value is written with its length and a null as
    ``n``, so no two different rows are the same text."""
    values = [col(c).cast("string") for c in columns]
    text = F.concat(
        *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in values]
    )
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """An order-free fingerprint of the rows: their count, the XOR of their hashes and the sum, in
    which a repeated row does not cancel."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums(row_hash(columns), "fingerprint"))


def sums(hashed: Column, name: str) -> list[Column]:
    """The XOR of hashes under ``name`` and their exact sum as ``checksum``."""
    return [F.bit_xor(hashed).alias(name), checksum(*half_sums(hashed)).alias("checksum")]


def half_sums(hashed: Column) -> tuple[Column, Column]:
    """Sums of the upper and lower 30 bits of 60-bit hashes: whole numbers, which add up much
    faster than decimals."""
    return F.sum(F.shiftright(hashed, 30)), F.sum(hashed.bitwiseAND(F.lit((1 << 30) - 1)))


def checksum(upper: Column, lower: Column) -> Column:
    """The exact sum of hashes from those of their halves, as text."""
    whole = upper.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + lower.cast("decimal(20,0)")
    return whole.cast("string")


def split_digest(df: DataFrame, *, id: str, partition: str = "partition_name") -> DataFrame:
    """Which IDs went to which partition, as one fingerprint per partition."""
    return fingerprint(df, [id], keys=[partition])


# Why outcomes are withheld when a split cannot be matched to the recorded one.
WITHHELD_REASONS = {
    "not recorded": "the model records no split, so no partition can be trusted",
    "dataset differs": "the data differs from the data the model was trained on",
    "split differs": "the split differs from the one the model was trained on",
}


def provenance(digest: DataFrame, recorded: DataFrame, *, partition: str = "partition_name") -> DataFrame:
    """Compare a split's digest with the recorded one: one row (verified, reason).

    Fails closed: without a recorded row, with other sizes, or with other members, the
    split is not verified and a fixed reason says why.
    """
    other = recorded.select(
        F.col(partition).alias("__p"),
        F.col("n").alias("__n"),
        F.struct("fingerprint", "checksum").alias("__f"),
    )
    joined = digest.join(other, F.col(partition) == F.col("__p"), "full")
    counted = joined.agg(
        F.count_if(F.col("__p").isNotNull()).alias("recorded"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("recorded_rows"),
        F.count_if(
            ~(
                F.col("n").eqNullSafe(F.col("__n"))
                & F.struct("fingerprint", "checksum").eqNullSafe(F.col("__f"))
            )
        ).alias("differing"),
    )
    reason = (
        F.when(F.col("recorded") == 0, WITHHELD_REASONS["not recorded"])
        .when(F.col("rows") != F.col("recorded_rows"), WITHHELD_REASONS["dataset differs"])
        .when(F.col("differing") > 0, WITHHELD_REASONS["split differs"])
    )
    return counted.select(reason.isNull().alias("verified"), reason.alias("reason"))


def seeded_sample(df: DataFrame, n: int, *, id: str, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all of them if fewer), the same ones for the same seed."""
    return (
        df.withColumn("__hash", seeded_hash(id, seed))
        .orderBy("__hash", id)
        .limit(n)
        .drop("__hash")
    )
