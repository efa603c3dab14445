"""Merkle manifest of a table: levels of aligned blocks as one hex string each, proofs by substring.

A row is a leaf, the SHA-256 of its fields; a field is its UTF-8 byte count, a colon and its value,
and a single ``-`` if it is null.  Within a group the leaves ascend by ``order`` and every ``fan``
consecutive nodes (the last run may be shorter, down to one) become the digest of their
concatenation, until one is left, the group's subroot; the subroots, by group with null first, are
folded likewise into the root.  All digests are lower-case hex text.

The leaves of a group are numbered and cut into aligned blocks of ``fan ** LEVELS``.  A block keeps
each of its levels as one string of 64 signs a node, so a parent is the digest of a substring of
fixed width, and a node's siblings are the substrings that flank it in its run.  The blocks' roots
are the leaves of the next round, with one row for each ``fan ** LEVELS`` of the rows before; no
round puts more than one block into a row.

Numbers come from a range sort by group, order and leaf, so rows without an ID come first, and
ties go by leaf; equal rows have equal leaves and any order of theirs gives the same tree.  A group
of any share of the rows is cut into ranges like any other.  An empty table has no rows and no
root.  Columns that are not fields have no part in a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import stored

#: Hex signs of a digest.
WIDE = 64
#: Levels that a block spans.
LEVELS = 8


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """Byte count, colon and value as text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def group_key(value: Column) -> Column:
    """Text that sorts like the value, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within ``grp`` by ``order``, nulls first.

    The rows are sorted in ranges and written; only the number of rows per range and group crosses
    ranges, and there are no more of those than ranges and groups together.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ident = F.monotonically_increasing_id()
    placed = stored(
        rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__id", ident)
        .withColumns({"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"),
        "merkle-sorted",
    )
    runs = placed.groupBy("grp", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    starts = stored(runs.select("grp", "__part", offset.alias("__offset")), "merkle-ranges")
    return placed.join(starts, ["grp", "__part"]).withColumn("pos", F.col("__row") + F.col("__offset")).drop("__part", "__row", "__offset")


def parents(level: Column, fan: int) -> Column:
    """The next level: one digest per run of ``fan`` nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (fan * WIDE)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * (fan * WIDE) + 1, F.lit(fan * WIDE)))), "")


def flanks(level: Column, at: Column, fan: int) -> Column:
    """The siblings of a node: what lies left and right of it in its run."""
    inside = at % fan
    run = F.substring(level, (at - inside) * WIDE + 1, F.lit(fan * WIDE))
    left = F.substring(run, F.lit(1), inside * WIDE)
    right = F.substring(run, (inside + 1) * WIDE + 1, F.lit(fan * WIDE))
    return F.struct(left.alias("left"), right.alias("right"))


def proved(nodes: DataFrame, *, fan: int = 2) -> tuple[DataFrame, DataFrame]:
    """For (grp, pos, node, row): the rows with ``path``, their siblings up to the group's root, and
    (grp, root) of every group."""
    width = fan**LEVELS
    sizes = stored(nodes.groupBy("grp").agg(F.count("*").alias("n")), "merkle-sizes")
    block = F.floor(F.col("pos") / width)
    at = (F.col("pos") - block * width).cast("int")
    members = F.sort_array(F.collect_list(F.struct(at.alias("at"), "node", "row")))
    steps = reduce(lambda a, b: a + b, [(F.col("n") > fan**i).cast("int") for i in range(LEVELS)])
    whole = nodes.groupBy("grp", block.alias("block")).agg(members.alias("members"))
    bottom = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))
    climb = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), F.col("height"))
    up = F.aggregate(climb, bottom, lambda levels, _: F.array_append(levels, parents(F.element_at(levels, -1), fan)))
    blocks = stored(
        whole.join(sizes, "grp").withColumn("height", steps).select("grp", "block", "members", up.alias("levels"), "height"), "merkle-blocks"
    )
    tops = blocks.select("grp", F.col("block").alias("pos"), F.element_at("levels", -1).alias("node"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > width:
        above, roots = proved(tops.withColumn("row", F.struct(F.col("pos").alias("block"))), fan=fan)
        above = above.select("grp", F.col("row.block").alias("block"), F.col("path").alias("above"))
        blocks = blocks.join(above, ["grp", "block"])
    else:
        roots = stored(tops.select("grp", F.col("node").alias("root")), "merkle-roots")
        blocks = blocks.withColumn("above", F.array().cast("array<struct<left:string,right:string>>"))

    def path(m: Column) -> Column:
        own = F.transform(
            F.slice("levels", F.lit(1), F.col("height")), lambda level, i: flanks(level, F.floor(m["at"] / F.pow(F.lit(fan), i)).cast("int"), fan)
        )
        return F.struct(m["row"].alias("row"), F.concat(own, F.col("above")).alias("path"))

    out = blocks.select("grp", F.explode(F.transform("members", path)).alias("m")).select("grp", "m.row", "m.path")
    return out, roots


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def refolded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def manifest(rows: DataFrame, *, order: str = "doc_id", fan: int = 2) -> DataFrame:
    """For (grp, ``order``, leaf, ...): every row with ``path``, the siblings up to the root of all,
    its group's ``subroot`` and the ``root``."""
    kept = stored(rows, "merkle-leaves")
    names = [c for c in kept.columns if c != "grp"]
    nodes = numbered(kept, order, "leaf").select("grp", "pos", F.col("leaf").alias("node"), F.struct(*names).alias("row"))
    leaves, subroots = proved(nodes, fan=fan)
    second = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "root"), "own")
    tops, root = proved(second.select("grp", "pos", F.col("root").alias("node"), F.struct("own", "root").alias("row")), fan=fan)
    top = stored(
        tops.join(root, "grp").select(F.col("row.own").alias("grp"), F.col("row.root").alias("subroot"), F.col("path").alias("top"), "root"), "merkle-top"
    )
    return leaves.join(top, "grp").select("grp", "row.*", F.concat("path", "top").alias("path"), "subroot", "root")
