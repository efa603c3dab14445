"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A text is the set of its distinct word shingles; a text with fewer words than a shingle has one, the
whole sequence; a text without words has none and is linked with nothing.  Two texts are linked if
their sets' similarity reaches the threshold, and groups are the connected parts.

Equal sets become one node first, so copies never meet in a bucket.  In every bucket all nodes are
compared with one leader, which joins the bulk of a group at the cost of its size.  Nodes of
buckets that still hold several groups are then compared across groups, if they share one of their
rarest shingles early enough, as two sets at the threshold must, and if their sizes and sketches
leave room for a link.  Every comparison is made on the full sets.

A link is missed only if no band agrees (chance below ``MISS`` at the threshold) or the sketches
differ by more than five and a half standard deviations.  Null texts count as empty.  Rows without
an ID are linked with nothing, are kept and have no group.  Repeated rows are all kept or all
dropped, as the ID is.  Rows that share an ID but not a text are one node with the links of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import stored

MISS = 1e-5
#: Distinct shingles that are signed at once.
ELEMENTS = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SKETCH_BITS = 128
#: Registers of a signature at most, while one row a band is enough for it.
REGISTERS = 256
#: Counters that order the elements of sets by frequency.
COUNTERS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for which a pair at the threshold shares no band with a chance below MISS, of as
    many rows as ``REGISTERS`` allow."""
    if not 1 <= percent <= 100:
        raise ValueError(f"a similarity is from 1 to 100 percent, not {percent!r}")
    similarity = percent / 100
    for rows in (6,) if percent >= 85 else (5, 4, 3, 2, 1):
        apart = 1 - similarity**rows
        bands = math.ceil(math.log(MISS) / math.log(apart)) if apart > 0 else 1
        if bands * rows <= REGISTERS:
            return bands, rows
    # Less alike than one band of one row each can tell within the registers: more of them.
    return bands, rows


def sketch_bits(percent: int) -> int:
    """Registers that give a bit to a sketch."""
    bands, rows = banding(percent)
    return min(SKETCH_BITS, bands * rows)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; only A to Z are lowered."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * GOLDEN + hashed[i : len(hashed) - width + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash: a (sets, size) table of registers.

    Each element walks its own random permutation of the registers; in round ``j`` it offers its
    next register a value in [j, j + 1).  A set stops once no register exceeds the next round's
    least value.  Sets must not be empty.
    """
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    registers = np.full((len(sets), size), np.inf)
    flat = registers.reshape(-1)
    walk = None
    with np.errstate(over="ignore"):
        for j in range(size):
            x = mixed(element + GOLDEN * np.uint64(2 * j + 1))
            value = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
            step = j + (mixed(element + GOLDEN * np.uint64(2 * j + 2)) % np.uint64(size - j)).astype(np.int64)
            rows = np.arange(len(element))
            if walk is None:
                place = step
            else:
                place = walk[rows, step].astype(np.int64)
                walk[rows, step] = walk[:, j]
                walk[:, j] = place
            np.minimum.at(flat, owner * size + place, value)
            going = registers.max(axis=1) > j + 1
            keep = going[owner]
            if not keep.any():
                break
            if walk is None:
                element, owner, step = element[keep], owner[keep], step[keep]
                walk = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
                rows = np.arange(len(element))
                walk[rows, step] = 0
                walk[:, 0] = step
            elif keep.sum() < 0.7 * len(keep):
                element, owner, walk = element[keep], owner[keep], walk[keep]
    return registers


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
        for i in range(rows):
            key = mixed(key * GOLDEN + bits[:, :, i])
    return key.view(np.int64)


def sketches(registers: np.ndarray) -> np.ndarray:
    """Two words of one random bit per register, the rest 0; equal registers have equal bits."""
    with np.errstate(over="ignore"):
        bits = (mixed(registers[:, :SKETCH_BITS].copy().view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, SKETCH_BITS - bits.shape[1])))
    return np.packbits(bits, axis=1).copy().view(np.int64)


SIGNED = "doc_id bigint, n bigint, print binary, bands array<bigint>, s0 bigint, s1 bigint"


def signed(docs: DataFrame, *, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, n, print, bands, s0, s1) of every row; ``print`` is a digest of the whole set."""
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SIGNED.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                sets, total, first = [], 0, at
                while at < len(texts) and (not sets or total < ELEMENTS):
                    sets.append(shingles(texts[at], width))
                    total += len(sets[-1])
                    at += 1
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                s0, s1 = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
                if some:
                    registers = signatures([sets[i] for i in some], bands * rows)
                    for i, key in zip(some, band_keys(registers, bands, rows).tolist(), strict=True):
                        keys[i] = key
                    s0[some], s1[some] = sketches(registers).T
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                        pa.array(keys, type=pa.list_(pa.int64())),
                        pa.array(s0),
                        pa.array(s1),
                    ],
                    names=names,
                )

    rows_ = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows_.mapInArrow(run, SIGNED)


def room(percent: int):
    """Whether two nodes may be linked: exact for sizes, five and a half deviations for sketches."""
    p, bits = (1 - percent / 100) / 2, sketch_bits(percent)
    most = math.floor(bits * p + 5.5 * math.sqrt(bits * p * (1 - p)))
    apart = F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) + F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * percent) & (apart <= most)


def side(members: DataFrame, name: str) -> DataFrame:
    return members.select(*[F.col(c).alias(f"{name}_{c}") for c in members.columns])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left, right = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, type=pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, element, at, size): of every set, its rarest elements with their places, so many that
    two sets at the threshold must have one of them in common.

    That holds for any order of the elements.  They are ordered by counters of a fixed number, so
    near copies that differ too much have rare elements of their own in front.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for elements in batch.column(0).to_pylist():
                np.add.at(counts, (np.frombuffer(elements, dtype=np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["c", "n"])

    table = sets.select("elements").mapInArrow(counted, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = np.zeros(COUNTERS, dtype=np.float32)
    counts[table["c"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.float32)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for node, elements in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(elements, dtype=np.uint64)
                size = len(own) - -(-percent * len(own) // 100) + 1
                first = np.lexsort((own, order[(own % np.uint64(COUNTERS)).astype(np.int64)]))[:size]
                row = [np.full(size, node), own[first].view(np.int64), np.arange(size), np.full(size, len(own))]
                for part, values in zip(parts, row, strict=True):
                    part.append(values)
            if parts[0]:
                columns = [pa.array(np.concatenate(part), type=pa.int64()) for part in parts]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "element", "at", "size"])

    return sets.select("node", "elements").mapInArrow(run, "node bigint, element bigint, at bigint, size bigint")


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: (node, root) pairs that join what the edges join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*pairs, strict=True)], names=["u", "v"])

    return edges.toDF("u", "v").mapInArrow(run, "u bigint, v bigint")


def groups(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the least node of its group.

    Partitions are joined by alternating large and small stars: every node hands its larger, then
    its smaller neighbours to the least node it knows.  Minima are partial aggregates, so a node
    with very many links is spread over tasks.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("u", "v")
        if large:
            both = both.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        handed = both.join(least, "u")
        if large:
            out = handed.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = handed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    pairs = stored(forest(edges), "minhash-forest")
    while True:
        # Pairs are distinct, so as many that are all there before are the same ones.
        handed = stored(stars(stars(pairs, True), False), "minhash-stars")
        if handed.count() == pairs.count() and handed.join(pairs, ["u", "v"], "left_anti").isEmpty():
            return handed.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs = handed


def grouped(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = stored(signed(docs, doc_id=doc_id, text=text, width=width, percent=percent), "minhash-rows")
    nodes = stored(
        rows.where("doc_id IS NOT NULL AND n > 0")
        .groupBy("print")
        .agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "bands", "s0", "s1")]),
        "minhash-nodes",
    )
    each = nodes.select(F.explode("bands").alias("bucket"), "node")
    leaders = each.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    shared = stored(each.join(leaders.select("bucket", "leader"), "bucket"), "minhash-buckets")
    facts = nodes.select("node", "n", "s0", "s1")
    star = (
        shared.where("leader <> node")
        .select(F.col("leader").alias("a_node"), F.col("node").alias("b_node"))
        .distinct()
        .join(side(facts, "a"), "a_node")
        .join(side(facts, "b"), "b_node")
        .where(room(percent))
        .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    )
    sets = stored(node_sets(docs, nodes, shared, doc_id=doc_id, text=text, width=width), "minhash-sets")
    first = stored(verified(star, sets, percent), "minhash-links")
    roots = groups(first)
    # The nodes of buckets that still hold several groups are compared across groups.
    placed = (
        shared.select("bucket", "node")
        .join(roots, "node", "left")
        .select("bucket", "node", F.coalesce("root", "node").alias("root"))
    )
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    members = stored(
        placed.join(split, "bucket").select("node", "root").distinct().join(facts, "node"), "minhash-open"
    )
    marked = prefixes(sets.join(members.select("node").distinct(), "node"), percent)
    keyed = stored(marked.join(members, "node"), "minhash-prefixes")
    # After the first common element no more can be common than either set has left.
    left = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    enough = left * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent
    across = side(keyed, "a").join(side(keyed, "b"), F.col("a_element") == F.col("b_element")).where(
        (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & enough & room(percent)
    )
    rest = across.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    second = stored(verified(rest, sets, percent), "minhash-more-links")
    more = second.join(first, ["a", "b"], "left_anti")
    links = first.unionByName(second) if more.head(1) else first
    final = groups(links) if links is not first else roots
    named = nodes.select("print", "node").join(final, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    out = rows.select("doc_id", "n", "print").join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        F.col("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def node_sets(docs: DataFrame, nodes: DataFrame, shared: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, elements) of the nodes that share a bucket, read again from their texts."""
    wanted = shared.select("node").distinct().join(nodes.select("node", "print"), "node")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text_, print_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                elements = shingles(text_, width).tobytes()
                if xxhash.xxh3_128_digest(elements) == print_:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node], type=pa.int64()), pa.array([elements], type=pa.binary())], names=["node", "elements"]
                    )

    found = rows.join(wanted, "node").select("node", "text", "print").mapInArrow(run, "node bigint, elements binary")
    return found.distinct()
