"""Collocations from an FM-index per shard: n-grams by bidirectional interval extension, summed.

Texts are lower-cased (A to Z only), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces
and tabs into words; a phrase lies within one piece.  Everything is counted per group (``und`` where
it is null).

A task packs its texts into shards of about ``SHARD`` words of one group; a piece is never cut.  A
shard is indexed over word ids in both directions: suffixes in order with the words in front of
them, and prefixes in order with the words behind them.  A phrase is an interval in each; one
extension to the right or left of all phrases of a length counts the words in their intervals and
gives the intervals of the longer phrases.  Orders are sorted to the depth of the longest phrase,
which is all that intervals of such phrases need.

Counting has two rounds.  In the first every shard gives its words and pairs as 64-bit hashes with
counts, and hashes that sum to the least count over all shards are kept: none of a frequent word or
pair is missing, and one kept by collision is dropped later.  The kept hashes go back to the shards
that have them.  In the second round shards extend only what is kept, and the exact counts of
words and phrases as text are summed.  A phrase is frequent only if each of its pairs is, so no
phrase is lost.  A word or pair of any frequency is one row per shard, so no key gathers more rows
than there are shards.

Null texts count as empty; an empty table gives no rows.  Repeated rows count as often as they
stand there.  A single piece that is longer than a shard makes a longer one, bounded by its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import stored

#: Words of a shard.
SHARD = 1 << 20
#: Shards' worth of words that a task holds open over all groups.
OPEN = 3
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"." * len(ENDS))
END = b"."
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(text: str) -> list[bytes]:
    """Words and ends of pieces; the text ends with one."""
    return text.encode("utf-8").translate(TABLE).replace(END, b" . ").split() + [END]


def depth_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of the ``depth`` ids that start there."""
    size = int(ids.max(initial=0)) + 1
    key, most = ids.copy(), size
    for step in range(1, depth):
        if most > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max(initial=0)) + 1
        following = np.zeros_like(ids)
        following[:-step] = ids[step:]
        key, most = key * size + following, most * size
    return np.argsort(key, kind="stable")


class Half:
    """One direction of the index: places in order and the id in front of each."""

    def __init__(self, ids: np.ndarray, depth: int):
        order = depth_order(ids, depth)
        self.front = ids[order - 1]
        self.size = len(ids)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        placed = np.argsort(self.front, kind="stable")
        # Sorted, so the number of an id above a place is found by bisection.
        self.occurrences = self.front[placed] * self.size + placed

    def above(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each id stands in front of a row above the place."""
        return np.searchsorted(self.occurrences, ids * self.size + places) - self.starts[ids]


@dataclass
class Phrases:
    """Phrases of one length: their words and their intervals in both directions."""

    words: list[np.ndarray]
    low: np.ndarray
    mirror: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases([w[keep] for w in self.words], self.low[keep], self.mirror[keep], self.count[keep])


class Index:
    """A shard's index in both directions; ``ids`` start and end with 0."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.forward = Half(ids, depth)
        self.backward = Half(ids[::-1].copy(), depth)

    def words(self) -> Phrases:
        starts = self.forward.starts
        ids = np.arange(1, len(starts) - 1)
        return Phrases([ids], starts[1:-1].copy(), starts[1:-1].copy(), np.diff(starts)[1:])

    def extended(self, phrases: Phrases, *, left: bool) -> Phrases:
        """All phrases one word longer to one side, with the intervals of both directions."""
        half = self.forward if left else self.backward
        low, mirror = (phrases.low, phrases.mirror) if left else (phrases.mirror, phrases.low)
        owner = np.repeat(np.arange(len(low)), phrases.count)
        first = np.cumsum(phrases.count) - phrases.count
        places = np.arange(len(owner)) - first[owner] + low[owner]
        pair, count = np.unique(owner * len(half.starts) + half.front[places], return_counts=True)
        owner, word = np.divmod(pair, len(half.starts))
        # In the other direction the longer phrases lie in the order of the word added.
        upto = np.cumsum(count) - count
        other = mirror[owner] + upto - first[owner]
        some = word > 0
        owner, word, count, other = owner[some], word[some], count[some], other[some]
        own = half.starts[word] + half.above(word, low[owner])
        old = [w[owner] for w in phrases.words]
        return Phrases([word, *old] if left else [*old, word], *((own, other) if left else (other, own)), count)


SHARDS = "shard bigint, grp string, n bigint, words array<binary>, ids binary"


def shards(docs: DataFrame, *, group: Column, text: str, size: int = SHARD) -> DataFrame:
    """The texts of each group, packed into shards by the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[Ids, list[np.ndarray]]] = {}
        filled: dict[str, int] = {}

        def packed(grp: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            vocabulary, parts = open_.pop(grp)
            filled.pop(grp)
            ids = np.concatenate(parts)
            row = [part << 32 | made, grp, np.count_nonzero(ids), list(vocabulary)[1:], ids.tobytes()]
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
            names = ["shard", "grp", "n", "words", "ids"]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for grp, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(text_.as_py() or "")
                at = 0
                while at < len(found):
                    if grp not in open_:
                        open_[grp], filled[grp] = (Ids({END: 0}), [np.zeros(1, dtype=np.int32)]), 1
                    vocabulary, parts = open_[grp]
                    # A long text fills shard after shard, each up to the end of a piece.
                    upto = min(at + max(size - filled[grp], 1), len(found))
                    upto = found.index(END, upto - 1) + 1
                    ids = np.fromiter(map(vocabulary.__getitem__, found[at:upto]), dtype=np.int32, count=upto - at)
                    keep = ids != 0
                    keep[1:] |= ids[:-1] != 0
                    keep[0] |= parts[-1][-1] != 0
                    if keep.any():
                        parts.append(ids[keep])
                        filled[grp] += int(keep.sum())
                    at = upto
                    if filled[grp] >= size:
                        yield packed(grp)
                    elif sum(filled.values()) >= OPEN * size:
                        # With many groups at once the fullest one makes room.
                        yield packed(max(filled, key=filled.__getitem__))
        for grp in list(open_):
            if filled[grp] > 1:
                yield packed(grp)

    return docs.select(F.coalesce(group.cast("string"), F.lit("und")).alias("grp"), F.col(text).alias("text")).mapInArrow(run, SHARDS)


def hashes(words: list[bytes], grp: str) -> np.ndarray:
    """64-bit hashes of words by id; 0 for the end of a piece."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(grp.encode("utf-8"))
    return np.array([0, *[xxhash.xxh3_64_intdigest(w, seed=seed) for w in words]], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * GOLDEN + second)


def opened(ids: bytes, depth: int) -> Index:
    return Index(np.frombuffer(ids, dtype=np.int32).astype(np.int64), depth)


def hashed_counts(packed: DataFrame) -> DataFrame:
    """(key, shard, n): words and pairs of each shard as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, grp, words, ids = (batch.column(c)[i] for c in range(4))
                index = opened(ids.as_py(), 2)
                single = index.words()
                double = index.extended(single, left=False)
                own = hashes(words.as_py(), grp.as_py())
                key = np.concatenate([own[1:], pair_hashes(own[double.words[0]], own[double.words[1]])])
                count = np.concatenate([single.count, double.count])
                for lo in range(0, len(key), 1 << 17):
                    part = slice(lo, lo + (1 << 17))
                    name = pa.array(np.full(len(key[part]), shard.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), name, pa.array(count[part])], names=["key", "shard", "n"])

    return packed.select("shard", "grp", "words", "ids").mapInArrow(run, "key bigint, shard bigint, n bigint")


COUNTED = "grp string, size int, phrase binary, n bigint"


def exact_counts(packed: DataFrame, kept: DataFrame, *, longest: int) -> DataFrame:
    """(grp, size, phrase, n) of each shard, for phrases all of whose words and pairs are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, words, ids, keys = (batch.column(c)[i] for c in range(4))
                words = words.as_py()
                own = hashes(words, grp.as_py())
                frequent = np.sort(keys.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

                def known(key: np.ndarray, frequent: np.ndarray = frequent) -> np.ndarray:
                    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
                    return frequent[at] == key

                index = opened(ids.as_py(), longest)
                phrases = index.words()
                phrases = phrases.where(known(own[phrases.words[0]]))
                for size in range(1, longest + 1):
                    if size > 1:
                        left = size % 2 == 1
                        phrases = index.extended(phrases, left=left)
                        ends = phrases.words[:2] if left else phrases.words[-2:]
                        phrases = phrases.where(known(pair_hashes(own[ends[0]], own[ends[1]])))
                    for lo in range(0, len(phrases.count), 1 << 16):
                        part = slice(lo, lo + (1 << 16))
                        columns = [w[part].tolist() for w in phrases.words]
                        text = [b" ".join([words[c - 1] for c in row]) for row in zip(*columns, strict=True)]
                        n = len(text)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([grp.as_py()] * n, type=pa.string()), pa.array([size] * n, type=pa.int32()), pa.array(text, type=pa.binary()), pa.array(phrases.count[part])],
                            names=["grp", "size", "phrase", "n"],
                        )

    return packed.join(kept, "shard").select("grp", "words", "ids", "keys").mapInArrow(run, COUNTED)


def counts(docs: DataFrame, *, group: Column, text: str = "text", longest: int = 3, least: int = 10, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(grp, size, phrase, n) of all words and phrases that occur ``least`` times or more, and
    (grp, n) with all word occurrences."""
    packed = stored(shards(docs, group=group, text=text, size=size), "phrases-shards")
    # One shuffle gives both the sum of a key and the shards that have it.
    whole = F.sum("n").over(Window.partitionBy("key"))
    often = hashed_counts(packed).withColumn("whole", whole).where(F.col("whole") >= least)
    kept = often.groupBy("shard").agg(F.collect_list("key").alias("keys"))
    parts = exact_counts(packed, stored(kept, "phrases-kept"), longest=longest)
    summed = parts.groupBy("grp", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = packed.groupBy("grp").agg(F.sum("n").alias("n"))
    return stored(summed.withColumn("phrase", F.col("phrase").cast("string")), "phrases-counts"), stored(words, "phrases-totals")


def rated(counted: DataFrame) -> DataFrame:
    """(grp, size, phrase, a, l, r, score): every phrase with its lowest-scoring cut.

    ``score`` is floor(1000000 a a / (l r)) in whole numbers of up to 38 digits.
    """
    phrases = counted.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select(
        "grp", "size", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "grp", "size", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("tail"),
    )
    heads = counted.select("grp", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counted.select("grp", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    both = cuts.join(heads, ["grp", "head"]).join(tails, ["grp", "tail"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    both = both.withColumns({"above": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "below": l * r})
    both = both.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return both.groupBy("grp", "size", "phrase").agg(F.first("a").alias("a"), lowest).select(
        "grp", "size", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score")
    )


def absorbed(counted: DataFrame, *, percent: int) -> DataFrame:
    """(grp, phrase) of phrases that lie in a longer one of at least ``percent`` of their count."""
    longer = counted.where("size > 2").withColumn("w", F.split("phrase", " "))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")),
        )
    )
    most = longer.select("grp", F.explode(inner).alias("phrase"), F.col("n").alias("most")).groupBy("grp", "phrase").agg(F.max("most").alias("most"))
    own = counted.where("size > 1").select("grp", "phrase", "n")
    return own.join(most, ["grp", "phrase"]).where(F.col("most") * 100 >= F.col("n") * percent).select("grp", "phrase")


def collocations(
    docs: DataFrame, *, group: Column, text: str = "text", longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, size: int = SHARD
) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each group by score, then
    count, then bytes."""
    counted, words = counts(docs, group=group, text=text, longest=longest, least=least, size=size)
    rest = rated(counted).join(absorbed(counted, percent=percent), ["grp", "phrase"], "left_anti")
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "grp").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
