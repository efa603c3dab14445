"""Repeated passages by super-k-mers: windows that share a minimiser meet in its bucket, as one string.

A window is ``width`` consecutive words of a text, words being what stands between ASCII white
space.  A window is a repeat if the same words also make a window of a document with a smaller ID;
the words that repeats cover are removed.  Windows are judged on the input, not on what is left.

The minimiser of a window is the least hash of the ``gram``-word sequences in it.  Consecutive
windows with one minimiser make a super-k-mer.  First only minimisers and places are told apart:
equal texts are one, with the smallest ID that has it, and a minimiser that no two IDs share can
hold no repeat.  The other super-k-mers travel to their bucket, each as one string of its words.
There windows are sorted exactly, by ranks of words, then of word sequences of doubling length.

A bucket with more than ``PART`` super-k-mers is cut into parts by text.  A repeat within a part is
one anyway; what is the first of its part is compared across parts by the SHA-256 of its words, at
most one window per part, text and place, so a passage in a third of all texts never meets in one
task.  Only texts with shared minimisers are read again, and texts with repeats once more to cut
them.

Rows without an ID give nothing and lose nothing; null and empty texts have no words.  Rows that
share an ID never repeat each other, whether their texts are equal or not.  A text of fewer words
than a window is kept whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import CHARS_AT_ONCE, stored

WIDTH = 50
GRAM = 12
#: Super-k-mers of a bucket that one task compares.
PART = 500
#: Windows of a super-k-mer at most; a longer run goes on in the next one.
LONGEST = 256
#: Words that a bucket task ranks at once, unless one part has more.
AT_ONCE = 500_000
#: Super-k-mers that a task hands on at once.
ROWS_AT_ONCE = 5_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").hexdigest()


def one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def print_of(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def minimisers(hashed: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The least hash of ``gram`` words in every window of ``width`` words."""
    with np.errstate(over="ignore"):
        # Sequences of doubling length, then the last overlap that makes ``gram``.
        length, value = 1, hashed
        while length < gram:
            step = min(length, gram - length)
            value = mixed(value[:-step] * MULTIPLIER + value[step:])
            length += step
    span, length = width - gram + 1, 1
    while length < span:
        step = min(length, span - length)
        value = np.minimum(value[:-step], value[step:])
        length += step
    return value


def runs(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal values, cut at ``longest``."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.concatenate([edges, [len(values)]]))
    pieces = -(-lengths // longest)
    owner = np.repeat(np.arange(len(edges)), pieces)
    nth = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
    return edges[owner] + nth * longest, np.minimum(lengths[owner] - nth * longest, longest)


ROWS = "doc_id bigint, print binary, n_words bigint, whole string, minimiser array<bigint>, first array<int>, size array<int>"


def described(docs: DataFrame, *, doc_id: str, text: str, width: int, gram: int) -> DataFrame:
    """Every row with the digest of its words, and minimiser, first window and length of its
    super-k-mers; rows without an ID have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in ROWS.split(", ")]
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                out: list[list] = [[], [], [], [], []]
                begin, chars = at, 0
                while at < whole.num_rows and (at == begin or chars < CHARS_AT_ONCE):
                    text_ = whole.column(2)[at].as_py()
                    words = words_of(text_)
                    chars += len(text_ or "")
                    found: list = [None, None, None]
                    if len(words) >= width and whole.column(0)[at].is_valid:
                        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
                        least = minimisers(hashed, width, gram).view(np.int64)
                        first, size = runs(least, LONGEST)
                        found = [least[first], first.astype(np.int32), size.astype(np.int32)]
                    row = [len(words), hashlib.sha256(b" ".join(words)).hexdigest(), *found]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += 1
                types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                own = [whole.column(c).slice(begin, at - begin) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, type=t) for v, t in zip(out, types, strict=True)]], names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), print_of(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ROWS)


def places(rows: DataFrame) -> DataFrame:
    """(print, doc, minimiser, first, size): the super-k-mers of each different text, under the
    smallest ID that has it."""
    own = rows.where("doc_id IS NOT NULL AND minimiser IS NOT NULL")
    texts = own.groupBy("print").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("minimiser", "first", "size")])
    each = F.explode(F.arrays_zip("minimiser", "first", "size")).alias("s")
    return texts.select("print", "doc", each).select("print", "doc", "s.minimiser", "s.first", "s.size")


def shared(found: DataFrame) -> DataFrame:
    """The super-k-mers whose minimiser two IDs have, with the part of the bucket they belong to."""
    bucket = found.groupBy("minimiser").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    kept = bucket.where("lo < hi").select("minimiser", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    return found.join(kept, "minimiser").withColumn("part", part)


PACKED = "minimiser bigint, part int, split boolean, print binary, doc bigint, first int, words binary"


def packed(docs: DataFrame, wanted: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """The wanted super-k-mers with their words as one string."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), print_of(F.col(text)).alias("print"), F.col(text).alias("text"))
    per_text = wanted.groupBy("print", "doc").agg(F.collect_list(F.struct("minimiser", "part", "parts", "first", "size")).alias("s"))
    both = rows.where("text IS NOT NULL").join(per_text, ["print", "doc"])
    both = both.select("print", "doc", "text", *[F.col(f"s.{c}").alias(c) for c in ("minimiser", "part", "parts", "first", "size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in PACKED.split(", ")]
        for batch in batches:
            held: list[pa.RecordBatch] = []
            for i in range(batch.num_rows):
                row = [batch.column(c)[i] for c in range(8)]
                words = words_of(row[2].as_py())
                first, size = (row[c].values.to_numpy() for c in (6, 7))
                strings = [b" ".join(words[a : a + n + width - 1]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                n = len(strings)
                columns = [
                    row[3].values,
                    row[4].values,
                    pa.array(row[5].values.to_numpy() > 1),
                    pa.array([row[0].as_py()] * n, type=pa.binary()),
                    pa.array(np.full(n, row[1].as_py())),
                    row[6].values,
                    pa.array(strings, type=pa.binary()),
                ]
                held.append(pa.RecordBatch.from_arrays(columns, names=names))
                if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                    yield one_batch(held)
                    held = []
            if held:
                yield one_batch(held)

    return both.mapInArrow(run, PACKED)


def window_ranks(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` codes, equal for equal windows only."""
    rank, length = codes, 1
    while length < width:
        step = min(length, width - length)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank, length = np.unique(pair, return_inverse=True)[1], length + step
    return rank


def judged(strings: list[bytes], doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(super-k-mer, window in it, repeat, first of its kind) of all windows of the given strings."""
    codes: dict[bytes, int] = {}
    split = [s.split() for s in strings]
    lengths = np.array([len(s) for s in split])
    flat = np.fromiter((codes.setdefault(w, len(codes)) for s in split for w in s), dtype=np.int64, count=int(lengths.sum()))
    rank = window_ranks(flat, width)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(strings)), lengths - width + 1)
    inside = np.arange(len(owner)) - (np.cumsum(lengths - width + 1) - (lengths - width + 1))[owner]
    own = rank[starts[owner] + inside]
    least = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, own, doc[owner])
    return owner, inside, least[own] < doc[owner], own


FOUND = "print binary, doc bigint, first int, last int, window binary"


def compared(super_kmers: DataFrame, *, width: int) -> DataFrame:
    """Of every bucket part: (print, first, last) word of runs of repeats, and of parts of split
    buckets the windows that are no repeat within it, with their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in FOUND.split(", ")]

        def result(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = one_batch(rows)
            doc, first = (batch.column(c).to_numpy() for c in (4, 5))
            strings, split, prints = batch.column(6).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            owner, inside, repeat, _ = judged(strings, doc, width)
            # Runs of consecutive repeats of one super-k-mer.
            joined = repeat[1:] & repeat[:-1] & (owner[1:] == owner[:-1])
            begins = np.flatnonzero(repeat & ~np.concatenate([[False], joined]))
            ends = np.flatnonzero(repeat & ~np.concatenate([joined, [False]]))
            open_ = np.flatnonzero(~repeat & split[owner])
            at = np.concatenate([begins, open_])
            last = np.concatenate([ends, open_])
            k = owner[at]
            digests: list = [None] * len(begins)
            cut: tuple[int, list[bytes]] = (-1, [])
            for o, i in zip(owner[open_].tolist(), inside[open_].tolist(), strict=True):
                if cut[0] != o:
                    cut = (o, strings[o].split())
                digests.append(hashlib.sha256(b" ".join(cut[1][i : i + width])).digest())
            columns = [
                prints.take(pa.array(k)),
                pa.array(doc[k]),
                pa.array((first[k] + inside[at]).astype(np.int32)),
                pa.array((first[k] + inside[last] + width - 1).astype(np.int32)),
                pa.array(digests, type=pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: list[pa.RecordBatch] = []
        size, key = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            minimiser, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # A new bucket or part begins: only there may the rows be told apart.
            fresh = np.concatenate([[key is None or (minimiser[0], part[0]) != key], (minimiser[1:] != minimiser[:-1]) | (part[1:] != part[:-1])])
            lengths = np.cumsum(pc.binary_length(batch.column(6)).to_numpy() // 6)
            begin, before = 0, 0
            for at in np.flatnonzero(fresh).tolist():
                upto = int(lengths[at - 1]) if at else 0
                if size + upto - before >= AT_ONCE and (held or at > begin):
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield result(held)
                    held, size, begin, before = [], 0, at, upto
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += int(lengths[-1]) - before
                key = (minimiser[-1], part[-1])
        if held:
            yield result(held)

    keys = ["minimiser", "part"]
    return super_kmers.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, FOUND)


def ranges(found: DataFrame) -> DataFrame:
    """(print, doc, first, last) of all repeats, those across parts included."""
    within = found.where("window IS NULL").select("print", "doc", "first", "last")
    heads = found.where("window IS NOT NULL")
    least = heads.groupBy("window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("window", "lo")
    across = heads.join(least, "window").where(F.col("doc") > F.col("lo")).select("print", "doc", "first", "last")
    return within.unionByName(across)


CUT = "print binary, doc bigint, n_removed bigint, kept_sha256 string, kept string"


def cut(docs: DataFrame, found: DataFrame, *, doc_id: str, text: str, texts: bool) -> DataFrame:
    """(print, doc, n_removed, kept_sha256, kept) of the texts with repeats; ``kept`` is the words
    left, if ``texts`` are asked for."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), print_of(F.col(text)).alias("print"), F.col(text).alias("text"))
    per_text = found.groupBy("print", "doc").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    both = rows.where("text IS NOT NULL").join(per_text, ["print", "doc"]).select("print", "doc", "text", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column(2)[i].as_py())
                first, last = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, last + 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                left = b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8") if texts else None)
            columns = [batch.column(0), batch.column(1), pa.array(removed, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(kept, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in CUT.split(", ")])

    return both.mapInArrow(run, CUT)


def deduplicated(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, texts: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row.

    ``kept_sha256`` is the digest of the words left, joined by one space.  With ``texts``, ``kept``
    is that text where some words are removed and some left, the empty text where all are removed
    and null where none is.
    """
    if not 1 <= gram <= width:
        raise ValueError("a window must hold the words of a minimiser")
    rows = stored(described(docs, doc_id=doc_id, text=text, width=width, gram=gram), "super-kmer-rows")
    wanted = shared(places(rows))
    found = stored(compared(packed(docs, wanted, doc_id=doc_id, text=text, width=width), width=width), "super-kmer-windows")
    left = stored(cut(docs, ranges(found), doc_id=doc_id, text=text, texts=texts).dropDuplicates(["print", "doc"]), "super-kmer-cut")
    owners = rows.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("owner"))
    own = left.select("print", F.col("doc").alias("cut_doc"), "n_removed", "kept_sha256", "kept")
    named = owners.join(own, "print", "left")
    out = rows.select("doc_id", "print", "n_words", "whole").join(named, "print", "left")
    # A copy of a smaller ID's text repeats it from its first window to its last.
    copy = F.coalesce((F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= width), F.lit(False))
    part = F.coalesce((F.col("doc_id") == F.col("cut_doc")), F.lit(False))
    n_removed = F.when(copy, F.col("n_words")).when(part, F.col("n_removed")).otherwise(F.lit(0).cast("bigint"))
    digest = F.when(copy, F.lit(EMPTY)).when(part, F.col("kept_sha256")).otherwise(F.col("whole"))
    kept = F.when(copy, F.lit("")).when(part, F.col("kept"))
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), digest.alias("kept_sha256"), kept.alias("kept"))
