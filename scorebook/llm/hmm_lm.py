"""Language-model scoring with a hidden Markov model over words.

A word falls into one of a fixed number of classes by its hash; the end of a text has a class of its
own.  Hidden states emit classes (Baum-Welch), a class emits its words by their smoothed counts over
all training texts, so a text's probability is that of its classes, summed exactly over all state
paths, times that of its words within their classes.

Texts are kept in blocks of a bounded number of words, each with a dictionary of its distinct words.
Corpus counts go back to the blocks by one shuffle of dictionary entries, never of words, and no
vocabulary is broadcast.  Expected counts of an iteration are sums over a fixed number of cells.

A null text counts as empty and is the end token alone.  Rows without an ID are scored and not
learned.  Repeated rows count each.  Without training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import held_out, learnable, stored

CLASSES = 2048
STATES = 6
BLOCK = 1 << 19
#: Words of a text that one vector recursion runs over; longer texts are chained by matrices.
STRETCH = 512
#: Words after which a recursion is scaled; factors of 1e-30 or more then stay within a double.
SCALED = 8
#: Words whose shares of states are gathered before they are added to the classes.
JOINT = 1 << 13
END = xxhash.xxh3_64_intdigest(b"\n")
ALPHA = 0.1
#: Classes of the table of neighbours, and rounds over that table.
COARSE = 256
PAIR_ROUNDS = 200
#: Tasks that add up what the tasks over blocks have counted.
GATHERERS = 16


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def classes(words: np.ndarray) -> np.ndarray:
    """The class of each hashed word."""
    return np.where(words == np.uint64(END), CLASSES, (words >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.uint16)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in lower case (A to Z alone), then the end."""
    words = (text or "").encode("utf-8").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


BLOCKS = "block bigint, ids array<string>, learn array<boolean>, lengths array<int>, places binary, words binary, counts binary, kinds binary, entries int"


def blocks(docs: DataFrame, *, doc_id: str, text: str, modulus: int, remainder: int) -> DataFrame:
    """Texts in blocks: ``places`` are the words of all texts as positions in the block's
    dictionary, whose ``words`` stand by falling frequency, with their training ``counts``."""
    rows = docs.select(
        F.col(doc_id).cast("string").alias("id"),
        learnable(F.col(doc_id), modulus, remainder).alias("learn"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        waiting: list[tuple] = []
        size = 0
        first = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal made
            ids, learn, parts = (list(x) for x in zip(*waiting, strict=True))
            lengths = np.array([len(p) for p in parts], dtype=np.int32)
            words, index, total = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            places, words = rank[index], words[order]
            learned = np.repeat(np.array(learn), lengths)
            counts = np.bincount(places[learned], minlength=len(words)).astype(np.uint32)
            made += 1
            values = [first + made, ids, learn, lengths.tolist(), packed(places), packed(words), packed(counts), packed(classes(words)), len(words)]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.int32()]
            names = ["block", "ids", "learn", "lengths", "places", "words", "counts", "kinds", "entries"]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for i, known, text_ in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                words = tokens(text_)
                if waiting and size + len(words) > BLOCK:
                    yield block()
                    waiting, size = [], 0
                waiting.append((i, known, words))
                size += len(words)
        if waiting:
            yield block()

    return stored(rows.mapInArrow(run, BLOCKS), "hmm-blocks")


def entries(table: DataFrame) -> DataFrame:
    """(word, block, place, n): every dictionary entry with its training count in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hashed = unpacked(words, "u8").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashed),
                        pa.array(np.full(len(hashed), block, dtype=np.int64)),
                        pa.array(np.arange(len(hashed), dtype=np.int32)),
                        pa.array(unpacked(counts, "u4").astype(np.int32)),
                    ],
                    names=["word", "block", "place", "n"],
                )

    return table.select("block", "words", "counts").mapInArrow(run, "word bigint, block bigint, place int, n int")


def counted(table: DataFrame) -> DataFrame:
    """(word, block, place, c): entries with the word's training count over the corpus.

    A word has one entry in each block at most, so no word has more than a millionth of the rows.
    """
    everywhere = Window.partitionBy("word")
    return entries(table).select("word", "block", "place", F.sum("n").over(everywhere).alias("c"))


def tables(room: dict[str, np.ndarray], name: str, states: int, active: list[int]) -> list[np.ndarray]:
    """A table for every step, states by active stretches, one behind the other in memory that
    ``room`` keeps for the next call."""
    cells = states * sum(active)
    if name not in room or len(room[name]) < cells:
        room[name] = np.empty(cells)
    at = np.concatenate([[0], np.cumsum(active, dtype=np.int64)]) * states
    return [room[name][a:b].reshape(states, n) for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), active, strict=True)]


def vectors(
    kinds: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, learn: bool,
    room: dict[str, np.ndarray] | None = None,
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """Natural log-likelihood of each text's classes, exactly; with ``learn`` also the expected
    counts of starts, moves and emissions.

    Texts are cut into stretches that all advance together, the longest first, and words lie in
    the order the recursion takes them: every stretch's first, every stretch's second, and so on.
    One step is a few operations on neighbouring cells, states by stretches.  The stretches of a
    long text are chained by their matrices, so its likelihood and its counts are those of the
    whole chain.  States are scaled at every ``SCALED``-th word, on the way back by the same
    numbers.  Calls that share a ``room`` share the memory of the large tables.
    """
    room = {} if room is None else room
    states = len(start)
    pieces = -(-lengths // STRETCH)
    texts = np.repeat(np.arange(len(lengths)), pieces)
    firsts = np.cumsum(pieces) - pieces
    part = np.arange(len(texts)) - firsts[texts]
    begin = (np.cumsum(lengths) - lengths)[texts] + part * STRETCH
    size = np.minimum(lengths[texts] - part * STRETCH, STRETCH)
    # Of a long text all stretches but the last are full: first ones lie first, inner ones next.
    last = part == pieces[texts] - 1
    order = np.lexsort((np.where(last, 2, part > 0), -size))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    size, begin, initial, last = size[order], begin[order], part[order] == 0, last[order]
    steps = int(size.max(initial=0))
    active = (len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")).tolist()
    offset = np.concatenate([[0], np.cumsum(active, dtype=np.int64)]).tolist()
    taken = np.empty(len(kinds), dtype=np.int64)
    for t, n in enumerate(active):
        np.add(begin[:n], t, out=taken[offset[t] : offset[t + 1]])
    kinds = kinds[taken].astype(np.int64)
    factor = tables(room, "factor", states, active)
    emission = np.ascontiguousarray(emit.T)
    for t in range(steps):
        np.take(emission, kinds[offset[t] : offset[t + 1]], axis=1, out=factor[t], mode="clip")
    onward = np.ascontiguousarray(move.T)
    entry = np.where(initial, start[:, None], 0.0)  # the states before the first word's factor
    after = np.ones((states, len(size)))
    if (pieces > 1).any():
        chain(entry, after, factor, start, move, size, initial, last, place, firsts, pieces)

    if learn:
        forward = tables(room, "forward", states, active)
    turns = [np.empty((states, len(size))) for _ in range(2)]
    ends, logs = np.empty((states, len(size))), np.zeros(len(size))
    state = entry
    for t, n in enumerate(active):
        own = forward[t] if learn else turns[t % 2][:, :n]
        np.matmul(onward, state[:, :n], out=own)
        if t == 0:
            own[:, initial] = entry[:, initial]
        own *= factor[t]
        if t % SCALED == SCALED - 1:
            total = own.sum(axis=0)
            own /= total
            logs[:n] += np.log(total)
            if learn:
                factor[t] /= total
        following = active[t + 1] if t + 1 < steps else 0
        if following < n:
            ends[:, following:n] = own[:, following:]
        state = own
    logs += np.log(ends.sum(axis=0))
    per_text = np.bincount(texts, weights=logs[place], minlength=len(lengths))
    if not learn:
        return per_text, None

    # Scaled so that forward and backward multiply to the shares of the states of a word.
    after /= (ends * after).sum(axis=0)
    moves, emitted = np.zeros((states, states)), np.zeros((states, emit.shape[0]))
    rights = np.empty((states, len(size)))
    joint = np.empty((states, max(JOINT, len(size))))  # filled from its end, for the words from ``at`` to ``until``
    at = until = len(kinds)
    kept = 0
    for t in range(steps - 1, -1, -1):
        n = active[t]
        own = turns[t % 2][:, :n]
        if kept < n:
            own[:, kept:] = after[:, kept:n]
        if kept:
            right = np.multiply(state, factor[t + 1], out=rights[:, :kept])
            np.matmul(move, right, out=own[:, :kept])
            moves += forward[t][:, :kept] @ right.T
        if until - offset[t] > joint.shape[1]:
            add_shares(emitted, kinds[at:until], joint)
            until = at
        at = offset[t]
        free = joint.shape[1] - until + at
        np.multiply(forward[t], own, out=joint[:, free : free + n])
        state, kept = own, n
    add_shares(emitted, kinds[at:until], joint)
    # The state before a stretch is the one that its predecessor ended in.
    going = np.flatnonzero(~initial)
    left = ends[:, place[firsts[texts[order[going]]] + part[order[going]] - 1]]
    right = state[:, going] * factor[0][:, going]
    moves += left @ (right / ((onward @ left) * right).sum(axis=0)).T
    moves *= move
    starts = (forward[0] * state)[:, initial].sum(axis=1)
    return per_text, (starts, moves, np.ascontiguousarray(emitted.T))


def add_shares(emitted: np.ndarray, kinds: np.ndarray, joint: np.ndarray) -> None:
    """Add the shares of states of words, the last columns of ``joint``, to those of their classes."""
    first = joint.shape[1] - len(kinds)
    for k, shares in enumerate(joint):
        emitted[k] += np.bincount(kinds, weights=shares[first:], minlength=emitted.shape[1])


def chain(
    entry: np.ndarray, after: np.ndarray, factor: list[np.ndarray], start: np.ndarray, move: np.ndarray, size: np.ndarray,
    initial: np.ndarray, last: np.ndarray, place: np.ndarray, firsts: np.ndarray, pieces: np.ndarray,
) -> None:
    """Fill in what reaches each stretch of a long text from the left and from the right.

    The first stretch of a text passes one vector on and the last one gives one back; only those
    between them need a matrix, a vector for each state that it may begin in.
    """
    states = len(start)
    onward = np.ascontiguousarray(move.T)
    heads, inner = int((initial & ~last).sum()), int((~initial & ~last).sum())
    tails = np.flatnonzero(last & ~initial)

    # Vectors of first stretches, then of inner ones.  Only the direction counts: what arrives is
    # normalised below.
    turns = [np.empty((states, heads + states * inner)) for _ in range(2)]
    views = [(x, x[:, :heads], x[:, heads:].reshape(states, states, inner)) for x in turns]
    for t in range(STRETCH):
        whole, left, matrix = views[t % 2]
        if t == 0:
            left[:] = start[:, None]
            matrix[:] = onward[:, :, None]
        else:
            np.matmul(onward, views[1 - t % 2][0], out=whole)
        left *= factor[t][:, :heads]
        if inner:
            matrix *= factor[t][:, None, heads : heads + inner]
        if t % SCALED == SCALED - 1 or t == STRETCH - 1:
            left /= left.max(axis=0)
            matrix /= matrix.max(axis=(0, 1))
    left /= left.sum(axis=0)

    steps = int(size[tails].max())
    counts = (len(tails) - np.searchsorted(size[tails][::-1], np.arange(steps), side="right")).tolist()
    right, weighted = np.ones((states, len(tails))), np.empty((states, len(tails)))
    for t in range(steps - 1, -1, -1):
        k = counts[t]
        np.multiply(right[:, :k], factor[t].take(tails[:k], axis=1), out=weighted[:, :k])
        np.matmul(move, weighted[:, :k], out=right[:, :k])
        if t % SCALED == 0:
            right[:, :k] /= right[:, :k].max(axis=0)
    right /= right.sum(axis=0)

    where = np.empty(len(size), dtype=np.int64)
    where[tails] = np.arange(len(tails))
    for text in np.flatnonzero(pieces > 1):
        parts = place[firsts[text] : firsts[text] + pieces[text]]
        state = left[:, parts[0]]
        entry[:, parts[1]] = state
        for s, following in zip(parts[1:-1], parts[2:], strict=True):
            state = matrix[:, :, s - heads] @ state
            state = state / state.sum()
            entry[:, following] = state
        ahead = right[:, where[parts[-1]]]
        after[:, parts[-2]] = ahead
        for s, preceding in zip(parts[-2:0:-1], parts[-3::-1], strict=True):
            ahead = ahead @ matrix[:, :, s - heads]
            ahead = ahead / ahead.sum()
            after[:, preceding] = ahead


def cell_sums(table: DataFrame, columns: list[str], size: int, add: Callable[..., np.ndarray | None]) -> np.ndarray:
    """Sums of ``size`` cells over the blocks.

    ``add`` gives a block's cells.  Every task adds up its blocks, ``GATHERERS`` tasks add up the
    sums of tasks, and only theirs, a fixed number of fixed size, come to the driver.
    """

    def summed(rows: Iterator[np.ndarray | None]) -> np.ndarray | None:
        total = None
        for flat in rows:
            if flat is not None:
                total = flat.astype(float) if total is None else total + flat
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(add(*values) for batch in batches for values in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        if total is not None:
            place = TaskContext.get().partitionId() % GATHERERS
            yield pa.RecordBatch.from_arrays([pa.array([place], type=pa.int32()), pa.array([total.tobytes()], type=pa.binary())], names=["place", "cells"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(np.frombuffer(cells.as_py()) for batch in batches for cells in batch.column(0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["cells"])

    parts = table.select(*columns).mapInArrow(run, "place int, cells binary")
    sums = parts.repartition(GATHERERS, "place").select("cells").mapInArrow(gather, "cells binary").toArrow()
    found = summed(np.frombuffer(cells.as_py()) for cells in sums.column(0))
    return np.zeros(size) if found is None else found


def coarse(kinds: np.ndarray) -> np.ndarray:
    """Classes by their number modulo ``COARSE``; the end stays apart."""
    return np.where(kinds == CLASSES, COARSE, kinds % COARSE).astype(np.int64)


def neighbours(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each coarse class follows another in the training texts, and how often it heads one."""
    wide = COARSE + 1

    def add(learn: list, lengths: list, places: bytes, kinds: bytes) -> np.ndarray | None:
        sizes, known = np.array(lengths, dtype=np.int64), np.array(learn, dtype=bool)
        if not known.any():
            return None
        own = coarse(unpacked(kinds, "u2"))[unpacked(places, "u4")][np.repeat(known, sizes)]
        heads = np.cumsum(sizes[known]) - sizes[known]
        inner = np.ones(len(own), dtype=bool)
        inner[heads] = False
        into = np.flatnonzero(inner)
        pairs = np.bincount(own[into - 1] * wide + own[into], minlength=wide * wide)
        return np.concatenate([pairs, np.bincount(own[heads], minlength=wide)])

    flat = cell_sums(table, ["learn", "lengths", "places", "kinds"], wide * wide + wide, add)
    return flat[: wide * wide].reshape(wide, wide), flat[wide * wide :]


def beginning(pairs: np.ndarray, heads: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, moves and emissions from the pairs of neighbours of the whole corpus: Baum-Welch on
    texts of two words, over a table of a fixed size."""
    rng = np.random.default_rng(9)
    group = coarse(np.arange(CLASSES + 1))
    mass = np.bincount(group, weights=shares, minlength=COARSE + 1)
    emit = mass[:, None] * rng.uniform(0.4, 1.6, (COARSE + 1, STATES))
    emit /= emit.sum(axis=0)
    weight, move = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.02) + np.eye(STATES) * (1 - 0.02 * STATES)
    for _ in range(PAIR_ROUNDS):
        first = emit * weight
        second = first @ move
        ratio = pairs / np.maximum(second @ emit.T, 1e-300)
        moves = move * (first.T @ ratio @ emit)
        leads = first * (ratio @ (emit @ move.T))
        emitted = leads + emit * (ratio.T @ second) + 20.0 * mass[:, None]
        weight = (leads.sum(axis=0) + 1.0) / (leads.sum(axis=0) + 1.0).sum()
        move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
        emit = emitted / emitted.sum(axis=0)
    likely = emit * weight
    start = (heads[:, None] * likely / likely.sum(axis=1, keepdims=True)).sum(axis=0) + 1.0
    fine = shares[:, None] * (emit / mass[:, None])[group]
    return start / start.sum(), move, fine / fine.sum(axis=0)


def step(table: DataFrame, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Expected counts over all training texts of the blocks, and their log-likelihood."""
    states = len(start)
    shapes = [(states,), (states, states), emit.shape, ()]
    room: dict[str, np.ndarray] = {}  # filled in a task, for all its blocks

    def add(learn: list, lengths: list, places: bytes, kinds: bytes) -> np.ndarray | None:
        sizes, known = np.array(lengths, dtype=np.int64), np.array(learn, dtype=bool)
        if not known.any():
            return None
        own = unpacked(kinds, "u2")[unpacked(places, "u4")][np.repeat(known, sizes)]
        logs, found = vectors(own, sizes[known], start, move, emit, True, room)
        return np.concatenate([*[f.ravel() for f in found], [logs.sum()]])

    flat = cell_sums(table, ["learn", "lengths", "places", "kinds"], sum(int(np.prod(x)) for x in shapes), add)
    out, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return tuple(out)


def maximised(counts: tuple[np.ndarray, ...], shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parameters from expected counts; emissions lean on the shares of the classes."""
    starts, moves, emitted = counts
    start = (starts + 1.0) / (starts + 1.0).sum()
    move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
    emit = emitted + 20.0 * shares[:, None]
    return start, move, emit / emit.sum(axis=0, keepdims=True)


def scored(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = 10,
    remainder: int = 0,
    rounds: int = 2,
    tolerance: float = 1e-3,
) -> DataFrame:
    """One row per document: ID, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The first parameters come from the counts of neighbouring classes over the whole corpus.  Then
    every Baum-Welch round runs over every training text, at every size, ``rounds`` at least, until
    one adds less than ``tolerance`` to the natural log-likelihood of a training word.
    """
    table = blocks(docs, doc_id=doc_id, text=text, modulus=modulus, remainder=remainder)
    known = stored(counted(table), "hmm-counts")
    vocabulary = known.where(F.col("c") > 0).groupBy("word").agg(F.max("c").alias("c"))
    high = F.pmod(F.shiftrightunsigned(F.col("word"), 40), F.lit(CLASSES))
    end = np.array([END], dtype=np.uint64).view(np.int64)[0]
    kind = F.when(F.col("word") == F.lit(int(end)), CLASSES).otherwise(high)
    by_class = vocabulary.groupBy(kind.alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow().to_pandas()
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    at = by_class["kind"].to_numpy(dtype=np.int64)
    n[at], v[at] = by_class["n"].to_numpy(dtype=float), by_class["v"].to_numpy(dtype=float)
    total, distinct = int(n.sum()), int(v.sum())
    shares = (n + 0.5) / (n + 0.5).sum()

    start, move, emit = beginning(*neighbours(table), shares)
    before, done = -np.inf, 0
    while True:
        *counts, reached = step(table, start, move, emit)
        start, move, emit = maximised(tuple(counts), shares)
        done += 1
        if done >= rounds and not reached - before >= tolerance * max(1, total):
            break
        before = reached

    inside = np.log10(n + ALPHA * (v + 1))
    base = np.log10(total + ALPHA * (distinct + 1))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        counts = right.sort_values("place")["c"].to_numpy(dtype=float)
        logs, seen = np.log10(counts + ALPHA), counts > 0
        for row in left.itertuples(index=False):
            sizes = np.array(row.lengths, dtype=np.int64)
            places = unpacked(row.places, "u4")
            kinds = unpacked(row.kinds, "u2")
            chain, _ = vectors(kinds[places], sizes, start, move, emit, False)
            heads = np.cumsum(sizes) - sizes
            words = np.add.reduceat(logs[places], heads)
            within = np.add.reduceat(inside[kinds][places], heads)
            parts.append(
                pd.DataFrame(
                    {
                        "id": list(row.ids),
                        "n_tokens": sizes,
                        "n_known": np.add.reduceat(seen[places].astype(np.int64), heads),
                        "train_tokens": total,
                        "base_score": words - sizes * base,
                        "score": words - within + chain / np.log(10.0),
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame(columns=["id"])

    out = "id string, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    sides = table.select("block", "ids", "lengths", "places", "kinds").groupBy("block").cogroup(known.select("block", "place", "c").groupBy("block"))
    return sides.applyInPandas(run, out).select(
        F.col("id").cast(id_type).alias(doc_id),
        held_out(F.col("id"), modulus, remainder).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
