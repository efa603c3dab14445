"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question and the same question with other
parameters are one template.  Windows of a template are joined by hash with those of the benchmark;
a document has an item if some occurrence in it has enough of the item's windows with consistent
slots: one value of the item always stands for one value of the document, and the reverse.  Other
occurrences, and stray windows with other values, take nothing from it.

Windows of plain words in lower case are joined too, so a verbatim copy is found whatever stands in
front of it and however it is cased; such a window has the item's own values in its slots.

A name is a capitalised word that does not begin a sentence; a unit is a word of a fixed list next
to a number.  Windows with fewer literal words than placeholders say too little and are left out;
an item shorter than a window is one window.  An item without any other window, or of fewer than
``LEAST`` words, has its plain windows alone: it is found verbatim, with its own values.
Null and empty texts have no windows.  Repeated rows are judged row by row; other columns of the
documents pass through, and ``hits`` takes the place of a column with its name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import by_text, stored, without
from scorebook.llm.superminhash import GOLDEN, mixed

WINDOW = 8
LEAST = 4
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]|[.!?\n]")
UNITS = frozenset(
    "% $ € £ ° kg g mg t lb lbs oz km m cm mm mi ft in l ml s ms h min sec hour hours minute minutes second "
    "seconds day days week weeks month months year years mile miles meter meters metre metres foot feet inch "
    "inches gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent "
    "degree degrees mph kmh".split()
)
STOP, LITERAL, NAME, NUMBER, UNIT = range(5)
BLOOM_BITS = 1 << 24
BLOOM_KEYS = 3
#: Distinct tokens that a worker remembers.
REMEMBERED = 200_000
TEXTS_AT_ONCE = 256


class Tokens(dict):
    """Tokens numbered as they are met, with the kind and the hash of each."""

    def __init__(self):
        super().__init__()
        self.kinds: list[int] = []
        self.hashes: list[int] = []

    def forget(self) -> None:
        self.clear()
        self.kinds, self.hashes = [], []

    def __missing__(self, token: str) -> int:
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit():
            kind = NUMBER
        elif token.lower() in UNITS:
            kind = UNIT
        elif token[0].isupper() and (len(token) == 1 or token[1:].islower()):
            kind = NAME
        else:
            kind = LITERAL
        self[token] = len(self.kinds)
        self.kinds.append(kind)
        self.hashes.append(xxhash.xxh3_64_intdigest(token.lower().encode("utf-8")))
        return self[token]


def canonical(texts: list[str], memory: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, kind, template hash, value hash) of the tokens of all texts, stops left out."""
    rows = [list(map(memory.__getitem__, TOKEN.findall(t))) for t in texts]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    ids = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = np.array(memory.kinds, dtype=np.int8)[ids] if len(ids) else np.empty(0, dtype=np.int8)
    value = np.array(memory.hashes, dtype=np.uint64)[ids] if len(ids) else np.empty(0, dtype=np.uint64)
    if not len(ids):
        return owner, kind, value, value
    heads = np.ones(len(ids), dtype=bool)
    heads[1:] = (owner[1:] != owner[:-1]) | (kind[:-1] == STOP)
    kind = np.where((kind == NAME) & heads, LITERAL, kind)
    number = kind == NUMBER
    near = np.zeros(len(ids), dtype=bool)
    near[1:] |= number[:-1]
    near[:-1] |= number[1:]
    kind = np.where((kind == UNIT) & ~near, LITERAL, kind)
    keep = kind != STOP
    owner, kind, value = owner[keep], kind[keep], value[keep]
    return owner, kind, np.where(kind == LITERAL, value, kind.astype(np.uint64)), value


def window_hashes(owner: np.ndarray, kind: np.ndarray, template: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of the telling windows of ``width`` tokens inside one text."""
    n = len(owner) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    hashed = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            hashed = mixed(hashed * GOLDEN + template[i : n + i])
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    telling = (2 * (literal[width:] - literal[:-width]) >= width) & (owner[:n] == owner[width - 1 :])
    begin = np.flatnonzero(telling)
    return begin, hashed[begin]


def plain_hashes(owner: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of all windows of ``width`` words as they are, in lower case."""
    return window_hashes(owner, np.full_like(kind, LITERAL), value, width)


def typed_hashes(owner: np.ndarray, kind: np.ndarray, template: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of the telling windows that have slots; without any they are plain ones."""
    begin, hashed = window_hashes(owner, kind, template, width)
    slots = np.concatenate([[0], np.cumsum(kind != LITERAL)])
    slotted = slots[begin + width] > slots[begin]
    return begin[slotted], hashed[slotted]


HIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("hash", T.LongType()),
            T.StructField("begin", T.IntegerType()),
            T.StructField("slots", T.ArrayType(T.LongType())),
        ]
    )
)


ARROW_HIT = pa.list_(pa.struct([("hash", pa.int64()), ("begin", pa.int32()), ("slots", pa.list_(pa.int64()))]))


def item_windows(benchmark: DataFrame, *, item_id: str, text: str) -> DataFrame:
    """(item_id, width, place, plain, hash, slots) of every telling window of the benchmark, typed
    and as plain words; of items without any, every window as plain words."""
    schema = T.StructType(
        [
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("width", T.IntegerType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("plain", T.BooleanType()),
            T.StructField("hash", T.LongType()),
            T.StructField("slots", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Tokens()
        for batch in batches:
            rows = []
            for item, text_ in zip(batch["item_id"], batch["text"], strict=True):
                owner, kind, template, value = canonical([text_ or ""], memory)
                width = min(WINDOW, len(owner))
                if not width:
                    continue
                telling = set(window_hashes(owner, kind, template, width)[0].tolist()) if width >= LEAST else set()
                both = [(True, plain_hashes(owner, kind, value, width))]
                if telling:
                    both.append((False, typed_hashes(owner, kind, template, width)))
                for plain, windows in both:
                    for begin, hashed in zip(*windows, strict=True):
                        if not telling or int(begin) in telling:
                            inside = slice(begin, begin + width)
                            slots = value[inside][kind[inside] != LITERAL].view(np.int64).tolist()
                            rows.append((item, width, int(begin), plain, int(hashed.view(np.int64)), slots))
            yield pd.DataFrame(rows, columns=["item_id", "width", "place", "plain", "hash", "slots"])

    named = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInPandas(run, schema)


def bloom_places(hashed: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mixed(hashed + GOLDEN * np.uint64(k)) % np.uint64(BLOOM_BITS)).astype(np.int64) for k in range(1, BLOOM_KEYS + 1)]


def bloom(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the benchmark's window hashes: 2 MB, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bloom_places(hashed)).astype(np.int32))], names=["place"])

    places = windows.select("hash").mapInArrow(run, "place int").distinct().toArrow().to_pandas()["place"].to_numpy(dtype=np.int64)
    bits = np.zeros(BLOOM_BITS, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits)


def with_hits(docs: DataFrame, filter_: np.ndarray, widths: list[int], *, text: str, keep_text: bool) -> DataFrame:
    """``docs`` with ``hits``: the windows of each whole text that may be the benchmark's, each
    with its slots and the token it begins at."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def task():
        bits, memory = shared.value, Tokens()

        def run(texts: list[str]) -> tuple:
            hits: list[list[dict]] = [[] for _ in texts]
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                if len(memory) > REMEMBERED:
                    memory.forget()
                owner, kind, template, value = canonical(texts[lo : lo + TEXTS_AT_ONCE], memory)
                heads = np.searchsorted(owner, np.arange(TEXTS_AT_ONCE))
                for width in widths:
                    both = [(True, plain_hashes(owner, kind, value, width))]
                    if width >= LEAST:
                        both.append((False, typed_hashes(owner, kind, template, width)))
                    for plain, windows in both:
                        begin, hashed = confirmed(*windows, bits)
                        for b, h in zip(begin.tolist(), hashed.view(np.int64).tolist(), strict=True):
                            inside = slice(b, b + width)
                            slots = [] if plain else value[inside][kind[inside] != LITERAL].view(np.int64).tolist()
                            hits[lo + owner[b]].append({"hash": h, "begin": b - int(heads[owner[b]]), "slots": slots})
            return (hits,)

        return run

    return by_text(without(docs, "__row"), text, [("hits", HIT, ARROW_HIT)], task, keep_text=keep_text)


def confirmed(begin: np.ndarray, hashed: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows all of whose bits are set in the filter."""
    for k in range(BLOOM_KEYS):
        if not len(begin):
            break
        at = bloom_places(hashed)[k]
        passed = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        begin, hashed = begin[passed], hashed[passed]
    return begin, hashed


def extended(there: dict, back: dict, pairs: list[tuple]) -> tuple[dict, dict] | None:
    """The values of an item and their partners, and the reverse, with ``pairs`` added; None if a
    value would have two partners."""
    there, back = dict(there), dict(back)
    for b, d in pairs:
        if there.setdefault(b, d) != d or back.setdefault(d, b) != b:
            return None
    return there, back


def occurrence(parts: list[dict], length: int) -> tuple[int, bool]:
    """(windows, whether all values are the item's) of the best consistent occurrence of an item.

    A part holds the windows at one place of the document.  An occurrence is a part and the parts
    within an item's length that agree with it, nearest first, so words put in or left out do not
    break it; or the whole document, if all of it agrees; or all windows with the item's own values.
    """
    parts = sorted(({**p, "pairs": [(x["b"], x["d"]) for x in p["pairs"]]} for p in parts), key=lambda p: p["at"])
    at = [p["at"] for p in parts]
    every = {x for p in parts for x in p["places"]}
    best = (len({x for p in parts for x in p["exact"]}), True)
    whole = extended({}, {}, [x for p in parts for x in p["pairs"]])
    if whole is not None:
        best = max(best, (len(every), all(b == d for b, d in whole[0].items())))
    for seed in sorted(range(len(parts)), key=lambda i: -len(parts[i]["places"])):
        if best == (len(every), True):
            break
        values = extended({}, {}, parts[seed]["pairs"])
        if values is None:
            continue
        places = set(parts[seed]["places"])
        near = range(bisect_left(at, at[seed] - length), bisect_right(at, at[seed] + length))
        for i in sorted(near, key=lambda i: abs(at[i] - at[seed])):
            if not places.issuperset(parts[i]["places"]):
                more = extended(*values, parts[i]["pairs"])
                if more is not None:
                    values = more
                    places.update(parts[i]["places"])
        best = max(best, (len(places), all(b == d for b, d in values[0].items())))
    return best


def matches(hits: DataFrame, windows: DataFrame, *, key: str, coverage: float) -> DataFrame:
    """(key, item_id, n_windows, coverage, same_values) of documents with an occurrence that has
    enough of an item's windows and consistent slots.

    The join by hash is one that Spark splits where it is skewed.  Windows are gathered by document,
    item and place first, which has no more of them than the item.
    """
    sizes = windows.groupBy("item_id").agg(
        F.countDistinct("place").alias("of"), F.max(F.col("place") + F.col("width")).alias("length")
    )
    each = hits.select(F.col(key), F.explode("hits").alias("h")).select(key, "h.hash", "h.begin", F.col("h.slots").alias("d"))
    met = each.join(windows.select("hash", "item_id", "place", "plain", F.col("slots").alias("b")), "hash")
    met = met.withColumn("d", F.when(F.col("plain"), F.col("b")).otherwise(F.col("d")))
    parts = met.groupBy(key, "item_id", (F.col("begin") - F.col("place")).alias("at")).agg(
        F.collect_set("place").alias("places"),
        F.collect_set(F.when(F.col("b") == F.col("d"), F.col("place"))).alias("exact"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("b", "d")))).alias("pairs"),
    )
    met_places = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["places"])))
    enough = (
        parts.groupBy(key, "item_id")
        .agg(F.collect_list(F.struct("at", "places", "exact", "pairs")).alias("parts"))
        .join(sizes, "item_id")
        .where(F.size(met_places) >= coverage * F.col("of"))
        .select(key, "item_id", "of", "length", "parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                of, length, own = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                n, same = occurrence(own, length)
                if n >= coverage * of:
                    at.append(i)
                    found.append((n, n / of, same))
            kept = batch.take(pa.array(at, type=pa.int64()))
            new = [pa.array([f[c] for f in found], type=t) for c, t in enumerate((pa.int64(), pa.float64(), pa.bool_()))]
            names = [key, "item_id", "n_windows", "coverage", "same_values"]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *new], names=names)

    added = [("n_windows", T.LongType()), ("coverage", T.DoubleType()), ("same_values", T.BooleanType())]
    schema = T.StructType([enough.schema[key], enough.schema["item_id"], *[T.StructField(n, t) for n, t in added]])
    return enough.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    coverage: float = 0.5,
    keep_text: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, with ``hits`` and a row number ``__row``, and the matches by it."""
    windows = stored(item_windows(benchmark, item_id=item_id, text=item_text), "benchmark-windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    rows = with_hits(docs, bloom(windows), widths, text=text, keep_text=keep_text)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "template-hits")
    some = rows.where(F.size("hits") > 0)
    return rows, matches(some, windows, key="__row", coverage=coverage)
