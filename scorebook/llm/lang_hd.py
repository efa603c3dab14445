"""Language ID by hyperdimensional profiles.

Every letter has a random vector of signs.  A run of three letters is the product of its letters'
vectors, rotated by their places; a text is the sum over its runs; a language is the sum over the
unit vectors of its texts.  A text's language is the profile with the largest cosine.

A text that is null or has no letter is ``und`` with score 0.  Equal cosines go to the language
that sorts first.  Without any learned language every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import by_text, learnable, slices

WIDTH = 1024
SEED = 2027
CHARS_AT_ONCE = 600_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    """``languages`` in order and one unit row each in ``vectors``; ``middle``, the mean of the
    unit vectors of all languages, is taken off texts and profiles alike."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    middle: np.ndarray


def letter_vector(code: int) -> np.ndarray:
    """The signs of one letter, from its code point alone."""
    return np.random.default_rng([SEED, code]).integers(0, 2, WIDTH, dtype=np.int8) * 2 - 1


class Letters:
    """Vectors of the letters met so far, and which code points are letters."""

    def __init__(self):
        self.known: dict[int, bool] = {}
        self.rows: dict[int, np.ndarray] = {}

    def is_letter(self, code: int) -> bool:
        if code not in self.known:
            self.known[code] = unicodedata.category(chr(code)).startswith("L")
        return self.known[code]

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) > 20_000:
            self.rows.clear()
        for c in codes.tolist():
            if c not in self.rows:
                self.rows[c] = letter_vector(c)
        return np.stack([self.rows[c] for c in codes.tolist()])


def encoded(texts: list[str], letters: Letters) -> np.ndarray:
    """One vector for each text: the sum over its runs of three letters; a place that is not a
    letter is a blank with a vector of its own, and runs whose middle is blank are left out."""
    lowered = [t.lower() for t in texts]
    # One blank on either side of each text keeps runs from crossing into the next.
    codes = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    present, where = np.unique(codes, return_inverse=True)
    symbol = np.zeros(len(present), dtype=np.int64)
    real = [i for i, c in enumerate(present.tolist()) if letters.is_letter(c)]
    symbol[real] = np.arange(1, len(real) + 1)
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    if not real:
        return out
    s, k = symbol[where], len(real) + 1
    first, middle, last = s[:-2], s[1:-1], s[2:]
    keep = middle > 0
    run = ((first * k + middle) * k + last)[keep]
    owner = owner[1:-1][keep]
    runs, index = np.unique(run, return_inverse=True)
    table = np.concatenate([letter_vector(32)[None], letters.matrix(present[real])])
    at = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1), table
    for lo in range(0, len(runs), 8192):  # bounds the product for texts in many alphabets
        part = runs[lo : lo + 8192]
        vectors = (at[0][part // (k * k)] * at[1][part // k % k] * at[2][part % k]).astype(np.float32)
        inside = (index >= lo) & (index < lo + 8192) if len(runs) > 8192 else slice(None)
        cells = owner[inside] * len(part) + index[inside] - lo
        counts = np.bincount(cells, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ vectors
    return out


def in_groups(texts: list[str], letters: Letters) -> Iterator[tuple[int, int, np.ndarray]]:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    for lo, hi in slices(lengths, CHARS_AT_ONCE):
        for at in range(lo, hi, 512):
            end = min(hi, at + 512)
            yield at, end, encoded(texts[at:end], letters)


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None]


def train(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 3000,
    most_languages: int = 1000,
    modulus: int = 4,
    remainder: int = 2,
) -> Profiles:
    """Profiles from about ``per_language`` documents of each of the ``most_languages`` most frequent
    languages, chosen by hash of the ID; both bounds are on learning alone."""
    rows = docs.where(
        learnable(F.col(doc_id), modulus, remainder) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    ).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(sizes), "lang").where(share < F.lit(float(per_language)) / F.col("n")).select("lang", "text")

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = Letters(), {}
        for batch in batches:
            for lang_, part in batch.groupby("lang"):
                for _, _, vectors in in_groups(part["text"].tolist(), letters):
                    sums[lang_] = sums.get(lang_, 0.0) + unit(vectors).sum(axis=0)
        for lang_, total in sums.items():
            yield pd.DataFrame({"lang": lang_, "place": np.arange(WIDTH), "value": total})

    cells = (
        sample.mapInPandas(bundled, "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .toArrow().to_pandas()
    )
    if cells.empty:
        return Profiles((), np.zeros((0, WIDTH)), np.zeros(WIDTH))
    wide = cells.pivot(index="lang", columns="place", values="value").sort_index()
    vectors = unit(wide.to_numpy())
    middle = vectors.mean(axis=0) if len(vectors) > 1 else np.zeros(WIDTH)
    return Profiles(tuple(wide.index), unit(vectors - middle), middle)


def predicted(docs: DataFrame, model: Profiles, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score`` (the cosine, not below 0)."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def task():
        letters = Letters()

        def run(texts: list[str]) -> tuple:
            pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for lo, hi, vectors in in_groups(texts, letters):
                some = np.abs(vectors).any(axis=1)
                if len(names) > 1:
                    cosine = unit(unit(vectors) - model.middle) @ model.vectors.T
                    pick[lo:hi] = np.where(some, cosine.argmax(axis=1), len(names) - 1)
                    score[lo:hi] = np.where(some, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
            return names[pick], score

        return run

    added = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]
    return by_text(docs, text, added, task, keep_text=False)
