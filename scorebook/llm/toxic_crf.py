"""Toxicity: a linear-chain conditional random field over the words of a text.

Labels are per document, so tokens are labelled first: words and word beginnings that occur far
more often in toxic documents than in clean ones mark the toxic tokens of toxic documents.  A
two-state chain (clean, toxic) is fitted to those labels; forward-backward gives each token of a
whole text its marginal, and the marginals give the document's score and the offending offsets.

Nulls and texts without a word score as a text without a toxic token and have no spans.  Repeated
rows are scored row by row.  Other columns of the documents pass through; an added column takes the
place of one with its name.  Without labels of both classes nothing can be learned
and every document scores 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import by_text, labelled_ids, slices, without

WORD = re.compile(r"[^\W\d_]+")
#: Weights nearer to zero than this are left out of the model.
LEAST_WEIGHT = 0.01
#: Distinct words whose emission a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
TOKENS_AT_ONCE = 1 << 20
WINDOW = 64
SPAN_AT = 0.5
#: Marginals below this count as none in a document's score, whatever the length of the text.
COUNTED_FROM = 0.1
#: Log-odds of a text none of whose marginals counts; the same bound holds above.
FLOOR = -6.0


@dataclass(frozen=True)
class Crf:
    """``weights``: of hashed features for the toxic state; ``transition``: factors from state to
    state; ``start``: factor of a toxic first token; ``scale``: intercept and slope of the score."""

    weights: dict[int, float]
    transition: np.ndarray
    start: float
    scale: tuple[float, float]


def features(word: str) -> tuple[int, int, int, int]:
    """Hashed features of a word: itself, its first four letters, its last three, its length."""
    w = word.lower()
    parts = ("w" + w, "p" + w[:4], "s" + w[-3:], f"l{min(len(w), 12)}")
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) for p in parts)


def telling(texts: list[list[str]], labels: list[int], least: int = 3, odds: float = 1.5) -> set[str]:
    """Words and word beginnings that stand in toxic documents too often for chance.

    A document counts for a word if it has it between two words between which no earlier document
    had it, so copies add nothing, and it counts once.  Kept are words whose log-odds exceed
    ``odds`` and for which a Chernoff bound on the chance of so many toxic documents among all
    that count, times the number of words tried, is below one.
    """
    places: dict[str, set] = defaultdict(set)
    seen = (Counter(), Counter())
    for words, label in zip(texts, labels, strict=True):
        lowered = [w.lower() for w in words]
        new = set()
        for left, w, right in zip(["", *lowered], lowered, [*lowered[1:], ""]):
            place = hash((left, right))
            for key in ("w" + w, "p" + w[:4]) if len(w) > 4 else ("w" + w,):
                if place not in places[key]:
                    places[key].add(place)
                    new.add(key)
        seen[label].update(new)
    n0, n1 = (max(1, side.total()) for side in seen)
    rate = n1 / (n0 + n1)
    tried = [key for key, k1 in seen[1].items() if k1 >= least]
    found = set()
    for key in tried:
        k1, k0 = seen[1][key], seen[0][key]
        share = k1 / (k1 + k0)
        against = k1 * np.log(share / rate) + (k0 * np.log((1 - share) / (1 - rate)) if k0 else 0.0)
        gap = np.log((k1 + 0.5) * (n0 - k0 + 0.5) / ((n1 - k1 + 0.5) * (k0 + 0.5)))
        if share > rate and against > np.log(len(tried)) and gap > odds:
            found.add(key)
    return found


def windows(words: list[str], tags: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    for i in range(0, len(words), WINDOW):
        yield words[i : i + WINDOW], tags[i : i + WINDOW]


def fit_chain(
    sequences: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-4
) -> tuple[dict[int, float], np.ndarray, float]:
    """Weights, transition factors and start factor by gradient ascent on the likelihood of the
    labelled sequences.  Forward and backward vectors are kept as ratios, toxic to clean."""
    n, width = len(sequences), max(len(w) for w, _ in sequences)
    ids = np.zeros((width, n, 4), dtype=np.int64)
    tags = np.zeros((width, n), dtype=bool)
    mask = np.zeros((width, n), dtype=bool)
    memory: dict[str, tuple] = {}
    for i, (words, marks) in enumerate(sequences):
        ids[: len(words), i] = [memory.get(w) or memory.setdefault(w, features(w)) for w in words]
        tags[: len(words), i] = marks
        mask[: len(words), i] = True
    used, compact = np.unique(ids, return_inverse=True)
    compact = compact.reshape(ids.shape)
    pairs = mask[1:]
    before, after = tags[:-1], tags[1:]
    gold = np.array([[np.sum(pairs & (before == a) & (after == b)) for b in (0, 1)] for a in (0, 1)]) / n
    parts = [np.zeros(len(used)), np.zeros((2, 2)), np.zeros(1)]
    squares = [np.full(p.shape, 1e-8) for p in parts]
    for _ in range(rounds):
        weights, (move, start) = parts[0], (np.exp(parts[1]), float(np.exp(parts[2][0])))
        odds = np.exp(np.clip(weights[compact].sum(axis=2), -30, 30))
        forward, backward = np.empty(odds.shape), np.ones(odds.shape)
        forward[0] = odds[0] * start
        for t in range(1, width):
            f = forward[t - 1]
            forward[t] = odds[t] * (move[0, 1] + move[1, 1] * f) / (move[0, 0] + move[1, 0] * f)
        for t in range(width - 2, -1, -1):
            ahead = odds[t + 1] * backward[t + 1]
            ratio = (move[1, 0] + move[1, 1] * ahead) / (move[0, 0] + move[0, 1] * ahead)
            backward[t] = np.where(mask[t + 1], ratio, 1.0)
        joint = forward * backward
        gap = np.where(mask, tags - joint / (1 + joint), 0.0)
        f, ahead = forward[:-1], (odds * backward)[1:]
        cells = [move[0, 0] + 0 * f, move[0, 1] * ahead, move[1, 0] * f, move[1, 1] * f * ahead]
        whole = cells[0] + cells[1] + cells[2] + cells[3]
        expected = np.array([np.sum(np.where(pairs, c / whole, 0.0)) for c in cells]).reshape(2, 2) / n
        slopes = [
            np.bincount(compact.ravel(), np.repeat(gap.ravel(), 4), minlength=len(used)) / n - penalty * weights,
            gold - expected,
            np.array([gap[0].sum() / n]),
        ]
        for part, square, slope in zip(parts, squares, slopes, strict=True):
            square += slope**2
            part += rate * slope / np.sqrt(square)
    strong = np.abs(parts[0]) > LEAST_WEIGHT
    kept = dict(zip(used[strong].tolist(), parts[0][strong].tolist(), strict=True))
    return kept, np.exp(parts[1] - parts[1][0, 0]), float(np.exp(parts[2][0]))


def marginals(odds: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """Probability of the toxic state for every token of the texts laid end to end.

    ``odds`` is the factor each token gives the toxic state.  With two states the forward and
    backward vectors are each one ratio, which all texts that are long enough advance together.
    """
    (a00, a01), (a10, a11) = transition
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    active = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), side="right")
    forward, out = np.empty(len(odds)), np.empty(len(odds))
    ratio = np.empty(0)
    for t, n in enumerate(active):
        at = begins[:n] + t
        if t == 0:
            ratio = odds[at] * start
        else:
            ratio = ratio[:n]
            ratio = odds[at] * (a01 + a11 * ratio) / (a00 + a10 * ratio)
        forward[at] = ratio
    ends = begins + lengths[order] - 1
    ratio = np.ones(0)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        if len(ratio) < n:
            ratio = np.concatenate([ratio, np.ones(n - len(ratio))])
        at = begins[:n] + t
        inside = at < ends[:n]
        ahead = odds[np.minimum(at + 1, len(odds) - 1)] * ratio
        ratio = np.where(inside, (a10 + a11 * ahead) / (a00 + a01 * ahead), 1.0)
        joint = forward[at] * ratio
        out[at] = joint / (1.0 + joint)
    return out


class Emissions(dict):
    """The factor of each word, computed when first met."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        total = sum(self.weights.get(i, 0.0) for i in features(word))
        value = math.exp(min(30.0, max(-30.0, total)))
        self[word] = value
        return value


def toxic_odds(
    texts: Iterable[list[str]], memory: Emissions, transition: np.ndarray, start: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens; each text's log-odds that at least one token is toxic; where each
    text ends."""
    odds = [np.fromiter(map(memory.__getitem__, words), dtype=float, count=len(words)) for words in texts]
    lengths = np.array([len(o) for o in odds], dtype=np.int64)
    p = marginals(np.concatenate(odds), lengths, transition, start)
    ends = np.cumsum(lengths)
    counted = np.where(p >= COUNTED_FROM, np.minimum(p, 1 - 1e-12), 0.0)
    clean = np.concatenate([[0.0], np.cumsum(np.log1p(-counted))])
    clean = clean[ends] - clean[ends - lengths]
    return p, np.clip(np.log(-np.expm1(clean) + math.exp(FLOOR)) - clean, FLOOR, -FLOOR), ends


def fit(sample: list[tuple[str | None, int]], most_windows: int = 8_000) -> Crf | None:
    """The chain and the scale of the score, from (text, label) pairs; the chain is fitted on at most
    ``most_windows`` windows, half of them with toxic tokens, taken by their hash."""
    texts = [WORD.findall(t or "") for t, _ in sample]
    labels = [int(y) for _, y in sample]
    if not 0 < sum(labels) < len(labels):
        return None
    marks = telling(texts, labels)
    marked, rest = [], []
    for words, label in zip(texts, labels, strict=True):
        lowered = [w.lower() for w in words]
        tags = [int(label and ("w" + w in marks or (len(w) > 4 and "p" + w[:4] in marks))) for w in lowered]
        if label and not any(tags):
            continue
        for piece in windows(words, tags):
            (marked if any(piece[1]) else rest).append(piece)
    if not marked:
        return None
    for pieces in marked, rest:
        pieces.sort(key=lambda piece: zlib.crc32(" ".join(piece[0]).encode("utf-8", "replace")))
    weights, transition, start = fit_chain(marked[: most_windows // 2] + rest[: most_windows // 2])
    memory = Emissions(weights)
    values = np.zeros(len(texts))
    for lo, hi in slices(np.array([len(words) for words in texts]), TOKENS_AT_ONCE):
        values[lo:hi] = toxic_odds(texts[lo:hi], memory, transition, start)[1]
    x, y = values, np.array(labels, dtype=float)
    b = np.array([0.0, 0.1])
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (y - p) - np.array([0.0, 1.0]) * b
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1.0])
        b = b + np.linalg.solve(hess, grad)
    return Crf(weights, transition, start, (float(b[0]), float(max(b[1], 0.0))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = 1500,
    most_chars: int = 200_000,
    most_windows: int = 8_000,
    modulus: int = 4,
    remainder: int = 2,
) -> Crf | None:
    """Fit on at most ``per_class`` labelled documents of each class among those of at most
    ``most_chars`` characters, and the chain on at most ``most_windows`` of their windows; these
    bounds limit what reaches the driver, and only learning is bounded."""
    short = docs.where(F.length(text) <= most_chars).select(F.col(doc_id).alias("doc_id"))
    known = labels.join(short, "doc_id", "left_semi")
    ids = labelled_ids(known, label, per_class=per_class, modulus=modulus, remainder=remainder)
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .where(F.length("text") <= most_chars)
        .join(F.broadcast(ids), "doc_id")
        .select("text", "label", "doc_id")
        .toArrow().to_pandas()
        .sort_values(["doc_id", "text"])
    )
    return fit(list(zip(rows["text"], rows["label"], strict=True)), most_windows)


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("p", T.DoubleType()),
        ]
    )
)

ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def scored(docs: DataFrame, model: Crf | None, *, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1), ``n_toxic`` (tokens whose marginal is at
    least one half) and ``spans`` (their offsets in code points, end exclusive, and marginals;
    neighbours form one span)."""
    docs = without(docs, "score", "n_toxic", "spans")
    if model is None:
        return docs.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_toxic"), F.array().cast(SPANS).alias("spans"))

    def task():
        memory = Emissions(model.weights)

        def run(texts: list[str]) -> tuple:
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 6 + 1
            score, count = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            spans: list[list[dict]] = [[]] * len(texts)
            for lo, hi in slices(sizes, TOKENS_AT_ONCE):
                p, log_odds, ends = toxic_odds(map(WORD.findall, texts[lo:hi]), memory, model.transition, model.start)
                lengths = np.diff(ends, prepend=0)
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(model.scale[0] + model.scale[1] * log_odds, -30, 30)))
                hot = np.flatnonzero(p >= SPAN_AT)
                owner = np.searchsorted(ends, hot, side="right")
                for k in np.unique(owner):
                    at = hot[owner == k] - (ends[k] - lengths[k])
                    count[lo + k] = len(at)
                    spans[lo + k] = located(texts[lo + k], at, p[hot[owner == k]])
            return score, count, spans

        return run

    added = [("score", T.DoubleType(), pa.float64()), ("n_toxic", T.LongType(), pa.int64()), ("spans", SPANS, ARROW_SPANS)]
    return by_text(docs, text, added, task)


def located(text: str, tokens: np.ndarray, p: np.ndarray) -> list[dict]:
    """Offsets of the named tokens of ``text``; consecutive tokens are joined into one span."""
    wanted = dict(zip(tokens.tolist(), p.tolist(), strict=True))
    found: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if i in wanted:
            if i == last + 1:
                found[-1] = {"start": found[-1]["start"], "end": m.end(), "p": max(found[-1]["p"], wanted[i])}
            else:
                found.append({"start": m.start(), "end": m.end(), "p": wanted[i]})
            last = i
    return found
