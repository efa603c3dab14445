"""The chain against plain recursions, counts against a counter, odd documents."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

import odd
from scorebook.llm import hmm_lm as H
from scorebook.llm.queries import QUERIES


def plain(kinds, start, move, emit):
    n, k = len(kinds), len(start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = start * emit[kinds[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * emit[kinds[t]]
    for t in range(n - 2, -1, -1):
        b[t] = move @ (emit[kinds[t + 1]] * b[t + 1])
    whole = a[-1].sum()
    pairs = sum(np.outer(a[t - 1], emit[kinds[t]] * b[t]) * move for t in range(1, n)) / whole
    return np.log(whole), a * b / whole, pairs


@pytest.mark.parametrize("stretch", [1, 3, 4, 2048])
def test_stretches_give_the_whole_chain(monkeypatch, stretch):
    monkeypatch.setattr(H, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(6), 3).T
    lengths = np.array([1, 9, 4, 13, 2, 8])
    kinds = rng.integers(0, 6, lengths.sum())
    got, (starts, moves, emitted) = H.vectors(kinds, lengths, start, move, emit, True)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
    at = 0
    for i, n in enumerate(lengths):
        own = kinds[at : at + n]
        value, gamma, pairs = plain(own, start, move, emit)
        assert abs(got[i] - value) < 1e-9
        want[0] += gamma[0]
        want[1] += pairs
        np.add.at(want[2], own, gamma)
        at += n
    for a, b in zip((starts, moves, emitted), want, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    np.testing.assert_allclose(H.vectors(kinds, lengths, start, move, emit, False)[0], got)


def test_texts_of_two_stretches_are_chained_by_vectors_alone(monkeypatch):
    """The first stretch passes a vector on and the last gives one back: no matrix is multiplied."""
    monkeypatch.setattr(H, "STRETCH", 16)
    multiply = np.matmul

    def flat(a, b, **kept):
        assert b.ndim == 2
        return multiply(a, b, **kept)

    monkeypatch.setattr(H.np, "matmul", flat)
    rng = np.random.default_rng(4)
    start, move = rng.dirichlet(np.ones(H.STATES)), rng.dirichlet(np.ones(H.STATES), H.STATES)
    emit = rng.uniform(0.1, 1.0, (H.CLASSES + 1, H.STATES))
    emit /= emit.sum(axis=0)
    lengths = np.array([20, 32, 5, 17])
    kinds = rng.integers(0, H.CLASSES, lengths.sum()).astype(np.uint16)
    logs, _ = H.vectors(kinds, lengths, start, move, emit, True)
    for n, end, got in zip(lengths, np.cumsum(lengths), logs, strict=True):
        state, total = start, 0.0
        for t, kind in enumerate(kinds[end - n : end]):
            state = (state if t == 0 else state @ move) * emit[kind]
            total += np.log(state.sum())
            state = state / state.sum()
        assert abs(got - total) < 1e-9


def sample(lengths):
    rng = np.random.default_rng(6)
    start, move = rng.dirichlet(np.ones(H.STATES)), rng.dirichlet(np.ones(H.STATES), H.STATES)
    emit = rng.uniform(0.1, 1.0, (H.CLASSES + 1, H.STATES))
    return rng.integers(0, H.CLASSES, lengths.sum()).astype(np.uint16), lengths, start, move, emit / emit.sum(axis=0)


def test_a_pass_scales_few_words_and_keeps_two_tables(monkeypatch):
    """Not every word is normalised, and a pass holds two tables of states by words: none that is
    new where a block before it left its memory."""
    case = sample(np.full(400, 250))
    table = case[0].size * H.STATES * 8
    taken, log = [], np.log
    with monkeypatch.context() as patched:
        patched.setattr(H.np, "log", lambda x: taken.append(np.size(x)) or log(x))
        H.vectors(*case, True)
    assert sum(taken) <= case[0].size / 4

    def peak(*room):
        tracemalloc.start()
        found = H.vectors(*case, True, *room)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, found

    assert peak()[0] < 2.9 * table
    room = {}
    first, again = peak(room)[1], peak(room)
    assert again[0] < 0.9 * table
    np.testing.assert_array_equal(first[0], again[1][0])
    for a, b in zip(first[1], again[1][1], strict=True):
        np.testing.assert_array_equal(a, b)


def test_memory_of_a_larger_block_serves_smaller_ones(monkeypatch):
    monkeypatch.setattr(H, "STRETCH", 16)
    room = {}
    for lengths in ([70, 3, 40, 16, 17], [1], [33, 2], [5, 90, 48, 48, 100, 7]):
        case = sample(np.array(lengths))
        got, want = H.vectors(*case, True, room), H.vectors(*case, True)
        np.testing.assert_array_equal(got[0], want[0])
        for a, b in zip(got[1], want[1], strict=True):
            np.testing.assert_array_equal(a, b)


@pytest.mark.parametrize("stretch", [7, 8, 9, 64])
def test_rare_classes_stay_within_a_double(monkeypatch, stretch):
    monkeypatch.setattr(H, "STRETCH", stretch)
    rng = np.random.default_rng(8)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(6), 3).T * 1e-30
    lengths = np.array([100, 1, 8, 30, 64])
    kinds = rng.integers(0, 6, lengths.sum())
    logs, found = H.vectors(kinds, lengths, start, move, emit, True)
    plainly, same = H.vectors(kinds, lengths, start, move, emit * 1e30, True)
    np.testing.assert_allclose(logs, plainly - lengths * 30 * np.log(10.0), rtol=1e-12)
    for a, b in zip(found, same, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_shares_are_added_up_in_parts_alike(monkeypatch):
    case = sample(np.array([300, 20, 700, 1, 1500]))
    whole = H.vectors(*case, True)[1][2]
    monkeypatch.setattr(H, "JOINT", 16)
    np.testing.assert_allclose(H.vectors(*case, True)[1][2], whole, rtol=1e-12)


def counts(texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None}
    seen = Counter()
    rows = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in texts]
    for i, words in rows:
        if i is not None and not held[i]:
            seen.update(words)
    return rows, held, seen


def compare(got, texts):
    rows, held, seen = counts(texts)
    total, distinct = sum(seen.values()), len(seen)
    assert len(got) == len(rows)
    left = {}
    for r in got:
        left.setdefault(r["doc_id"], []).append(r)
    for i, words in rows:
        mine = [r for r in left[i] if r["n_tokens"] == len(words)]
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert any(
            r["n_known"] == sum(seen[w] > 0 for w in words)
            and r["train_tokens"] == total
            and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
            and math.isfinite(r["score"])
            and r["held_out"] == held.get(i, False)
            for r in mine
        )


def test_query_equals_a_counter_and_beats_the_base(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op9_hidden_markov_lm"](spark, small).collect()
    compare(got, texts)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = odd.odd_docs(spark)
    compare(H.scored(docs, rounds=2).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert H.scored(odd.empty_docs(spark), rounds=2).count() == 0


def test_every_round_runs_over_all_blocks_until_the_gain_is_small(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a word ', id % 7, ' and another ', id % 3) AS text")
    rounds, step = [], H.step

    def seen(table, *model):
        found = step(table, *model)
        rounds.append((table.count(), found[-1]))
        return found

    monkeypatch.setattr(H, "step", seen)
    rows = H.scored(docs.repartition(8), rounds=2, tolerance=1e-2).collect()
    assert {n for n, _ in rounds} == {8}
    gains = np.diff([x for _, x in rounds]) / rows[0]["train_tokens"]
    assert gains[-1] < 1e-2 and (gains[:-1] >= 1e-2).all()
