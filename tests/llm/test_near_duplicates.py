"""Estimates, groups against all pairs, hot groups of copies, odd documents."""

import random

import numpy as np
import pytest

import odd
from scorebook.llm import superminhash as M
from scorebook.llm.queries import QUERIES


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def all_pairs(texts, width, percent):
    """Component of every ID, comparing each pair of distinct sets that share a shingle."""
    sets, parent, holders, first = {i: shingles(t, width) for i, t in texts}, {i: i for i, _ in texts}, {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for i in sorted(sets):
        if sets[i] and first.setdefault(sets[i], i) != i:
            join(i, first[sets[i]])
        elif sets[i]:
            near = {j for s in sets[i] for j in holders.get(s, ())}
            for j in near:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    join(i, j)
            for s in sets[i]:
                holders.setdefault(s, []).append(i)
    return {i: root(i) for i in parent}, {i: len(s) for i, s in sets.items()}


def agree(got, texts, width=3, percent=85):
    want, sizes = all_pairs(texts, width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_registers_estimate_similarity_and_are_filled():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 170).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 15).astype(np.uint64)])) for _ in range(40)]
    registers = M.signatures(sets, 150)
    assert abs((registers[:20] == registers[20:]).mean() - 170 / 200) < 0.02
    for n in (1, 2, 9):
        small = M.signatures([common[:n]], 150)
        assert np.isfinite(small).all() and len(np.unique(small)) == 150
    assert (M.signatures([common, common[::-1]], 150)[0] == M.signatures([common], 150)[0]).all()


def test_query_equals_all_pairs(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    agree(QUERIES["op6_superminhash"](spark, small).collect(), texts)


def test_hot_groups_and_chains(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)] * 150
    for _ in range(120):  # near copies, some of them only near to each other
        own = list(base)
        for _ in range(rng.choice((1, 2, 4, 7))):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    walk = list(base)
    for k in range(40):  # each is near to the next, the ends are not
        walk[(3 * k) % 120] = f"new{k}"
        texts.append(" ".join(walk))
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    agree(M.grouped(docs).collect(), list(enumerate(texts)))
    agree(M.grouped(docs, width=5, percent=80).collect(), list(enumerate(texts)), 5, 80)


def test_odd_documents(spark):
    rows = M.grouped(odd.odd_docs(spark)).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert (by_id[1]["kept"], by_id[1]["component_id"]) == (True, 1)
    assert [by_id[i]["n_shingles"] for i in (2, 3, 4)] == [0, 0, 0] and all(by_id[i]["kept"] for i in (2, 3, 4))
    assert by_id[5]["n_shingles"] == 5 and by_id[odd.BIG]["n_shingles"] == 1
    assert M.grouped(odd.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 70, 90, 95, 100])
def test_any_threshold_equals_all_pairs(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5, 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    agree(M.grouped(docs, percent=percent).collect(), list(enumerate(texts)), 3, percent)


def test_registers_and_sketches_fit_every_threshold():
    for percent in range(1, 101):
        bands, rows = M.banding(percent)
        assert bands * rows <= M.REGISTERS or rows == 1
        assert (1 - (percent / 100) ** rows) ** bands <= M.MISS
    assert M.banding(85) == (25, 6) and M.banding(80) == (29, 5)
    with pytest.raises(ValueError):
        M.banding(0)
    few = M.signatures([np.arange(1, 5, dtype=np.uint64)], 12)
    assert M.sketches(few).shape == (1, 2)
    many = M.signatures([np.arange(1, 4000, dtype=np.uint64), np.arange(1, 3, dtype=np.uint64)], 300)
    assert np.isfinite(many).all()
