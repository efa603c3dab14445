"""Repeated passages against a plain count of windows; split buckets, odd documents, the SQL."""

import hashlib
import random

import numpy as np
import pytest

import compare
import odd
from scorebook.llm import super_kmers as K
from scorebook.llm.queries import ORACLES, QUERIES


def plain(rows, width):
    """(doc_id, n_words, n_removed, digest) per row, window by window."""
    least, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        if d is not None:
            for i in range(len(words) - width + 1):
                key = tuple(words[i : i + width])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        if d is not None:
            for i in range(len(words) - width + 1):
                if least[tuple(words[i : i + width])] < d:
                    gone.update(range(i, i + width))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def passages(seed, documents=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choices(words, k=rng.randint(6, 30))) for _ in range(6)]
    rows = []
    for d in range(documents):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((d, " \n".join(parts)))
    rows += [(d + 1000, rows[d % 7][1]) for d in range(10)]
    return rows + [(3, "a " * 40), (2000, "a " * 30 + "b"), (2000, rows[5][1] + " tail")]


@pytest.mark.parametrize(("part", "longest", "at_once"), [(500, 256, 500_000), (3, 256, 40), (2, 4, 1)])
def test_windows_equal_a_plain_count(spark, monkeypatch, part, longest, at_once):
    for name, value in (("PART", part), ("LONGEST", longest), ("AT_ONCE", at_once)):
        monkeypatch.setattr(K, name, value)
    rows = passages(part)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for width, gram in ((8, 3), (8, 8), (1, 1)) if part == 3 else ((8, 3),):
        got = found(K.deduplicated(docs, width=width, gram=gram))
        assert got == plain(rows, width)
        assert any(0 < n < m for _, m, n, _ in got) and any(n == m > 0 for _, m, n, _ in got)


def test_texts_are_given_where_asked(spark):
    rows = [(1, " ".join(map(str, range(20)))), (2, "x y " + " ".join(map(str, range(15))) + " z"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept"] for r in K.deduplicated(docs, width=10, gram=4, texts=True).collect()}
    assert got == {1: None, 2: "x y z", 3: None}
    with pytest.raises(ValueError):
        K.deduplicated(docs, width=3, gram=4)


def test_minimisers_and_ranks():
    rng = np.random.default_rng(1)
    hashed = rng.integers(0, 50, 300).astype(np.uint64)
    windows = [tuple(hashed[i : i + 9]) for i in range(292)]
    least = K.minimisers(hashed, 9, 4)
    assert len(least) == 292 and all(least[i] == least[j] for i in range(292) for j in range(292) if windows[i] == windows[j])
    rank = K.window_ranks(rng.integers(0, 2, 500), 7)
    assert len(rank) == 494
    first, size = K.runs(np.array([5, 5, 5, 5, 5, 1, 2, 2]), 2)
    assert first.tolist() == [0, 2, 4, 5, 6] and size.tolist() == [2, 2, 1, 1, 2]


def test_ranks_are_equal_for_equal_windows_only():
    codes = np.random.default_rng(2).integers(0, 2, 400)
    rank = K.window_ranks(codes, 5)
    seen = {}
    for i, r in enumerate(rank.tolist()):
        assert seen.setdefault(r, tuple(codes[i : i + 5])) == tuple(codes[i : i + 5])
    assert len(seen) == len(set(seen.values()))


def test_odd_documents(spark):
    docs = odd.odd_docs(spark, [(9, odd.LONG, "en", "s9"), (10, odd.LONG + "tail", None, None)])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = found(K.deduplicated(docs))
    assert [r[:2] for r in got] == [r[:2] for r in plain(rows, 10**9)]
    left = {(d, n): (m, k) for d, n, m, k in got}
    words = len(odd.LONG.split())
    assert left[5, words][0] == 0 and left[9, words] == (words, K.EMPTY)
    assert left[10, words + 1] == (words, hashlib.sha256(b"tail").hexdigest())
    assert K.deduplicated(odd.empty_docs(spark)).count() == 0


def test_query_equals_its_sql(spark, small):
    assert compare.differences(spark, QUERIES["op11_super_kmer_dedup"], ORACLES["op11_super_kmer_dedup"], small) == []
