"""The index against plain counts, collocations against a plain version, odd documents, the SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import odd
from scorebook.llm import fm_phrases as P
from scorebook.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
        words = [w for w in re.split("[ \t]+", piece) if w]
        if words:
            yield words


def plain(rows, least, percent, top, longest):
    counts, totals = {}, Counter()
    for grp, text in rows:
        grp = "und" if grp is None else grp
        seen = counts.setdefault(grp, Counter())
        for words in pieces(text):
            totals[grp] += len(words)
            for size in range(1, longest + 1):
                seen.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for grp, seen in counts.items():
        candidates = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in candidates.items():
            inside = any(
                100 * b >= percent * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in candidates.items()
            )
            if not inside:
                cuts = [(1000000 * a * a // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rated.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((grp, rank, phrase.decode(), -a, left, right, totals[grp], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("grp", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "of", "new", "york", "Ägypten", "in", "San", "FRANCISCO", "big", "apple", "x y", "\u001c"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts.append(rng.choice(["new york in", "San Francisco big apple", "the of the", rng.choice(words), "\t" + rng.choice(words)]))
            parts.append(rng.choice([" ", " ", " ", ". ", ",", "\n", ".. ", "\r\x0b"]))
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(parts)))
    return rows


@pytest.mark.parametrize(("size", "longest", "least"), [(1 << 20, 3, 10), (40, 3, 2), (40, 4, 3), (7, 2, 4)])
def test_collocations_equal_a_plain_version(spark, size, longest, least):
    rows = texts(size)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = P.collocations(docs, group=F.col("lang"), longest=longest, least=least, top=25, size=size)
    assert found(got) == plain(rows, least, 50, 25, longest)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_count_every_phrase_in_both_directions(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    index = P.Index(ids, 4)
    phrases = index.words()
    for size in range(1, 5):
        want = Counter(tuple(ids[i : i + size]) for i in range(len(ids) - size + 1))
        want = {p: n for p, n in want.items() if 0 not in p}
        got = dict(zip(zip(*[w.tolist() for w in phrases.words], strict=True), phrases.count.tolist(), strict=True))
        assert got == want
        # Both intervals of a phrase hold as many rows as it occurs, and only its own.
        order, mirror = P.depth_order(ids, 4), P.depth_order(ids[::-1].copy(), 4)
        for words, low, back, n in zip(zip(*phrases.words, strict=True), phrases.low, phrases.mirror, phrases.count, strict=True):
            assert all(tuple(ids[p : p + size]) == words for p in order[low : low + n])
            assert all(tuple(ids[::-1][p : p + size]) == words[::-1] for p in mirror[back : back + n])
        phrases = index.extended(phrases, left=size % 2 == 0)


def test_deep_orders_do_not_overflow():
    ids = np.random.default_rng(5).integers(0, 1 << 30, 500)
    order = P.depth_order(ids, 4)
    keys = [tuple(ids[p : p + 4]) + (0,) * (4 - len(ids[p : p + 4])) for p in order]
    assert keys == sorted(keys)


def test_many_groups_share_a_task(spark, monkeypatch):
    monkeypatch.setattr(P, "OPEN", 1)
    rows = [(f"g{i % 30}", "one two. one two") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = P.collocations(docs, group=F.col("lang"), least=10, size=64)
    assert found(got) == plain(rows, 10, 50, 2000, 3) and got.count() == 30


def test_odd_documents(spark):
    docs = odd.odd_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert found(P.collocations(docs, group=F.col("lang"), least=2)) == plain(rows, 2, 50, 2000, 3)
    assert P.collocations(odd.empty_docs(spark), group=F.col("lang")).count() == 0


def test_products_pass_64_bits(spark):
    big = 4 * 10**12
    counted = spark.createDataFrame(
        [("g", 1, "a", big), ("g", 1, "b", big + 1), ("g", 2, "a b", big - 7)], "grp string, size int, phrase string, n bigint"
    )
    row = P.rated(counted).first()
    assert row["score"] == 1000000 * (big - 7) ** 2 // (big * (big + 1))


def test_query_equals_its_sql(spark, small):
    assert compare.differences(spark, QUERIES["op12_fm_collocations"], ORACLES["op12_fm_collocations"], small) == []
