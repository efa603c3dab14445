"""The chain against enumeration, the score on held-out rows, and odd documents."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import odd
from scorebook.llm import toxic_crf
from scorebook.llm.queries import QUERIES


def test_marginals_equal_enumeration_over_all_paths():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 0, 1, 6, 2])
    odds = rng.uniform(0.1, 5, lengths.sum())
    move, start = rng.uniform(0.2, 2, (2, 2)), 0.7
    got = toxic_crf.marginals(odds, lengths, move, start)
    at = 0
    for n in lengths:
        own = odds[at : at + n]
        mass = np.zeros(n)
        total = 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            w = 1.0
            for t, s in enumerate(path):
                w *= own[t] if s else 1.0
                w *= (start if s else 1.0) if t == 0 else move[path[t - 1], s]
            total += w
            mass += w * np.array(path)
        np.testing.assert_allclose(got[at : at + n], mass / total if n else mass, rtol=1e-9)
        at += n


def test_gradient_training_tags_the_marked_word():
    clean = [("the cat sat on the mat by the door %d" % i).split() for i in range(60)]
    toxic = [("the cat is a fool by the door %d" % i).split() for i in range(30)]
    sequences = [(w, [0] * len(w)) for w in clean] + [(w, [int(x == "fool") for x in w]) for w in toxic]
    weights, move, start = toxic_crf.fit_chain(sequences)
    memory = toxic_crf.Emissions(weights)
    p, log_odds, _ = toxic_crf.toxic_odds([["a", "fool", "sat"], ["the", "cat", "sat"]], memory, move, start)
    assert p[1] > 0.5 and max(p[0], p[2], *p[3:]) < 0.5
    assert log_odds[0] > 0 > log_odds[1]


def test_copies_do_not_make_a_word_telling():
    copied = ["some rare words about nothing in here".split()] * 40
    plain = [f"w{i} w{i + 1} w{i + 2} w{i + 3}".split() for i in range(80)]
    assert toxic_crf.telling(copied + plain, [1] * 40 + [0] * 80) == set()


def test_offsets_are_code_points_and_neighbours_join():
    text = "\U0001f600 so you fool clown, and fool"
    spans = toxic_crf.located(text, np.array([2, 3, 5]), np.array([0.9, 0.8, 0.7]))
    assert [text[s["start"] : s["end"]] for s in spans] == ["fool clown", "fool"]
    assert spans[0]["p"] == 0.9


def test_odd_documents_and_no_labels(spark):
    name = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(60)]
    lines = [f"w{n} fool x{n} y{n} clown z{n}" if i % 2 else f"w{n} and x{n} the day z{n}" for i, n in enumerate(name)]
    docs = odd.odd_docs(spark, [(20 + i, line, "en", "s") for i, line in enumerate(lines)])
    truth = odd.labels(spark, [(20 + i, i % 2) for i in range(60)] + [(None, 1), (21, None), (21, 1)], "toxic")
    model = toxic_crf.train(docs, truth)
    out = toxic_crf.scored(docs, model)
    assert out.count() == docs.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert out.columns == [c for c in docs.columns if c not in ("Score", "spans")] + ["score", "n_toxic", "spans"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[21]["score"] > 0.3 > rows[20]["score"] and rows[3]["score"] < 0.3
    assert rows[odd.BIG]["doc_id"] == odd.BIG and rows[1]["n_chars"] == odd.BIG
    assert toxic_crf.train(docs, odd.labels(spark, [], "toxic")) is None
    assert {r["score"] for r in toxic_crf.scored(docs, None).collect()} == {0.0}
    assert toxic_crf.scored(odd.empty_docs(spark), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_crf_toxicity"](spark, folder)
    assert got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0
    truth = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def test_the_chain_sees_marked_windows_of_all_documents(monkeypatch):
    seen = []
    monkeypatch.setattr(toxic_crf, "telling", lambda *_: {"wvile"})
    monkeypatch.setattr(toxic_crf, "fit_chain", lambda pieces: seen.extend(pieces) or ({}, np.eye(2) * 0.8 + 0.1, 0.1))
    long = " ".join(f"vile w{i} and more plain words of a long text here" for i in range(400))
    late = [(f"nasty {'abcdefghij'[i % 10] * (i // 10 + 2)} vile", 1) for i in range(40)]
    toxic_crf.fit([(long, 1), *late, *[(f"a plain kind text {i}", 0) for i in range(41)]], most_windows=60)
    assert any("nasty" in [w.lower() for w in piece[0]] for piece in seen)


def test_long_documents_are_replaced_before_the_choice(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 2 else 5)) for i in range(400)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 < 2 as int) AS toxic")
    got = []
    monkeypatch.setattr(toxic_crf, "fit", lambda sample, *_: got.extend(sample))
    toxic_crf.train(docs, labels, per_class=20, most_chars=10)
    assert len(got) == 40
