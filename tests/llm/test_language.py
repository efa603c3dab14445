"""Text vectors against a plain sum, odd documents, held-out accuracy."""

import numpy as np

import odd
from scorebook.llm import lang_hd as L
from scorebook.llm.queries import QUERIES


def plain(text):
    symbols = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = np.zeros(L.WIDTH)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b != 32:
            out += np.roll(L.letter_vector(a), 2) * np.roll(L.letter_vector(b), 1) * L.letter_vector(c)
    return out


def test_vectors_equal_a_plain_sum():
    texts = ["Two words", "", "12 !", "É", "one\nmore: äöü x", "a"]
    got = L.encoded(texts, L.Letters())
    np.testing.assert_array_equal(got, np.stack([plain(t) for t in texts]))


def test_odd_documents(spark):
    docs = odd.odd_docs(spark, [(40 + i, "der die das und nicht " * 3 if i % 2 else "the and of with this " * 3, "de" if i % 2 else "en", "s") for i in range(40)])
    model = L.train(docs)
    out = {r["doc_id"]: r for r in L.predicted(docs, model).collect()}
    assert out[41]["lang_pred"] == "de" and out[40]["lang_pred"] == "en"
    assert [out[i]["lang_pred"] for i in (2, 3, 4, 6, 7)] == ["und"] * 5
    assert out[2]["score"] == 0 and all(0 <= r["score"] <= 1 for r in out.values()) and odd.BIG in out
    nothing = L.train(odd.empty_docs(spark))
    assert {r["lang_pred"] for r in L.predicted(docs, nothing).collect()} == {"und"}
    assert L.predicted(odd.empty_docs(spark), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_hyperdimensional_language"](spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
