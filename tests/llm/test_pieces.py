"""Viterbi against plain dynamic programming; decoding gives back every text."""

import random
from array import array

from hypothesis import given, settings
from hypothesis import strategies as st

import odd
from scorebook.llm import pieces as P
from scorebook.llm.queries import MODEL, QUERIES

WORDS = P.vocabulary(MODEL)
SEGMENTER = P.Segmenter(WORDS)
SCORES = {p: (i, s) for p, i, s in WORDS.pieces}


def plain(text):
    """Best total score of a unit, trying every piece at every place."""
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if text[start:end] in SCORES:
                total = best[start] + SCORES[text[start:end]][1]
                if best[end] is None or total > best[end]:
                    best[end] = total
        if best[end] is None:
            best[end] = best[end - 1] + SEGMENTER.fallback
    return best[-1]


def total(ids):
    scores = {i: s for _, i, s in WORDS.pieces}
    return sum(scores.get(i, 0.0) for i in ids)


def test_segmentation_has_the_best_total():
    for unit in ("▁hello", "▁▁▁thntblereof", "internationalisation", "▁école", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x"):
        assert total(SEGMENTER.best(unit)) == plain(unit)


def test_units_that_walk_together_equal_units_read_alone():
    rng = random.Random(3)
    signs = [chr(c) for c in SEGMENTER.walk.signs]
    units = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 48))) for _ in range(300)]
    units += ["▁" * rng.randint(0, 3) + "".join(rng.choice("theanorsdigi") for _ in range(rng.randint(1, 20))) for _ in range(700)]
    assert all(SEGMENTER.walk.fits(u) for u in units)
    got = list(SEGMENTER.walk.best(units))
    assert got == [array("i", SEGMENTER.best(u)).tobytes() for u in units]


def test_bytes_stand_for_what_no_piece_reaches():
    ids = SEGMENTER.best("a\U0001f9ffb")
    assert [i for i in ids if i in WORDS.bytes_] == [WORDS.bytes_[b] for b in "\U0001f9ff".encode()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60) | st.text(alphabet=" ab\n▁é\t", max_size=30))
def test_cutting_into_units_changes_nothing_and_decoding_is_exact(text):
    import numpy as np
    import pyarrow as pa

    ids = np.frombuffer(SEGMENTER.packed_all([text])[0], dtype=np.int32)
    back = P.Decoder(WORDS).texts(pa.array([ids.tolist(), None], type=pa.list_(pa.int32())))
    assert back.to_pylist() == [text, None]
    if text and "▁" not in text:
        assert abs(total(ids.tolist()) - total(SEGMENTER.best("▁" + text.replace(" ", "▁")))) < 1e-6


def test_odd_documents(spark):
    docs = odd.odd_docs(spark)
    coded = P.encoded(docs, WORDS)
    back = P.decoded(coded, WORDS, into="again").collect()
    assert len(back) == docs.count() and all(r["text"] == r["again"] for r in back)
    assert {r["doc_id"]: r["pieces"] for r in back}[2] is None and {r["doc_id"]: r["pieces"] for r in back}[3] == []
    assert P.decoded(P.encoded(odd.empty_docs(spark), WORDS), WORDS).count() == 0


def test_query_round_trips_every_text(spark, small):
    rows = QUERIES["op5_sentencepiece"](spark, small)
    assert rows.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert rows.where("NOT round_trip OR n_pieces != size(pieces)").count() == 0
