"""The pipeline's stages on their own input, against what each should keep."""

import re

import corpus_pipeline as P
import odd
import test_near_duplicates
import test_secrets
from __spark_entry__ import oracle_sql, queries
from scorebook.llm import toxic_crf
from scorebook.llm.common import stored

FOLDER = "/root/testdata/sf0.01"


def words(t):
    return " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "


def test_stages_and_the_whole(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "sentencepiece"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in P.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in inputs.items()}

    first = inputs["toxicity"]
    model = toxic_crf.train(first, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r["doc_id"] for r in toxic_crf.scored(first, model).where("score < 0.3").collect()}
    assert set(ids["near_dedup"]) == clean

    texts = {r["doc_id"]: r["text"] for r in inputs["near_dedup"].collect()}
    groups, _ = test_near_duplicates.all_pairs(list(texts.items()), 5, 80)
    assert set(ids["decontamination"]) == {i for i, g in groups.items() if i == g}

    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(ids["secrets"]) == {i for i in ids["decontamination"] if not any(w in words(texts[i]) for w in items)}

    before = {i: texts[i] for i in ids["secrets"]}
    after = {r["doc_id"]: r["text"] for r in inputs["sentencepiece"].collect()}
    assert set(after) == set(before)
    for i, text in before.items():
        assert not test_secrets.base(after[i])
        if not test_secrets.base(text) and "[SECRET" not in after[i]:
            assert after[i] == text

    final = docs.collect()
    assert {r["doc_id"]: r["text"] for r in final} == after
    assert all(r["n_pieces"] == len(r["pieces"]) for r in final)
    assert sorted(r["doc_id"] for r in P.run(spark, FOLDER).select("doc_id").collect()) == sorted(after)


def test_odd_documents_go_through_every_stage(spark):
    for make in (odd.odd_docs, odd.empty_docs):
        docs = make(spark)
        for name, stage in P.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            assert out.count() == docs.count() if name != "near_dedup" else out.count() <= docs.count()
    assert out.columns[-2:] == ["pieces", "n_pieces"]


def test_every_numbered_query_is_served():
    served = queries()
    assert {int(n[2:].split("_")[0]) for n in served if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert "pipeline" in served and set(oracle_sql()) <= set(served)
