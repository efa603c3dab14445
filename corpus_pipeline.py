"""The training-data pipeline: five stages over documents, each written before the next reads it.

A stage takes documents and gives documents, with the columns and names they came with; only the
last gives more.  Inside a stage the columns have names of their own, so none of them clashes with
what an operator adds.  Documents without an ID or a text go through every stage by what the
operators define for them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.llm import pieces, secret_owners, superminhash, templates, toxic_crf
from scorebook.llm.common import stored, table

TOXIC_FROM = 0.3
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` with neutral column names, the neutral name of each column, and all of them."""
    safe = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*safe), dict(zip(docs.columns, safe, strict=True)), safe


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    safe, name, columns = renamed(docs)
    model = toxic_crf.train(safe, table(spark, sf_dir, "labels"), doc_id=name["doc_id"], text=name["text"])
    scored = toxic_crf.scored(safe, model, text=name["text"])
    return scored.where(F.col("score") < TOXIC_FROM).select(*columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, similarity 0.8."""
    safe, name, columns = renamed(docs)
    found = superminhash.grouped(safe, doc_id=name["doc_id"], text=name["text"], width=5, percent=80)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    kept = safe.join(dropped, F.col(name["doc_id"]).cast("bigint") == F.col("__dropped"), "left_anti")
    return kept.select(*columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    safe, name, columns = renamed(docs)
    rows, found = templates.contaminated(safe, table(spark, sf_dir, "benchmark"), text=name["text"])
    none, some = rows.where(F.size("hits") == 0), rows.where(F.size("hits") > 0)
    clean = some.join(found.select("__row").distinct(), "__row", "left_anti")
    return none.select(*columns).unionByName(clean.select(*columns)).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials and copied examples replaced in the text."""
    safe, name, columns = renamed(docs)
    safe = safe.withColumn("__repository", F.col(name["doc_id"]))
    found = secret_owners.judged(safe, owner=name["source"], repository="__repository", text=name["text"])
    return secret_owners.redacted(found, text=name["text"]).select(*columns).toDF(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, *, model: str = MODEL) -> DataFrame:
    """All documents with ``pieces`` and ``n_pieces``; their texts are those the pieces give back."""
    safe, name, columns = renamed(docs)
    words = pieces.vocabulary(model)
    back = pieces.encoded(safe, words, text=name["text"], back=name["text"])
    size = F.coalesce(F.size("pieces"), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c.lower() not in ("pieces", "n_pieces")]
    return back.select(*[F.col(name[c]).alias(c) for c in own], "pieces", size.alias("n_pieces"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: A fitted model and hashed signatures have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
