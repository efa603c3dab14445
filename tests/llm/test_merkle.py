"""Trees against plain hashing, proofs and tampering, odd documents, the SQL."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import compare
import odd
from scorebook.llm import merkle as M
from scorebook.llm.queries import ORACLES, QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(nodes, fan):
    """Root and, per leaf, the siblings of each level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % fan
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fan])))
        nodes = [h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [p // fan for p in at]
    return nodes[0], paths


def plain(rows, fan):
    """(grp, doc_id, leaf, path, subroot, root) for (grp, doc_id, leaf) rows."""
    groups = {}
    for grp, doc, leaf in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(grp, []).append((doc, leaf))
    trees = {g: fold([leaf for _, leaf in own], fan) for g, own in groups.items()}
    names = sorted(trees, key=str.encode)
    root, tops = fold([trees[g][0] for g in names], fan)
    out = []
    for g, top in zip(names, tops, strict=True):
        subroot, paths = trees[g]
        out += [(g, doc, leaf, tuple(path + top), subroot, root) for (doc, leaf), path in zip(groups[g], paths, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "levels", "seed"), [(2, 8, 1), (2, 2, 2), (3, 1, 3), (4, 2, 4), (2, 1, 5)])
def test_paths_and_roots_equal_plain_trees(spark, monkeypatch, fan, levels, seed):
    monkeypatch.setattr(M, "LEVELS", levels)
    rng = random.Random(seed)
    rows = [(rng.choice(["0", "1de", "1en", "1en", "1é", "1"]), rng.choice([None, *range(50)]), h(str(i))) for i in range(120)]
    rows += [("1single", 7, h("s")), ("1en", 3, h("tie")), ("1en", 3, h("tie"))]
    df = spark.createDataFrame(rows, "grp string, doc_id bigint, leaf string").repartition(5)
    got = M.manifest(df, fan=fan).collect()
    mine = sorted(
        ((r["grp"], r["doc_id"], r["leaf"], tuple((s["left"], s["right"]) for s in r["path"]), r["subroot"], r["root"]) for r in got), key=repr
    )
    assert mine == plain(rows, fan)


def test_leaves_tell_every_field_apart(spark):
    rows = [(1, "a", None), (1, None, "a"), (1, "", ""), (11, "", ""), (None, "-", "1:a"), (1, "1:a", "-")]
    df = spark.createDataFrame(rows, "n bigint, a string, b string")
    got = [r[0] for r in df.select(M.leaf(F.col("n"), F.col("a"), F.col("b"))).collect()]

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    assert got == [h("".join(map(field, r))) for r in rows] and len(set(got)) == len(rows)


def test_a_proof_holds_for_its_leaf_alone(spark):
    rows = [("1en", i, h(str(i))) for i in range(37)]
    df = spark.createDataFrame(rows, "grp string, doc_id bigint, leaf string")
    tried = M.manifest(df).select(
        (M.refolded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"),
        (M.refolded(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("path")) == F.col("root")).alias("other"),
        (M.proof(F.col("path")) == F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)).alias("proof"),
    )
    assert all(r["own"] and not r["other"] and r["proof"] for r in tried.collect())


def test_odd_documents(spark):
    docs = odd.odd_docs(spark)
    rows = docs.select(M.group_key(F.col("lang")).alias("grp"), "doc_id", M.leaf(F.col("doc_id"), F.col("text")).alias("leaf"), F.lit("c").alias("Score"))
    got = M.manifest(rows)
    assert got.count() == docs.count() and got.where("leaf IS NULL OR root IS NULL OR size(path) = 0").count() == 0
    assert got.select("root").distinct().count() == 1
    assert M.manifest(rows.limit(0)).count() == 0
    alone = M.manifest(rows.limit(1)).first()
    assert alone["path"] == [] and alone["root"] == alone["subroot"] == alone["leaf"]


def test_query_equals_its_sql(spark, small):
    query = QUERIES["op13_merkle_manifest"]
    assert compare.differences(spark, query, ORACLES["op13_merkle_manifest"], small) == []
    rows = query(spark, small).select((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).alias("tampered"), "verified").collect()
    assert all(r["verified"] != r["tampered"] for r in rows) and any(r["tampered"] for r in rows)
