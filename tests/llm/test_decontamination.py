"""Re-parameterised items are found, inconsistent slots are not; the query against plain search."""

import re

import odd
from scorebook.llm import templates as D
from scorebook.llm.queries import QUERIES

ITEM = "A train leaves Paris at 9 hours and goes 120 km to meet Anna who walks 4 km each day"


def found(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows, hits = D.contaminated(docs, bench)
    assert rows.count() == docs.count()
    pairs = hits.join(rows.select("__row", "doc_id"), "__row").collect()
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in pairs}


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_reparameterised_items(spark):
    other = ITEM.replace("Paris", "Rome").replace("Anna", "Otto").replace("120", "75").replace("4", "6")
    swapped = ITEM.replace("120", "9")  # two values of the item become one
    unlike = ITEM.replace("train leaves", "ship sails").replace("goes", "swims").replace("meet", "greet").replace("walks", "runs").replace("each", "every")
    docs = table(spark, [f"Intro text. {ITEM} and so on", f"so. {other}!", swapped, unlike, "nothing of it", ITEM[: len(ITEM) // 4]])
    assert found(spark, docs, [ITEM, "two words", ""]) == {(0, 0): True, (1, 0): False}


def test_other_copies_and_stray_windows_take_nothing_away(spark):
    other = ITEM.replace("120", "75").replace("Anna", "Otto")
    put_in = ITEM.replace("to meet", "just to meet")
    stray = "goes 31 km to meet Bob who walks 8 km"
    texts = [f"{ITEM}. {other}", f"{other}. {ITEM}", f"{ITEM}. {'Some other words. ' * 9}{stray}", f"{other}. {stray}", f"{put_in}. {'And so on. ' * 20}{other}"]
    got = found(spark, table(spark, texts), [ITEM, other])
    assert {k for k in got if k[1] == 0} == {(i, 0) for i in range(5)}
    assert {k: v for k, v in got.items() if k[0] < 2} == {(i, j): True for i in (0, 1) for j in (0, 1)}
    assert got[3, 0] is False and got[3, 1] is True


def test_verbatim_copies_in_any_context_and_case(spark):
    short, names = "What is the capital of France", "When did Maria Keller and Otto Braun meet Anna Weiss in the town of Bern"
    texts = [f"{a}{short}" for a in ("Q: ", "so '", "- ", "(", "he said what ", "")]
    texts += [short.lower(), short.upper(), names.lower(), names.upper(), f"Q: {names}", "What is the shape of France"]
    want = {(i, 0): True for i in range(8)} | {(i, 1): True for i in range(8, 11)}
    assert found(spark, table(spark, texts), [short, names]) == want


def test_items_without_telling_windows_are_found_verbatim(spark):
    items = ["Compute 12 + 7 - 3 * 5", "Anna, Otto, Bern, Rome", "Five songs", "1.5 kg, 2 kg, 3 kg, 4 kg, 5 kg, 6 kg", "Yes"]
    texts = [f"so: {i} then" for i in items] + ["Compute 12 + 8 - 3 * 5", "Anna, Otto, Bern, Oslo", "six songs", "yesterday"]
    assert found(spark, table(spark, texts), items) == {(i, i): True for i in range(5)}


def test_kinds_of_tokens():
    memory = D.Tokens()
    _, kind, template, _ = D.canonical(["Then Bob ran 5 km in May. Then he sat in a km"], memory)
    L, N, I, U = D.LITERAL, D.NAME, D.NUMBER, D.UNIT
    assert kind.tolist() == [L, N, L, I, U, L, N, L, L, L, L, L, L]
    assert template[3] == I and template[1] == N


def test_short_items_are_windows_of_their_own(spark):
    docs = table(spark, ["x y. they sing five old songs now", "they sing five"])
    assert set(found(spark, docs, ["they sing five old songs"])) == {(0, 0)}


def test_a_passage_repeated_and_shared_by_many(spark):
    text = "we walk along the river until the old mill stands before us"
    docs = table(spark, [f"{text}. {text}. {text}"] * 50 + ["another text without it at all"] * 10)
    assert set(found(spark, docs, [text, text])) == {(i, j) for i in range(50) for j in (0, 1)}


def test_odd_documents(spark):
    docs = odd.odd_docs(spark, [(None, ITEM, None, None), (50, ITEM, None, None)])
    assert set(found(spark, docs, [ITEM])) == {(None, 0), (50, 0)}
    assert found(spark, odd.empty_docs(spark), [ITEM]) == {} and found(spark, docs, []) == {}
    nulls = spark.createDataFrame([(None, None), (1, None), (None, ITEM)], "item_id bigint, text string")
    rows, hits = D.contaminated(docs, nulls)
    assert rows.count() == docs.count() and hits.count() >= 0


def test_query_equals_a_plain_search(spark):
    folder = "/root/testdata/sf0.01"

    def words(t):
        return " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "

    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        whole = words(r["text"])
        want |= {(r["doc_id"], i) for i, w in items if w in whole}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_template_decontamination"](spark, folder).collect()}
    assert got == want and want
