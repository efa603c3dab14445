"""Cleaning, checks, file sources and sinks on small files written here."""

import json
from pathlib import Path

import pytest

from scorebook.operators import validation as V
from scorebook.operators.tables import named_rows
from scorebook.sources import files, sinks

CONTRACT = V.Contract(
    id="id",
    label="churn",
    numbers={"tenure": (0.0, 120.0), "monthly_charges": (0.0, 1000.0), "total_charges": (0.0, 1e5)},
    categories={"net": ("DSL", "Fiber", "No"), "addon": ("No", "Yes", "No internet")},
    integers=("tenure",),
    exactly_when=(("addon", "No internet", "net", "No"),),
    zero_together=(("total_charges", "tenure"),),
)
RAW = "id string, tenure string, monthly_charges string, total_charges string, net string, addon string, churn string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


GOOD = ("a", "10", "20", "200", "DSL", "Yes", "Yes")


def test_blank_total_is_a_fact_at_zero_tenure_and_an_estimate_otherwise(spark):
    df = frame(
        spark, GOOD, ("b", "0", "20", " ", "DSL", "No", "No"), ("c", "3", "20", "", "DSL", "No", "No"),
        ("d", "3", "20", "n/a", "DSL", "No", "No"),
    )
    def totals(derive):
        rows = V.clean(df, CONTRACT, derive=derive).collect()
        return {r["id"]: r["total_charges"] for r in rows}

    assert totals(True) == {"a": 200.0, "b": 0.0, "c": 60.0, "d": None}
    assert totals(False) == {"a": 200.0, "b": 0.0, "c": None, "d": None}
    report = V.cleaning_report(df, CONTRACT).first()
    assert (report["blank_totals"], report["filled_zero"], report["filled_derived"]) == (2, 1, 1)
    assert report["stripped_columns"] == "total_charges"


def test_duplicates_are_dropped_only_when_asked(spark):
    df = frame(spark, GOOD, GOOD)
    assert V.clean(df, CONTRACT).count() == 1
    assert V.clean(df, CONTRACT, deduplicate=False).count() == 2


def test_label_is_encoded_only_if_every_label_is_known(spark):
    known = V.encode_label(frame(spark, GOOD, (*GOOD[:6], "No")), CONTRACT)
    assert sorted(r["churn"] for r in known.collect()) == [0, 1]
    odd = V.encode_label(frame(spark, GOOD, (*GOOD[:6], "perhaps")), CONTRACT)
    assert [r["churn"] for r in odd.collect()] == [None, None]


def test_all_problems_come_at_once(spark):
    df = frame(
        spark, GOOD, ("b", "-1", "20", "5", "Cable", "Yes", "maybe"), ("c", "1.5", "x", "5", "No", "Yes", None)
    )
    found = {(p["check"], p["column"]): p["n"] for p in V.problems(V.clean(df, CONTRACT), CONTRACT).collect()}
    assert found == {
        ("outside the valid range", "tenure"): 1,
        ("not a whole number", "tenure"): 1,
        ("missing or not a number", "monthly_charges"): 1,
        ("contradicts net", "addon"): 1,
        ("missing label", "churn"): 1,
        ("unexpected value", "net"): 1,
        ("unexpected value", "churn"): 1,
    }


def test_no_rows_and_booleans_are_problems(spark):
    empty = V.problems(frame(spark, GOOD).where("false"), CONTRACT).collect()
    assert ("no rows", 1) in {(p["check"], p["n"]) for p in empty}
    df = spark.createDataFrame([(True,)], "tenure boolean")
    found = {p["check"] for p in V.problems(df, CONTRACT, columns=["tenure"]).collect()}
    assert "boolean where a number belongs" in found


def test_sound_data_has_no_problem(spark):
    assert V.problems(V.clean(frame(spark, GOOD), CONTRACT), CONTRACT).isEmpty()


def test_unexpected_values_are_counted_and_quoted_in_part(spark):
    rows = [(f"v{i:02d}",) for i in range(12)] + [("v00",)]
    df = spark.createDataFrame(rows, "net string")
    p = V.unexpected_values(df, {"net": ("DSL",)}).first()
    assert p["examples"] == ["v00", "v01", "v02", "v03", "v04"] and (p["n"], p["more"]) == (13, 7)


def test_repeated_ids_are_refused(spark):
    df = frame(spark, GOOD, (GOOD[0], *GOOD[1:6], "No"))
    with pytest.raises(V.ContractError):
        V.features_and_target(df, ["net"], CONTRACT)


def test_input_columns_keep_the_contract_order():
    assert V.model_input_columns(CONTRACT, drop=("addon",), optional=("total_charges",)) == [
        "net", "tenure", "monthly_charges",
    ]
    with pytest.raises(V.ContractError):
        V.split_types(["net", "colour"], CONTRACT)
    assert V.ignored_columns(["id", "note", "net"], CONTRACT) == ["note"]


# --- files ---------------------------------------------------------------------------------------


def write(tmp_path: Path, text: str) -> str:
    path = tmp_path / "upload.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


HEAD = "id,note,tenure,monthly_charges,total_charges,net,addon\n"


def test_marks_blank_lines_and_short_rows(spark, tmp_path):
    path = write(tmp_path, "\n﻿" + HEAD + '﻿1,"x, ""y""",2,3\n   \n2,z,4,5,20,DSL,Yes\n')
    rows, refused = files.contract_rows(spark, path, CONTRACT)
    got = {r["id"]: r.asDict() for r in rows.collect()}
    assert refused.isEmpty() and set(got) == {"1", "2"}
    assert (got["1"]["tenure"], got["1"]["net"]) == ("2", "") and got["2"]["addon"] == "Yes"
    assert "note" not in rows.columns


def test_wide_rows_and_open_quotes_are_refused(spark, tmp_path):
    path = write(tmp_path, HEAD + "1,n,2,3,6,DSL,Yes,\n2,\"open,2,3,6,DSL,Yes\n3,n,2,3,6,DSL,Yes\n")
    rows, refused = files.contract_rows(spark, path, CONTRACT)
    assert [r["id"] for r in rows.collect()] == ["3"]
    assert {r["reason"] for r in refused.collect()} == {"too many fields", "a quote stays open"}


def test_line_breaks_inside_quotes_need_multiline(spark, tmp_path):
    path = write(tmp_path, HEAD + '1,"a\nb",2,3,6,DSL,Yes\n2,n,2,3,6,DSL,Yes\n')
    rows, refused = files.contract_rows(spark, path, CONTRACT, multiline=True)
    assert refused.isEmpty() and sorted(r["id"] for r in rows.collect()) == ["1", "2"]


@pytest.mark.parametrize(
    "header", ["id;tenure;net", "id,net,net", ",".join(f"c{i}" for i in range(1001))]
)
def test_headers_that_cannot_be_read_one_way_are_refused(header):
    with pytest.raises(V.ContractError):
        files.check_header(header.split(",") if "," in header else [header], CONTRACT, files.Caps())


@pytest.mark.parametrize("multiline", [False, True])
def test_every_part_file_has_its_own_header(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text("id,net,tenure\n1,DSL,5\nid,net,tenure\n2,No\n")
    (tmp_path / "b.csv").write_text("\nid,tenure,extra,net\n3,7,x,Fiber\n4,8,y,DSL\n")
    rows, refused = files.contract_rows(spark, str(tmp_path), CONTRACT, multiline=multiline)
    got = {r["id"]: (r["net"], r["tenure"]) for r in rows.collect()}
    assert got == {"1": ("DSL", "5"), "id": ("net", "tenure"), "2": ("No", ""), "3": ("Fiber", "7"), "4": ("DSL", "8")}
    assert refused.isEmpty()
    (tmp_path / "c.csv").write_text("id;net\n5;DSL\n")
    with pytest.raises(V.ContractError, match="c.csv"):
        files.contract_rows(spark, str(tmp_path), CONTRACT, multiline=multiline)


def test_bulk_rows_have_no_column_cap(spark, tmp_path):
    path = write(tmp_path, ",".join(["id", *[f"c{i}" for i in range(1200)]]) + "\n7\n")
    assert [r["id"] for r in files.contract_rows(spark, path, CONTRACT)[0].collect()] == ["7"]


def test_upload_keeps_file_order_and_duplicates(spark, tmp_path):
    body = "".join(f"{9 - i % 3},n,2,3,6,DSL,Yes\n" for i in range(6))
    ready = files.validate_upload(
        spark, write(tmp_path, HEAD + body), CONTRACT,
        columns=["tenure", "monthly_charges", "total_charges", "net", "addon"],
    )
    got = [(r["row"], r["id"]) for r in ready.orderBy("row").collect()]
    assert got == [(i + 1, str(9 - i % 3)) for i in range(6)]


@pytest.mark.parametrize(
    ("text", "caps"),
    [
        (HEAD, files.Caps()),
        (HEAD + "1,n,2,3,6,DSL,Yes\n" * 4, files.Caps(rows=3)),
        (HEAD + "1,n,2,3,6,DSL,Yes\n", files.Caps(bytes=10)),
        (HEAD + "1,n,,3,6,DSL,Yes\n", files.Caps()),
    ],
)
def test_upload_gate_refuses(spark, tmp_path, text, caps):
    with pytest.raises(V.ContractError):
        files.validate_upload(
            spark, write(tmp_path, text), CONTRACT, caps=caps,
            columns=["tenure", "monthly_charges", "total_charges", "net", "addon"],
        )


def test_pins_name_what_differs(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "a.csv").write_text("h\n1\n2\n")
    (folder / "b.csv").write_text("h\n1\n")
    facts = {r["file"]: r for r in files.file_facts(spark, str(folder)).collect()}
    assert facts["a.csv"]["rows"] == 2
    pins = named_rows(
        spark, "file string, sha256 string, rows bigint",
        [("a.csv", facts["a.csv"]["sha256"], 2), ("b.csv", facts["b.csv"]["sha256"], 3), ("c.csv", "0" * 64, 1)],
    )
    got = {r["file"]: r["reason"] for r in files.pin_differences(spark, str(folder), pins).collect()}
    assert got == {"b.csv": "another number of rows", "c.csv": "missing"}


def test_reports_are_typed_or_refused(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("feature,strength\na,0.5\n")
    bad.write_text("feature,strength\na,1.5\n")
    read = lambda p: files.read_report(
        spark, str(p), "feature string, strength double", numbers=["strength"], shares=["strength"]
    )
    assert read(good).first()["strength"] == 0.5
    assert read(tmp_path / "none.csv") is None
    with pytest.raises(V.ContractError):
        read(bad)


def test_csv_sink_is_safe_to_open(spark, tmp_path):
    df = spark.createDataFrame([("=1", -1.5)], ["@name", "amount"])
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["'@name", "amount"] and tuple(back.first()) == ("'=1", "-1.5")


def test_json_sink_refuses_what_json_cannot_say(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(V.ContractError):
        sinks.write_json(df, str(tmp_path / "out"))


def test_closed_format_refuses_anything_else(spark, tmp_path):
    fields = {"level": "text", "n": "count", "rate": "share?"}
    records = [
        {"level": "a", "n": 3, "rate": None},
        {"level": "a", "n": -3, "rate": 0.1},
        {"level": "", "n": 3, "rate": 0.1},
        {"level": "a", "n": 3},
        {"level": "a", "n": "three", "rate": 0.1},
    ]
    path = tmp_path / "agg.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    found = files.closed_json_problems(spark, str(path), fields).collect()
    assert len(found) == 4
    with pytest.raises(V.ContractError):
        files.read_closed_json(spark, str(path), fields)


def test_damaged_attributions_read_as_absent(spark, tmp_path):
    rows = [(1, "a", "x", 0.1, "h"), (1, "b", "2", -0.1, "h")]
    schema = "id bigint, feature string, value string, contribution double, model_hash string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ok"))
    read = lambda path, h="h": files.read_attributions(
        spark, str(path), model_hash=h, features=["a", "b"], vocabularies={"a": ("x",)}
    )
    assert read(tmp_path / "ok").count() == 2
    assert read(tmp_path / "ok", "other") is None and read(tmp_path / "none") is None
    spark.createDataFrame(rows[:1], schema).write.parquet(str(tmp_path / "short"))
    assert read(tmp_path / "short") is None


def test_scored_file_never_carries_a_label(spark):
    df = spark.createDataFrame([(1, "a", 0.5, "High", True, 1, 3)], "row int, id string, score double, risk_band string, flagged boolean, churn int, tenure int")
    assert sinks.scored_file(df, ["tenure"], id="id").columns == ["row", "id", "score", "risk_band", "flagged", "tenure"]
