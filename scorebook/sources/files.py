"""File sources: raw and contract CSV, pinned files, reports, aggregates and attribution tables.

A bulk CSV is read as lines, so a file of any size splits across tasks; a record with a line break
inside quotes needs ``multiline=True``, which reads each file in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from scorebook.functions import expr as E
from scorebook.operators.prefix import positions
from scorebook.operators.validation import Contract, ContractError, clean, problems

BOM = "﻿"


def all_text(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every column as text, nothing guessed: blanks stay blanks that can be counted."""
    return spark.read.csv(
        path, header=True, schema=all_text(columns), ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, mode="PERMISSIVE",
    )


# --- pinned files ------------------------------------------------------------------------------


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256, bytes and data rows of each file.  One file is hashed in one task, so a pinned
    dataset is best kept as a folder of part files."""
    hashed = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )
    lines = (
        spark.read.text(path)
        .select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"))
        .groupBy("file")
        .agg((F.count(F.lit(1)) - 1).alias("rows"))
    )
    return hashed.join(lines, "file", "left").fillna(0, subset=["rows"])


def pin_differences(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """Files that are not the pinned ones.  ``pins`` is (file, sha256, rows)."""
    want = pins.select("file", F.col("sha256").alias("w_sha"), F.col("rows").alias("w_rows"))
    joined = file_facts(spark, path).join(want, "file", "full")
    reason = (
        F.when(F.col("w_sha").isNull(), "not pinned")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.col("rows") != F.col("w_rows"), "another number of rows")
        .when(F.col("sha256") != F.col("w_sha"), "another content")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("file", "reason")


# --- contract CSV ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Caps:
    """Limits an upload is held to; readers of whole tables have none unless asked."""

    bytes: int = 5 * 1024 * 1024
    columns: int = 1000
    rows: int = 10_000


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines without byte-order marks and blank lines, with their place in the file."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_id"),
            F.regexp_replace("value", BOM, "").alias("line"),
        )
        .where(F.trim("line") != "")
    )


def split_line(line: Column) -> Column:
    """The fields of a line as they stand: separators outside quotes only."""
    return F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def bare_names(parts: Sequence[str]) -> list[str]:
    return [p[1:-1].replace('""', '"') if len(p) > 1 and p[0] == p[-1] == '"' else p for p in parts]


def headers_of(lines: DataFrame) -> DataFrame:
    """(file, head, head_id): the first line of each file that is not blank, and its place."""
    return (
        lines.where(F.col("block") == 0)
        .groupBy("file")
        .agg(F.min(F.struct("line_id", "line")).alias("h"))
        .select("file", F.col("h.line").alias("head"), F.col("h.line_id").alias("head_id"))
    )


def layouts(heads: DataFrame, contract: Contract, caps: Caps | None) -> dict[str, list[str]]:
    """The names of every different header, each checked; part files rarely have more than one.

    A header that cannot be read is refused with the first file that has it.
    """
    found = heads.groupBy("head").agg(F.min("file").alias("file")).withColumn("parts", split_line(F.col("head")))
    out = {}
    for row in found.orderBy("head").toLocalIterator():
        out[row["head"]] = bare_names(row["parts"])
        try:
            check_header(out[row["head"]], contract, caps)
        except ContractError as refused:
            raise ContractError(f"{row['file']}: {refused}") from refused
    if not out:
        raise ContractError("file is empty")
    return out


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names of the first file's header."""
    row = headers_of(text_lines(spark, path)).orderBy("file").select(split_line(F.col("head")).alias("parts")).first()
    if row is None:
        raise ContractError("file is empty")
    return bare_names(row["parts"])


def check_header(header: Sequence[str], contract: Contract, caps: Caps | None = None) -> None:
    """Refuse a header that cannot be read the one way it was meant."""
    if len(header) == 1 and ";" in header[0]:
        raise ContractError("fields are parted by semicolons; the contract asks for commas")
    if caps and len(header) > caps.columns:
        raise ContractError(f"file has {len(header):,} columns; the limit is {caps.columns:,}")
    known = set(contract.columns)
    repeated = sorted({c for c in header if c in known and list(header).count(c) > 1})
    if repeated:
        raise ContractError(f"the header names {', '.join(repeated)} twice")


def field_count(line: str | Column) -> Column:
    """Fields of one CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(E.col(line), '"(?:[^"]|"")*"', "")
    return F.regexp_count(bare, F.lit(",")) + 1


def contract_rows(
    spark: SparkSession,
    path: str,
    contract: Contract,
    *,
    caps: Caps | None = None,
    multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of a contract CSV, one file or a folder of part files.

    Every file's first line is its own header; files may order their columns differently and a row
    that reads like a header is a row.  ``rows`` holds the contract's columns that any file has,
    all text, with ``file``, ``block`` and ``line_id`` for the row's place; short rows and columns
    a file lacks are blank.  ``refused`` holds the records with more fields than their header and
    the lines whose quotes stay open.
    """
    lines = text_lines(spark, path)
    heads = headers_of(lines)
    names = layouts(heads, contract, caps)
    keep = [c for c in contract.columns if any(c in header for header in names.values())]
    if multiline:
        read = [multiline_rows(spark, heads, head, header, keep) for head, header in names.items()]
        good, bad = (reduce(DataFrame.unionByName, side) for side in zip(*read, strict=True))
        return good, bad
    width = max(len(header) for header in names.values())
    fields = [f"c{i}" for i in range(width)]

    def by_header(value) -> Column:
        """The value that belongs to the header of a row's file."""
        chosen = F
        for head, header in names.items():
            chosen = chosen.when(F.col("head") == head, value(header))
        return chosen

    body = lines.join(heads, "file").where(F.col("line_id") != F.col("head_id"))
    opened = F.regexp_count("line", F.lit('"')) % 2 == 1
    wide = field_count("line") > by_header(lambda header: F.lit(len(header)))
    reason = F.when(opened, "a quote stays open").when(wide, "too many fields")
    marked = body.withColumn("reason", reason)
    parsed = marked.where(F.col("reason").isNull()).withColumn(
        "r",
        F.from_csv("line", all_text(fields).simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"}),
    )

    def placed(name: str) -> Column:
        blank = F.lit("")
        at = by_header(lambda h: F.coalesce(F.col("r").getField(fields[h.index(name)]), blank) if name in h else blank)
        return at.alias(name)

    return (
        parsed.select("file", "block", "line_id", *[placed(c) for c in keep]),
        marked.where(F.col("reason").isNotNull()).select("file", "line_id", "line", "reason"),
    )


def multiline_rows(
    spark: SparkSession, heads: DataFrame, head: str, header: list[str], keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The rows and refused records of the files with one header, each file read in one task."""
    paths = [r["file"] for r in heads.where(F.col("head") == head).select("file").orderBy("file").toLocalIterator()]
    names = [f"c{i}" for i in range(len(header))]
    read = spark.read.csv(
        paths, header=True, multiLine=True, schema=all_text([*names, "record"]),
        columnNameOfCorruptRecord="record", mode="PERMISSIVE",
    ).select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    # A query may not read the corrupt record alone, so the first field is looked at too.
    real = F.coalesce(names[0], F.lit("")) != F.lit("\0")
    wide = F.col("record").isNotNull() & (field_count("record") > len(header)) & real
    good, bad = read.where(~wide), read.where(wide)

    def placed(name: str) -> Column:
        if name not in header:
            return F.lit("").alias(name)
        return F.regexp_replace(F.coalesce(F.col(names[header.index(name)]), F.lit("")), BOM, "").alias(name)

    return (
        good.select("file", "block", "line_id", *[placed(c) for c in keep]),
        bad.select("file", "line_id", F.col("record").alias("line"), F.lit("too many fields").alias("reason")),
    )


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``row``, their 1-based place in their file."""
    return positions(
        rows, [F.col("block").asc(), F.col("line_id").asc()], output="row", keys=["file"]
    )


def validate_upload(
    spark: SparkSession,
    path: str,
    contract: Contract,
    *,
    columns: Sequence[str],
    caps: Caps = Caps(),
    multiline: bool = False,
) -> DataFrame:
    """An uploaded file, cleaned and checked; the cheapest check comes first.

    Bytes (from the file listing), header, row count (stops at the cap), row widths, then
    every value problem at once.  Nothing is dropped, derived or guessed.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("b")).first()["b"]
    if (size or 0) > caps.bytes:
        raise ContractError(f"file is too large: {size:,} bytes; the limit is {caps.bytes:,}")
    rows, refused = contract_rows(spark, path, contract, caps=caps, multiline=multiline)
    if rows.limit(caps.rows + 1).count() > caps.rows:
        raise ContractError(f"file has more than {caps.rows:,} data rows")
    if worst := refused.limit(1).collect():
        raise ContractError(f"{worst[0]['reason']}: {worst[0]['line'][:80]}")
    if rows.isEmpty():
        raise ContractError("nothing follows the header")
    numbered = numbered_rows(rows).drop("block", "line_id")
    ready = clean(numbered, contract, deduplicate=False, derive=False)
    label = [contract.label] if contract.label in rows.columns else []
    found = problems(ready, contract, columns=[*columns, *label]).collect()
    if found:
        raise ContractError("; ".join(f"{p['column']}: {p['check']} ({p['n']})" for p in found))
    return ready


# --- reports, aggregates, attributions ------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def read_report(
    spark: SparkSession,
    path: str,
    schema: str,
    *,
    numbers: Sequence[str],
    shares: Sequence[str] = (),
) -> DataFrame | None:
    """A CSV report of known shape: typed, every number finite, shares in [0, 1].  A missing
    file is ``None``; a damaged one is refused."""
    if not exists(spark, path):
        return None
    wanted = T.StructType.fromDDL(schema)
    header = header_of(spark, path)
    if absent := [f.name for f in wanted.fields if f.name not in header]:
        raise ContractError(f"the report is missing column(s) {absent}")
    text = spark.read.csv(path, header=True, schema=all_text(header))
    bad = F.lit(False)
    for c in numbers:
        value = F.col(c).try_cast("double")
        wrong = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        if c in shares:
            wrong = wrong | ~value.between(0.0, 1.0)
        bad = bad | wrong
    if not text.where(bad).limit(1).isEmpty():
        raise ContractError("the report holds a blank, non-finite or out-of-range number")
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


# Kinds a field of a closed aggregate format may be.
KINDS: Mapping[str, tuple[str, object]] = {
    "count": ("bigint", lambda c: c >= 0),
    "share": ("double", lambda c: c.between(0.0, 1.0)),
    "number": ("double", lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))),
    "text": ("string", lambda c: F.length(c).between(1, 64)),
}


def closed_json_problems(
    spark: SparkSession, path: str, fields: Mapping[str, str], identity: Mapping[str, object] | None = None
) -> DataFrame:
    """Records of a JSON-lines aggregate that are not exactly of the closed format.

    ``fields`` maps each key to a kind, with a trailing ``?`` where null is allowed;
    ``identity`` gives keys that must hold one fixed value.
    """
    lines = spark.read.text(path).select(F.col("value").alias("record"))
    keys = F.array_sort(F.json_object_keys("record"))
    wanted = F.array(*[F.lit(k) for k in sorted(fields)])
    typed = ", ".join(f"`{k}` {KINDS[kind.rstrip('?')][0]}" for k, kind in fields.items())
    parsed = lines.select(
        "record",
        keys.eqNullSafe(wanted).alias("same_keys"),
        F.from_json("record", f"{typed}, `_corrupt` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    fine = F.lit(True)
    for k, kind in fields.items():
        c = F.col(f"r.`{k}`")
        valid = F.coalesce(KINDS[kind.rstrip("?")][1](c), F.lit(False))
        fine = fine & ((c.isNull() | valid) if kind.endswith("?") else valid)
    reason = F.when(~F.col("same_keys"), "other keys").when(
        F.col("r._corrupt").isNotNull(), "not of the stated types"
    ).when(~fine, "a value outside its kind")
    for k, value in (identity or {}).items():
        reason = reason.when(~F.col(f"r.`{k}`").eqNullSafe(F.lit(value)), f"bound to another {k}")
    return parsed.select("record", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_closed_json(
    spark: SparkSession, path: str, fields: Mapping[str, str], identity: Mapping[str, object] | None = None
) -> DataFrame:
    """A JSON-lines aggregate, refused as a whole if any record is not of the closed format."""
    found = closed_json_problems(spark, path, fields, identity).limit(1).collect()
    if found:
        raise ContractError(f"{found[0]['reason']}: {found[0]['record'][:120]}")
    typed = ", ".join(f"`{k}` {KINDS[kind.rstrip('?')][0]}" for k, kind in fields.items())
    return spark.read.schema(typed).json(path)


def read_attributions(
    spark: SparkSession,
    path: str,
    *,
    model_hash: str,
    features: Sequence[str],
    vocabularies: Mapping[str, Sequence[str]],
) -> DataFrame | None:
    """A long attribution table (id, feature, value, contribution, model_hash), or ``None`` when
    it is absent, damaged or of another model."""
    schema = "id bigint, feature string, value string, contribution double, model_hash string"
    if not exists(spark, path):
        return None
    table = spark.read.schema(schema).parquet(path)
    wrong = (
        F.col("contribution").isNull()
        | F.isnan("contribution")
        | ~F.col("feature").isin(*features)
        | ~F.col("model_hash").eqNullSafe(F.lit(model_hash))
    )
    for feature, words in vocabularies.items():
        wrong = wrong | ((F.col("feature") == feature) & ~F.col("value").isin(*words))
    per_row = table.groupBy("id").agg(
        F.count_distinct("feature").alias("f"), F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(wrong, F.lit(True)).cast("int")).alias("w"),
    )
    size = len(features)
    summary = per_row.agg(
        F.count(F.lit(1)).alias("ids"),
        F.count_if((F.col("f") != size) | (F.col("n") != size) | (F.col("w") > 0)).alias("bad"),
    ).first()
    return None if summary["ids"] == 0 or summary["bad"] else table
