"""Sinks: spreadsheet-safe CSV, scored files, JSON aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions import expr as E
from scorebook.operators.validation import ContractError

TRIGGERS = ("=", "+", "-", "@", "\t", "\r")


def safe_name(name: str) -> str:
    """A column name no spreadsheet would run."""
    return f"'{name}" if name.startswith(TRIGGERS) else name


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Text cells and column names defused; numbers are data and stay as they are."""
    out = [
        (E.defuse(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(
            safe_name(f.name)
        )
        for f in df.schema.fields
    ]
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files, each with a header and safe to open in a spreadsheet."""
    spreadsheet_safe(df).write.csv(path, header=True, escape='"', mode="errorifexists")


def scored_file(
    scored: DataFrame, inputs: Sequence[str], *, id: str | None, row: str = "row", score: str = "score"
) -> DataFrame:
    """A scored file's columns: position, ID if it has one, predictions, inputs.  Never a label."""
    identity = [id] if id and id in scored.columns else []
    return scored.select(row, *identity, score, "risk_band", "flagged", *inputs)


def not_finite(df: DataFrame) -> DataFrame:
    """Rows with a NaN or an infinity, which JSON cannot say."""
    bad = F.lit(False)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return df.where(bad)


def write_json(df: DataFrame, path: str) -> None:
    """One aggregate as JSON lines, every key always there; refused if a number is not finite."""
    if not not_finite(df).limit(1).isEmpty():
        raise ContractError("an aggregate holds a number JSON cannot say")
    df.write.json(path, ignoreNullFields=False, mode="errorifexists")
