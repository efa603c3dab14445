"""Cleaning and checking a table against a contract.

A check never stops at the first problem: it returns a table of problems, empty when the data is
sound.  Nothing here raises inside a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.operators.segments import members
from scorebook.operators.tables import named_rows

WHITESPACE = " \t\n\r\x0b\x0c"

PROBLEM = "check string, column string, n bigint, examples array<string>, more int"


@dataclass(frozen=True)
class Contract:
    """What a table must hold."""

    id: str | None
    label: str | None
    # column -> (low, high), hard bounds
    numbers: Mapping[str, tuple[float, float]]
    # column -> allowed values
    categories: Mapping[str, tuple[str, ...]]
    integers: tuple[str, ...] = ()
    # (column, value, other column, other value): one exactly when the other
    exactly_when: tuple[tuple[str, str, str, str], ...] = ()
    # pairs of numbers that are zero together
    zero_together: tuple[tuple[str, str], ...] = ()
    label_codes: Mapping[str, int] = field(
        default_factory=lambda: {"No": 0, "Yes": 1, "0": 0, "1": 1}
    )
    # A blank ``total`` is 0 at zero ``tenure`` and tenure x amount otherwise.
    tenure: str = "tenure"
    amount: str = "monthly_charges"
    total: str = "total_charges"

    @property
    def columns(self) -> list[str]:
        named = [c for c in (self.id,) if c]
        return [*named, *self.categories, *self.numbers, *[c for c in (self.label,) if c]]


def stripped(c: str) -> Column:
    return F.btrim(F.col(c), F.lit(WHITESPACE))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def number(c: str) -> Column:
    """A column as a finite double; anything else is null."""
    return E.finite(F.col(c).try_cast("double"))


def is_blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


# --- cleaning ----------------------------------------------------------------------------------


def repair(df: DataFrame, contract: Contract, derive: bool) -> DataFrame:
    """Numbers as numbers, and a blank total filled where it is a fact or may be derived.

    Text that is there but is no number stays null, for the checks to report.
    """
    present = [c for c in contract.numbers if c in df.columns]
    values = {c: number(c) for c in present}
    total, tenure, amount = contract.total, contract.tenure, contract.amount
    if total in present and tenure in present:
        blank = is_blank(total)
        never = number(tenure).eqNullSafe(F.lit(0.0))
        filled = F.when(blank & never, F.lit(0.0))
        if derive and amount in present:
            filled = filled.when(blank, number(tenure) * number(amount))
        values[total] = filled.otherwise(number(total))
    texts = {c: F.col(c).cast("string") for c in contract.categories if c in df.columns}
    return df.withColumns(values | texts)


def clean(
    df: DataFrame, contract: Contract, *, deduplicate: bool = True, derive: bool = True
) -> DataFrame:
    """A typed copy: text stripped, exact duplicates dropped, numbers coerced and repaired.

    Scoring a file keeps its duplicates and derives nothing.
    """
    tidy = df.withColumns({c: stripped(c) for c in text_columns(df)})
    if deduplicate:
        tidy = tidy.dropDuplicates()
    return repair(tidy, contract, derive)


def encode_label(df: DataFrame, contract: Contract) -> DataFrame:
    """The label as 0 or 1, but only if every label is a known one; else all are null, so that
    an unknown label never becomes a class."""
    codes = contract.label_codes
    code = E.pick([(F.col(contract.label).cast("string") == k, v) for k, v in codes.items()])
    known = F.coalesce(F.col(contract.label).cast("string").isin(*codes), F.lit(False))
    unknown = df.agg(F.count_if(~known).alias("n"))
    return df.withColumn(contract.label, F.when(unknown.scalar() == 0, code).cast("tinyint"))


def cleaning_report(
    df: DataFrame, contract: Contract, *, deduplicate: bool = True, derive: bool = True
) -> DataFrame:
    """What ``clean`` changes, in one row."""
    texts = text_columns(df)
    changed = {c: F.count_if(stripped(c) != F.col(c)).alias(f"__s_{c}") for c in texts}
    tidy = df.withColumns({c: stripped(c) for c in texts})
    kept = tidy.dropDuplicates() if deduplicate else tidy
    before = df.agg(F.count(F.lit(1)).alias("rows_in"), *changed.values())
    blank = is_blank(contract.total)
    never = number(contract.tenure).eqNullSafe(F.lit(0.0))
    derived = (blank & ~never) if derive else F.lit(False)
    after = kept.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(blank).alias("blank_totals"),
        F.count_if(blank & never).alias("filled_zero"),
        F.count_if(derived).alias("filled_derived"),
    )
    from scorebook.operators.tables import beside

    names = F.array(*[F.when(F.col(f"__s_{c}") > 0, F.lit(c)) for c in texts])
    return beside(before, after).select(
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("duplicates_dropped"),
        "blank_totals",
        "filled_zero",
        "filled_derived",
        F.array_join(F.array_compact(names), ",").alias("stripped_columns"),
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """The rows without exact duplicates."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows a distinct would drop."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("m"))
        .agg(
            F.sum("m").alias("rows_in"),
            F.count(F.lit(1)).alias("rows_out"),
            F.sum(F.col("m") - 1).alias("dropped"),
        )
    )


# --- checks -------------------------------------------------------------------------------------


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns the table does not have: read off the schema, no job."""
    return [c for c in required if c not in df.columns]


def count_checks(df: DataFrame, contract: Contract, columns: Sequence[str]) -> list[tuple[str, str, Column]]:
    """Every check that is a count of rows, as (check, column, count)."""
    out: list[tuple[str, str, Column]] = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c, (low, high) in contract.numbers.items():
        if c not in columns:
            continue
        if isinstance(types[c], T.BooleanType):
            out.append(("boolean where a number belongs", c, F.count(F.col(c))))
        value = number(c)
        out.append(("missing or not a number", c, F.count_if(value.isNull())))
        if c in contract.integers:
            out.append(("not a whole number", c, F.count_if(value % 1 != 0)))
        out.append(("outside the valid range", c, F.count_if((value < low) | (value > high))))
    for c in contract.categories:
        if c in columns:
            out.append(("missing value", c, F.count_if(F.col(c).isNull())))
    for c, value, other, other_value in contract.exactly_when:
        if c in columns and other in columns:
            one = F.coalesce(stripped(c), F.lit("")) == value
            two = F.coalesce(stripped(other), F.lit("")) == other_value
            out.append((f"contradicts {other}", c, F.count_if(one != two)))
    for a, b in contract.zero_together:
        if a in columns and b in columns:
            apart = (number(a) == 0) != (number(b) == 0)
            out.append((f"contradicts {b}", a, F.count_if(apart)))
    if contract.label and contract.label in columns:
        text = F.col(contract.label).cast("string")
        words, digits = text.isin("Yes", "No"), text.isin("0", "1")
        out.append(("missing label", contract.label, F.count_if(text.isNull())))
        mixed = (
            (F.count_if(words) > 0) & (F.count_if(digits) > 0) & (F.count_if(~(words | digits)) == 0)
        )
        out.append(("mixes Yes/No with 0/1", contract.label, F.when(mixed, F.count_if(digits)).otherwise(0)))
    return out


def unexpected_values(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside each column's list: rows, the first few values and how many more.

    Only distinct values are compared; of those, each column's first five are kept by a
    limited rank, which drops the rest before the shuffle.
    """
    columns = [c for c in allowed if c in df.columns]
    narrow = df.select(*[E.col(c).cast("string").alias(c) for c in columns])
    seen = (
        members(narrow, columns)
        .select(F.col("dimension").alias("column"), F.btrim("segment", F.lit(WHITESPACE)).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    listed = named_rows(
        df.sparkSession,
        "column string, value string",
        [(c, v) for c in columns for v in allowed[c]],
    )
    bad = seen.join(listed, ["column", "value"], "left_anti")
    totals = bad.groupBy("column").agg(
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("distinct")
    )
    first = Window.partitionBy("column").orderBy("value")
    head = (
        bad.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= fixed.QUOTED_VALUES)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )
    shown, more = E.quoted("values", "distinct")
    return totals.join(head, "column").select(
        F.lit("unexpected value").alias("check"),
        "column",
        "n",
        shown.alias("examples"),
        more.cast("int").alias("more"),
    )


def problems(
    df: DataFrame, contract: Contract, *, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every problem of a (cleaned, unencoded) table; empty when it keeps the contract."""
    spark = df.sparkSession
    required = list(columns) if columns is not None else contract.columns
    absent = missing_columns(df, required)
    present = [c for c in required if c in df.columns]
    checks = [("no rows", "", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0))]
    checks += count_checks(df, contract, present)
    counted = df.agg(*[count.cast("bigint").alias(f"c{i}") for i, (_, _, count) in enumerate(checks)])
    pairs = F.array(
        *[
            F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n"))
            for i, (check, c, _) in enumerate(checks)
        ]
    )
    none = F.lit(None).cast("array<string>")
    found = (
        counted.select(F.inline(pairs))
        .where(F.col("n") > 0)
        .select("check", "column", "n", none.alias("examples"), F.lit(None).cast("int").alias("more"))
    )
    if absent:
        rows = [("missing column", c, 1, None, None) for c in absent]
        found = found.unionByName(named_rows(spark, PROBLEM, rows))
    lists = {c: v for c, v in contract.categories.items() if c in present}
    if contract.label and contract.label in present:
        lists[contract.label] = tuple(contract.label_codes)
    if lists:
        found = found.unionByName(unexpected_values(df, lists))
    return found


def repeated_keys(df: DataFrame, id: str) -> DataFrame:
    """How many IDs occur more than once, and how many rows are beyond each first."""
    return (
        df.groupBy(id)
        .agg(F.count(F.lit(1)).alias("m"))
        .where(F.col("m") > 1)
        .agg(
            F.count(F.lit(1)).alias("repeated_ids"),
            F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("extra_rows"),
        )
    )


class ContractError(ValueError):
    """Data that may not be used."""


def features_and_target(
    df: DataFrame, columns: Sequence[str], contract: Contract
) -> tuple[DataFrame, DataFrame]:
    """Model inputs and label, both with the ID; refused when an ID repeats, as a repeated row
    could land on both sides of a split."""
    if absent := missing_columns(df, [*columns, contract.id, contract.label]):
        raise ContractError(f"missing columns: {absent}")
    extra = repeated_keys(df, contract.id).first()["extra_rows"]
    if extra:
        raise ContractError(f"{contract.id} repeats in {extra} row(s)")
    return df.select(contract.id, *columns), df.select(contract.id, contract.label)


# --- model inputs -------------------------------------------------------------------------------


def model_input_columns(
    contract: Contract, drop: Sequence[str] = (), optional: Sequence[str] = ()
) -> list[str]:
    """The columns a model reads, in the contract's order: no ID, no label, no dropped ones."""
    out = set(drop) | set(optional) | {contract.id, contract.label}
    return [c for c in contract.columns if c not in out]


def split_types(columns: Sequence[str], contract: Contract) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns; one in neither list is an error."""
    numeric = [c for c in columns if c in contract.numbers]
    categorical = [c for c in columns if c in contract.categories]
    if unknown := sorted(set(columns) - set(numeric) - set(categorical)):
        raise ContractError(f"columns in neither contract: {unknown}")
    return numeric, categorical


def model_inputs(df: DataFrame, columns: Sequence[str], contract: Contract) -> DataFrame:
    """The trained columns as validation read them: text stripped, numbers as doubles.

    A column expression only, so it serves a batch and a stream alike; ``problems`` says
    whether the rows may be scored.
    """
    numeric, categorical = split_types(columns, contract)
    values = {c: number(c) for c in numeric}
    values |= {c: F.btrim(F.col(c).cast("string"), F.lit(WHITESPACE)) for c in categorical}
    return df.withColumns(values)


def ignored_columns(header: Sequence[str], contract: Contract) -> list[str]:
    """Header names the contract does not know."""
    known = set(contract.columns)
    return [c for c in header if c not in known]
