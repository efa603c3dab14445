"""Working with a scored book: outcomes, status, filters, listings, exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions import expr as E
from scorebook.functions import fixed
from scorebook.functions.fixed import MIN_CELL, SHOWN_PARTITIONS
from scorebook.operators.prefix import positions


@dataclass(frozen=True)
class Columns:
    """The names a book's columns go by."""

    id: str = "customer_id"
    label: str = "churn"
    score: str = "score"
    amount: str = "monthly_charges"
    tenure: str = "tenure"
    partition: str = "partition_name"
    band: str = "risk_band"


DEFAULT = Columns()


# --- assembly ----------------------------------------------------------------------------


def assemble(
    scored: DataFrame, split: DataFrame | None, outcomes: DataFrame, c: Columns = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """The book without its outcome, and the outcomes that may be shown, as two tables.

    ``split`` is (id, partition); rows it does not name, or all of them without a split, are
    ``unknown``.  The outcomes table never holds a row outside the shown partitions.
    """
    if split is None:
        book = scored.withColumn(c.partition, F.lit("unknown"))
    else:
        book = scored.join(split.select(c.id, c.partition), c.id, "left").fillna(
            "unknown", subset=[c.partition]
        )
    shown = book.where(F.col(c.partition).isin(*SHOWN_PARTITIONS)).select(c.id)
    return book, outcomes.select(c.id, c.label).join(shown, c.id, "left_semi")


def synthetic_book(scored: DataFrame, c: Columns = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """A book of rows with no outcome at all: one partition, and an empty outcomes table."""
    if c.label in scored.columns:
        raise ValueError("rows without an outcome must not carry a label column")
    book = scored.withColumn(c.partition, F.lit(fixed.SYNTHETIC))
    return book, book.select(c.id, F.lit(None).cast("int").alias(c.label)).where(F.lit(False))


def training_rows(book: DataFrame, columns: Sequence[str], c: Columns = DEFAULT) -> DataFrame:
    """The training partition's inputs."""
    return book.where(F.col(c.partition) == "train").select(c.id, *columns)


def labelled(
    book: DataFrame,
    outcomes: DataFrame,
    *partitions: str,
    c: Columns = DEFAULT,
    strict: bool = False,
) -> DataFrame:
    """The book's rows joined with their outcomes, for partitions whose outcomes may be seen.

    ``strict`` runs a job first that looks for rows the outcomes table leaves out.
    """
    rows = _visible(book, partitions, c)
    if strict and (stray := unlabelled_rows(book, outcomes, *partitions, c=c).select(c.id).head()):
        raise KeyError(f"{c.id} {stray[0]!r} is in the book and not in the outcomes")
    return rows.join(outcomes.select(c.id, c.label), c.id, "inner")


def _visible(book: DataFrame, partitions: tuple[str, ...], c: Columns) -> DataFrame:
    if secret := sorted(set(partitions).difference(SHOWN_PARTITIONS)):
        raise ValueError(f"partition {', '.join(secret)} keeps its outcomes to itself")
    return book.where(F.col(c.partition).isin(*(partitions or SHOWN_PARTITIONS)))


def unlabelled_rows(
    book: DataFrame, outcomes: DataFrame, *partitions: str, c: Columns = DEFAULT
) -> DataFrame:
    """Shown rows that have no outcome: none, unless the two tables do not belong together."""
    return _visible(book, partitions, c).join(outcomes.select(c.id), c.id, "left_anti")


def with_outcomes(book: DataFrame, outcomes: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """``book`` plus outcome, status and value at risk.

    A row is withheld unless the outcomes table carries it, so an unknown row never reads as
    a class.  Value at risk exists for rows known to be active only.
    """
    y = F.col(c.label)
    code = F.when(y == 1, "churned").when(y == 0, "stayed").otherwise("withheld")
    status = (
        F.when(F.col(c.partition) == fixed.SYNTHETIC, "active")
        .when(F.col("outcome") == "stayed", "active")
        .when(F.col("outcome") == "churned", "churned")
        .otherwise("unknown")
    )
    at_risk = F.when(F.col("status") == "active", F.col(c.score) * F.col(c.amount))
    return (
        book.join(outcomes.select(c.id, c.label), c.id, "left")
        .withColumn("outcome", code)
        .withColumn("status", status)
        .withColumn("at_risk", at_risk)
        .drop(c.label)
    )


def flag(book: DataFrame, threshold: float, c: Columns = DEFAULT) -> DataFrame:
    """``book`` with its band and the decision at ``threshold``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [0, 1], got {threshold!r}")
    return book.withColumns(
        {c.band: E.score_band(c.score), "flagged": F.col(c.score) >= F.lit(float(threshold))}
    )


# --- filters -----------------------------------------------------------------------------


@dataclass(frozen=True)
class BookFilter:
    """What a listing narrows the book to; ``None`` means any."""

    query: str = ""
    bands: tuple[str, ...] | None = None
    equals: tuple[tuple[str, object], ...] = ()
    partition: str | None = None
    tenure_min: float | None = None
    tenure_max: float | None = None
    flagged: bool | None = None
    ids: tuple | None = None
    exclude_churned: bool = False

    def __post_init__(self) -> None:
        if self.ids is not None and replace(self, ids=None) != BookFilter():
            raise ValueError("ids name the rows by themselves; leave the other filters empty")
        if None not in (self.tenure_min, self.tenure_max) and self.tenure_min > self.tenure_max:
            raise ValueError(f"no tenure lies between {self.tenure_min} and {self.tenure_max}")


def condition(f: BookFilter, c: Columns = DEFAULT) -> Column:
    """``f`` as one predicate; the parts on stored columns reach the scan."""
    parts = []
    if f.query:
        text = F.upper(F.col(c.id).cast("string"))
        parts.append(F.contains(text, F.lit(f.query.upper())))
    if f.bands is not None:
        parts.append(F.col(c.band).isin(*f.bands))
    parts += [F.col(name) == value for name, value in f.equals]
    if f.partition is not None:
        parts.append(F.col(c.partition) == f.partition)
    if f.tenure_min is not None:
        parts.append(F.col(c.tenure) >= f.tenure_min)
    if f.tenure_max is not None:
        parts.append(F.col(c.tenure) <= f.tenure_max)
    if f.flagged is not None:
        parts.append(F.col("flagged") == f.flagged)
    if f.ids is not None:
        parts.append(F.col(c.id).isin(*f.ids))
    if f.exclude_churned:
        parts.append(F.col("outcome") != "churned")
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def select_rows(book: DataFrame, f: BookFilter, c: Columns = DEFAULT) -> DataFrame:
    return book.where(condition(f, c))


def explore(
    book: DataFrame,
    choices: dict[str, Sequence[str]],
    *,
    score: tuple[float, float] = (0.0, 1.0),
    tenure: tuple[float, float] | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """Several values per column, and closed score and tenure ranges; an empty choice is any."""
    keep = F.col(c.score).between(*score)
    for name, values in choices.items():
        if values:
            keep = keep & F.col(name).cast("string").isin(*values)
    if tenure is not None:
        keep = keep & F.col(c.tenure).between(*tenure)
    return book.where(keep)


def by_id(book: DataFrame, value: object, c: Columns = DEFAULT) -> DataFrame:
    return book.where(F.col(c.id) == F.lit(value))


# --- held-out and shared rows ----------------------------------------------------------------


def held_out_rows(
    uploaded: DataFrame, held: DataFrame, inputs: Sequence[str], *, row: str, id: str = "customer_id"
) -> DataFrame:
    """The ``row`` numbers of uploaded rows that are held-out ones, by ID or by every input.

    An ``OR`` of two equalities would compare every pair; two semi joins do not.  The inputs
    join on one 64-bit hash first, which also spreads tuples that share leading columns, and
    then on the values themselves.
    """
    parts = []
    if id in uploaded.columns:
        ids = held.select(E.normal_id(id).alias("__id")).distinct()
        parts.append(
            uploaded.select(row, E.normal_id(id).alias("__id"))
            .join(ids, "__id", "left_semi")
            .select(row)
        )
    parts.append(rows_with_inputs_of(uploaded, held, inputs).select(row))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def rows_with_inputs_of(left: DataFrame, right: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose inputs all equal some row's of ``right``; nulls equal nulls."""
    keyed = left.withColumn("__h", F.xxhash64(*inputs))
    other = right.select(*[F.col(c).alias(f"__{c}") for c in inputs]).distinct()
    other = other.withColumn("__g", F.xxhash64(*[f"__{c}" for c in inputs]))
    same = F.col("__h") == F.col("__g")
    for c in inputs:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return keyed.join(other, same, "left_semi").drop("__h")


def shared_count(left: DataFrame, right: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """How many rows of ``left`` repeat a row of ``right`` in every input."""
    return rows_with_inputs_of(left, right, inputs).agg(F.count(F.lit(1)).alias("shared"))


# --- counts and summaries ------------------------------------------------------------------


def observed(n: Column, churned: Column, minimum: int = MIN_CELL) -> tuple[Column, Column]:
    """Churned and rate, both null below ``minimum`` rows."""
    enough = n >= minimum
    return F.when(enough, churned), F.when(enough, E.ratio(churned, n))


def band_counts(
    book: DataFrame, f: BookFilter, names: Sequence[str], c: Columns = DEFAULT
) -> DataFrame:
    """Rows per band whichever bands ``f`` asks for; every band is named."""
    kept = select_rows(book, replace(f, bands=None), c)
    return counts_of(kept, c.band, names)


def status_counts(selection: DataFrame) -> DataFrame:
    return counts_of(selection, "status", ("active", "churned", "unknown"))


def counts_of(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows per named value in one aggregate, zeros kept."""
    counted = df.agg(*[F.count_if(F.col(column) == name).alias(name) for name in names])
    pairs = F.array(
        *[F.struct(F.lit(n).alias(column), F.col(f"`{n}`").alias("customers")) for n in names]
    )
    return counted.select(F.inline(pairs))


def summarise(
    selection: DataFrame, outcomes: DataFrame, book_size: int, c: Columns = DEFAULT
) -> DataFrame:
    """One row over a filtered book; outcomes from its shown rows only."""
    bins = fixed.HISTOGRAM_BINS
    seen = selection.join(
        outcomes.select(c.id, F.col(c.label).alias("__y")), c.id, "left"
    ).withColumn("__bin", E.histogram_bin(c.score))
    totals = seen.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if("flagged").alias("flagged"),
        F.avg(c.score).alias("mean_probability"),
        F.coalesce(F.sum(c.score), F.lit(0.0)).alias("expected_churners"),
        F.count("__y").alias("observed_customers"),
        F.sum("__y").cast("bigint").alias("__churned"),
        F.coalesce(E.money_sum(c.amount), F.lit(0.0)).alias("monthly_charges"),
        F.coalesce(
            E.money_sum(F.when(F.col("status") == "active", F.col(c.amount))), F.lit(0.0)
        ).alias("active_monthly_charges"),
        F.coalesce(F.sum("at_risk"), F.lit(0.0)).alias("at_risk"),
        F.array(*[F.count_if(F.col("__bin") == i) for i in range(bins)]).alias("histogram"),
    )
    churned, rate = observed(F.col("observed_customers"), F.col("__churned"))
    return totals.select(
        "customers",
        E.ratio("customers", F.lit(book_size)).alias("share_of_book"),
        "flagged",
        E.ratio("flagged", "customers").alias("flagged_share"),
        "mean_probability",
        "expected_churners",
        "observed_customers",
        churned.alias("observed_churned"),
        rate.alias("observed_rate"),
        "monthly_charges",
        "active_monthly_charges",
        "at_risk",
        "histogram",
    )


def batch_summary(scored: DataFrame, names: Sequence[str], c: Columns = DEFAULT) -> DataFrame:
    """One row over a scored file, with a count for every band."""
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("flagged").alias("flagged"),
        E.ratio(F.count_if("flagged"), F.count(F.lit(1))).alias("flagged_share"),
        F.avg(c.score).alias("mean_probability"),
        F.coalesce(F.sum(c.score), F.lit(0.0)).alias("expected_churners"),
        F.coalesce(F.sum(F.col(c.score) * F.col(c.amount)), F.lit(0.0)).alias("at_risk"),
        *[F.count_if(F.col(c.band) == n).alias(f"band_{n.lower()}") for n in names],
    )


UNDEFINED_RATES = {
    "too few": "Fewer than {minimum} rows carry a label.",
    "neither": "Among the labelled rows nobody is flagged and nobody left: both rates lack a base.",
    "precision": "Among the labelled rows nobody is flagged: precision lacks a base.",
    "recall": "Among the labelled rows nobody left: recall lacks a base.",
}


def label_check(
    scored: DataFrame, held_out: Column, c: Columns = DEFAULT, minimum: int = MIN_CELL
) -> DataFrame:
    """Precision and recall on a file's own labels, held-out rows left out of both."""
    y, f = F.col(c.label), F.col("flagged")
    counted = scored.withColumn("__held", held_out).agg(
        F.count_if(~F.col("__held")).alias("labelled"),
        F.count_if("__held").alias("excluded_test"),
        F.count_if(~F.col("__held") & f & (y == 1)).alias("tp"),
        F.count_if(~F.col("__held") & f & (y == 0)).alias("fp"),
        F.count_if(~F.col("__held") & ~f & (y == 1)).alias("fn"),
    )
    enough = F.col("labelled") >= minimum
    flagged, churned = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    reason = (
        F.when(~enough, UNDEFINED_RATES["too few"].format(minimum=minimum))
        .when((flagged == 0) & (churned == 0), UNDEFINED_RATES["neither"])
        .when(flagged == 0, UNDEFINED_RATES["precision"])
        .when(churned == 0, UNDEFINED_RATES["recall"])
    )
    return counted.select(
        "labelled",
        "excluded_test",
        F.when(enough, E.ratio("tp", flagged)).alias("precision"),
        F.when(enough, E.ratio("tp", churned)).alias("recall"),
        reason.alias("reason"),
    )


# --- order, pages, projections -----------------------------------------------------------------


def order_of(sort: str, descending: bool, id: str) -> list[Column]:
    """A sort column, nulls last either way, ties by ID ascending."""
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return [key] if sort == id else [key, F.col(id).asc()]


def ordered(book: DataFrame, sort: str, descending: bool, c: Columns = DEFAULT) -> DataFrame:
    """The whole selection in order: a distributed range sort."""
    return book.orderBy(*order_of(sort, descending, c.id))


def page_of(
    selection: DataFrame,
    *,
    sort: str,
    descending: bool,
    page: int,
    page_size: int,
    c: Columns = DEFAULT,
) -> DataFrame:
    """One page with its ``position``, ``page``, ``pages`` and ``total``.

    A page past the end becomes the last one.  Pages are read by position from a
    range-partitioned order, so none passes the rows before it through one task.
    """
    order = order_of(sort, descending, c.id)
    total = selection.count()
    pages = max(1, -(-total // page_size))
    at = min(page, pages)
    first, last = (at - 1) * page_size, at * page_size
    keys = selection.select(*dict.fromkeys([sort, c.id]))
    numbered = positions(keys, order)
    chosen = numbered.where((F.col("position") > first) & (F.col("position") <= last))
    return (
        selection.join(chosen.select(c.id, "position"), c.id)
        .withColumn("page", F.lit(at))
        .withColumn("pages", F.lit(pages).cast("bigint"))
        .withColumn("total", F.lit(total).cast("bigint"))
    )


def arrange(
    scored: DataFrame, *, flagged_only: bool, sort: str, descending: bool, row: str = "row"
) -> DataFrame:
    """A scored file's rows in order; ties keep the file's order whichever way it runs."""
    kept = scored.where("flagged") if flagged_only else scored
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return kept.orderBy(key, F.col(row).asc())


def head(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of a ranking."""
    return df.orderBy(*order).limit(k)


def export_rows(selection: DataFrame, features: Sequence[str], c: Columns = DEFAULT) -> DataFrame:
    """Identity, the model's inputs, its outputs, the outcome as it may be shown."""
    tail = [c.score, c.band, "flagged", c.partition, "outcome", "status"]
    return selection.select(*dict.fromkeys([c.id, *features, *tail]))


def explorer_table(selection: DataFrame, columns: Sequence[str], c: Columns = DEFAULT) -> DataFrame:
    """The explorer's own columns only, riskiest first."""
    return selection.select(*columns).orderBy(F.col(c.score).desc(), F.col(c.id).asc())


def contact_list(
    book: DataFrame, threshold: float, columns: Sequence[str], c: Columns = DEFAULT
) -> DataFrame:
    """Everyone at or above ``threshold``; reads scores and never an outcome."""
    return (
        book.where(F.col(c.score) >= F.lit(float(threshold)))
        .select(*columns)
        .orderBy(F.col(c.score).desc(), F.col(c.id).asc())
    )


def example_rows(
    book: DataFrame, cases: Sequence[tuple[str, bool]], c: Columns = DEFAULT
) -> DataFrame:
    """One row per (band, flagged) case: the lower median by score, ties by ID.

    A group may hold most of the book, so the rows are numbered by a range-partitioned order
    and not by a window per group.
    """
    wanted = F.lit(False)
    for band, flagged in cases:
        wanted = wanted | ((F.col(c.band) == band) & (F.col("flagged") == flagged))
    rows = book.where(F.col(c.partition).isin("validation", fixed.SYNTHETIC) & wanted)
    keys = [c.band, "flagged"]
    numbered = positions(
        rows.select(*keys, c.score, c.id), [F.col(c.score), F.col(c.id)], keys=keys
    )
    sizes = numbered.groupBy(*keys).agg(F.max("position").alias("__n"))
    middle = F.floor((F.col("__n") - 1) / 2) + 1
    return (
        numbered.join(sizes, keys).where(F.col("position") == middle).select(*keys, c.id, c.score)
    )
