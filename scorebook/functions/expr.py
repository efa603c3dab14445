"""Column expressions.  All of them are built-in functions, so they stay in code generation
and work the same on a batch or a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorebook.functions import fixed
from scorebook.functions.fixed import Business

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(cases: Sequence[tuple[Column, Column | object]], otherwise: object = None) -> Column:
    """``CASE WHEN`` over ``(condition, value)`` pairs."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    if otherwise is None:
        return out
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


# --- buckets and bands -------------------------------------------------------------------


def bucket(
    c: ColumnOrName, edges: Sequence[float], labels: Sequence[object], *, right: bool
) -> Column:
    """The label of the interval ``c`` falls in; null outside all of them.

    ``right`` closes intervals on the right, ``(low, high]``; otherwise ``[low, high)``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    x = col(c)
    cases = []
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        cases.append((inside, label))
    return pick(cases)


def tenure_bucket(
    c: ColumnOrName,
    edges: Sequence[float] = fixed.TENURE_EDGES,
    labels: Sequence[str] = fixed.TENURE_LABELS,
) -> Column:
    return bucket(c, edges, labels, right=True)


def charge_band(
    c: ColumnOrName,
    edges: Sequence[float] = fixed.CHARGE_EDGES,
    labels: Sequence[str] = fixed.CHARGE_LABELS,
) -> Column:
    return bucket(c, edges, labels, right=False)


def level_position(c: ColumnOrName, levels: Sequence[str]) -> Column:
    """The 0-based place of a level in its display order; null for an undeclared one."""
    return pick([(col(c) == level, i) for i, level in enumerate(levels)])


def score_band(score: ColumnOrName, bands: Sequence[tuple] = fixed.RISK_BANDS) -> Column:
    p = col(score)
    return pick([((p >= low) & (p < high), name) for name, low, high in bands])


def histogram_bin(score: ColumnOrName, bins: int = fixed.HISTOGRAM_BINS) -> Column:
    """Equal-width bin of a score in [0, 1]; 1 joins the last bin."""
    return F.least(F.lit(bins - 1), F.floor(col(score) * bins).cast("int"))


def grid_value(i: int) -> float:
    """Cut ``i`` of the 0.01 grid, as a product: the quotient differs at some cuts."""
    return i * 0.01


def grid_index(score: ColumnOrName) -> Column:
    """The highest grid cut at or below a score in [0, 1].

    ``floor(p * 100)`` can be one off where a cut is not representable, so the guess is
    compared with the cut itself.
    """
    p = col(score)
    guess = F.floor(p * 100).cast("int")
    step = F.lit(0.01)
    corrected = (
        F.when(guess.cast("double") * step > p, guess - 1)
        .when((guess + 1).cast("double") * step <= p, guess + 1)
        .otherwise(guess)
    )
    return F.least(F.lit(fixed.GRID_CUTS - 1), corrected)


def reliability_edges(bins: int = fixed.RELIABILITY_BINS) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def reliability_bin(score: ColumnOrName, bins: int = fixed.RELIABILITY_BINS) -> Column:
    """Right-closed bin: how many inner edges lie strictly below the score; 0 joins the first."""
    p = col(score)
    inner = reliability_edges(bins)[1:-1]
    total = F.lit(0)
    for edge in inner:
        total = total + (p > F.lit(edge)).cast("int")
    return total


def interval_index(score: ColumnOrName, cuts: Sequence[float]) -> Column:
    """Which of the intervals ``[cut, next cut)`` a score lies in; the last one is open above."""
    p = col(score)
    total = F.lit(-1)
    for cut in cuts:
        total = total + (p >= F.lit(float(cut))).cast("int")
    return total


# --- numbers -----------------------------------------------------------------------------


def clamp_margin(rows: int) -> float:
    """Half an observation of ``rows``."""
    return min(1.0 / (2 * max(int(rows), 1)), 0.49)


def clamp(score: ColumnOrName, rows: int) -> Column:
    """A score clipped into ``[e, 1 - e]`` with ``e`` half an observation of ``rows``."""
    e = clamp_margin(rows)
    return F.greatest(F.least(col(score), F.lit(1.0 - e)), F.lit(e))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """A share as a double, null when there is nothing to divide by."""
    d = col(denominator).cast("double")
    return F.when(d != 0, col(numerator).cast("double") / d)


def ratio_or_zero(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def finite(c: ColumnOrName) -> Column:
    """NaN as null."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def money_sum(c: ColumnOrName) -> Column:
    """A sum of amounts in exact decimals, so it does not depend on the order rows arrive in."""
    return F.sum(col(c).cast("decimal(20,4)")).cast("double")


def two_sided(
    positives: ColumnOrName, negatives: ColumnOrName, minimum: int = fixed.MIN_CELL
) -> Column:
    """An empty group, or one with at least ``minimum`` of each outcome."""
    p, n = col(positives), col(negatives)
    return ((p == 0) & (n == 0)) | ((p >= minimum) & (n >= minimum))


def wilson(
    successes: ColumnOrName, trials: ColumnOrName, z: float = fixed.Z_95
) -> tuple[Column, Column]:
    """The Wilson interval of a proportion: null with no trials, exact 0 or 1 at the ends."""
    k, n = col(successes).cast("double"), col(trials).cast("double")
    share = k / n
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    centre = share + z * z / (2 * n)
    scale = 1 + z * z / n
    low = F.when(n > 0, F.when(k == 0, F.lit(0.0)).otherwise((centre - spread) / scale))
    high = F.when(n > 0, F.when(k == n, F.lit(1.0)).otherwise((centre + spread) / scale))
    return low, high


def f1(precision: ColumnOrName, recall: ColumnOrName) -> Column:
    p, r = col(precision), col(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def customer_value(charges: ColumnOrName, business: Business = Business()) -> Column:
    """Margin a retained customer is assumed to bring over the horizon."""
    return col(charges) * F.lit(business.horizon_months) * F.lit(business.margin)


def return_on_spend(retained: ColumnOrName, cost: ColumnOrName) -> Column:
    return ratio(retained, cost)


# --- text --------------------------------------------------------------------------------


def normal_id(c: ColumnOrName) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def is_sha256(c: ColumnOrName) -> Column:
    return F.coalesce(col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def defuse(c: ColumnOrName) -> Column:
    """Text with every place a spreadsheet would start a formula made inert.

    A piece after ``;``, a tab, a line break or a quote can become a cell of its own, so
    formula characters are defused there too.
    """
    text = col(c)
    inner = F.regexp_replace(text, '(?<=[;\\t\\r\\n"])(?=[=+\\-@])', "'")
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), inner)).otherwise(inner)


def quoted(
    values: ColumnOrName,
    distinct: ColumnOrName,
    *,
    keep: int = fixed.QUOTED_VALUES,
    width: int = fixed.QUOTED_CHARS,
) -> tuple[Column, Column]:
    """At most ``keep`` of the sorted offending values, each cut to ``width`` characters, and
    how many of the ``distinct`` ones were left out."""
    shown = F.slice(col(values), 1, keep)
    cut = F.transform(
        shown,
        lambda v: F.when(F.length(v) > width, F.concat(F.substring(v, 1, width), F.lit("…"))).otherwise(v),
    )
    return cut, col(distinct) - F.size(shown)


def label_of(c: ColumnOrName, labels: Mapping[str, str]) -> Column:
    """A column's display label; the name itself where there is none."""
    if not labels:
        return col(c)
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), col(c))


def category_code(c: ColumnOrName, vocabulary: Sequence[str]) -> Column:
    """A category's 0-based place in its vocabulary; null when it is not in it."""
    words = F.array(*[F.lit(v) for v in vocabulary])
    place = F.array_position(words, col(c).cast("string"))
    return F.when(place > 0, place.cast("int") - 1)


def category_of(code: ColumnOrName, vocabulary: Sequence[str]) -> Column:
    words = F.array(*[F.lit(v) for v in vocabulary])
    place = col(code).cast("int")
    return F.when((place >= 0) & (place < len(vocabulary)), F.try_element_at(words, place + 1))


def shown_value(
    feature: ColumnOrName,
    value: ColumnOrName,
    *,
    months: Sequence[str] = (),
    money: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> Column:
    """A feature's value as a reader sees it, by the feature's unit."""
    name, text = col(feature), col(value).cast("string")
    number = text.try_cast("double")
    return pick(
        [
            (name.isin(list(months)), F.format_string("%.0f months", number)),
            (name.isin(list(money)), F.concat(F.lit("$"), F.format_number(number, 2))),
            (name.isin(list(flags)), F.when(text == "1", "yes").otherwise("no")),
        ],
        text,
    )


def sentence(label: ColumnOrName, value: ColumnOrName, contribution: ColumnOrName) -> Column:
    """One contribution in words: an association with the model's output, never a cause."""
    c = col(contribution)
    return F.concat(
        col(label),
        F.lit(" ("),
        col(value),
        F.when(c > 0, F.lit(fixed.RAISES)).otherwise(F.lit(fixed.LOWERS)),
        F.format_string(fixed.RISK_SENTENCE, F.abs(c * 100.0)),
    )
