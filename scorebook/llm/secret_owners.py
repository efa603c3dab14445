"""Secret scans with corpus-wide ownership.

A text is scanned for three kinds of credentials and for other long mixed tokens.  Every candidate
is counted by its hash over the whole corpus: how many owners have it, in how many of their
repositories.  What many owners have is a copied example; what few owners have looks live.  The
three kinds are reported in any case, the other tokens only when they look live.

A null text counts as empty.  A null owner is one owner of its own, and so is a null repository.
Repeated rows are scanned row by row and count once as a repository.  Other columns pass through;
``spans`` takes the place of a column with its name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import by_text, stored, without

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
OTHER = re.compile(r"[A-Za-z0-9_+/=-]{24,}")
#: Fewest bits per character of another token.
ENTROPY = 3.5

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("hash", T.LongType()),
        ]
    )
)


ARROW_FOUND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())])
)


def bits(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def mixed(value: str) -> bool:
    """Whether a token looks drawn at random: three digits, both cases, enough bits."""
    return (
        sum(c.isdigit() for c in value) >= 3
        and any(c.isupper() for c in value)
        and any(c.islower() for c in value)
        and bits(value) >= ENTROPY
    )


def hashed(secret: str) -> int:
    return int.from_bytes(hashlib.blake2b(secret.encode(), digest_size=8).digest(), "big", signed=True)


def candidates(text: str) -> list[dict]:
    """All candidates of a text with offsets in code points, by start and kind.

    Of each kind matches are leftmost and do not overlap.  A run of hex digits is maximal, so
    asking for 32 at once finds what dropping shorter runs would leave.
    """
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = [(start, end) for start, _, end, _ in found]
    for m in OTHER.finditer(text):
        if mixed(m[0]) and not any(start < m.end() and m.start() < end for start, end in base):
            found.append((m.start(), 3, m.end(), m[0]))
    return [{"kind": KINDS[k], "start": s, "end": e, "hash": hashed(v)} for s, k, e, v in sorted(found)]


def scanned(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``, the candidates of each whole text."""
    added = [("spans", FOUND, ARROW_FOUND)]
    return by_text(without(docs, "__row"), text, added, lambda: lambda texts: ([candidates(t) for t in texts],), keep_text=keep_text)


def ownership(found: DataFrame, *, owner: str, repository: str) -> DataFrame:
    """(hash, owners, repositories) of every candidate; a repository is named within its owner.

    Two partial sums come before the counts, so a candidate that a third of all rows have is a
    few rows per owner by the time it is shuffled by hash.
    """
    return (
        found.select(F.col(f"`{owner}`").alias("o"), F.col(f"`{repository}`").alias("r"), F.explode("spans.hash").alias("hash"))
        .distinct()
        .groupBy("hash", "o")
        .agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )


def judged(
    docs: DataFrame,
    *,
    owner: str,
    repository: str,
    text: str = "text",
    keep_text: bool = True,
    example_owners: int = 3,
) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end, owners, repositories and ``live``, by start and
    kind.  A candidate that ``example_owners`` owners or more have is an example, not live.

    Rows without a candidate never meet the join; the others are brought together again by a row
    number given when the scan was written.
    """
    found = stored(
        scanned(docs, text=text, keep_text=keep_text).withColumn("__row", F.monotonically_increasing_id()), "secret-scan"
    )
    some = found.where(F.size("spans") > 0)
    counts = ownership(some, owner=owner, repository=repository)
    each = some.select("__row", F.explode("spans").alias("s")).select("__row", "s.*")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    row = F.struct(
        "start", rank.alias("rank"), "kind", "end", "owners", "repositories", (F.col("owners") < example_owners).alias("live")
    )
    spans = (
        each.join(counts, "hash")
        .where((F.col("kind") != KINDS[3]) | (F.col("owners") < example_owners))
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list(row)).alias("judged"))
    )
    verdicts = F.transform(
        "judged",
        lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "start", "end", "owners", "repositories", "live")]),
    )
    columns = [F.col(f"`{c}`") for c in found.columns if c not in ("spans", "__row")]
    empty = F.array().cast(
        "array<struct<kind:string,start:int,end:int,owners:bigint,repositories:bigint,live:boolean>>"
    )
    with_spans = some.join(spans, "__row", "left").select(*columns, F.coalesce(verdicts, empty).alias("spans"))
    return found.where(F.size("spans") == 0).select(*columns, empty.alias("spans")).unionByName(with_spans)


def redacted(found: DataFrame, *, text: str = "text") -> DataFrame:
    """``found`` with every span of the text replaced by ``[SECRET:kind]``, or by
    ``[EXAMPLE:kind]`` where it is not live; overlapping spans become the first of them."""
    columns = [c for c in found.columns if c != "spans"]
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(names.index(c)).to_pylist() for c in (text, "spans"))
            new = pa.array([None if t is None else covered(t, s) for t, s in zip(texts, spans, strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(names.index(c)) for c in columns], names=columns)

    schema = T.StructType([found.schema[c] for c in columns])
    plain = found.where(F.size("spans") == 0).select(*[F.col(f"`{c}`") for c in columns])
    return plain.unionByName(found.where(F.size("spans") > 0).mapInArrow(run, schema))


def covered(text: str, spans: list) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{'SECRET' if s['live'] else 'EXAMPLE'}:{s['kind']}]"]
        at = s["end"]
    return "".join(out) + text[at:]
