"""What the operators of this package share: splits by hash, stored tables, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.session import scratch_path

#: Characters of text that a worker holds as strings at once.
CHARS_AT_ONCE = 1 << 23


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark, wherever the folder lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the ID written as text, modulo ``modulus``; null without an ID."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept out of learning; a row without an ID is neither held out nor learned."""
    return F.coalesce(bucket(doc_id, modulus) == remainder, F.lit(False))


def learnable(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(bucket(doc_id, modulus) != remainder, F.lit(False))


def labelled_ids(
    labels: DataFrame, label: str, *, per_class: int, doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2
) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` learnable rows of each class.

    The rows with the smallest hash of their ID are taken, so the sample does not depend on how
    the table is laid out.  A document labelled twice has the larger label; null labels are
    left out.
    """
    known = (
        labels.where(learnable(F.col(doc_id), modulus, remainder) & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("__order", F.xxhash64("doc_id", F.lit(17)))
    )
    parts = [known.where(F.col("label") == k).orderBy("__order", "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("__order")


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths add up to at most ``most`` (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield start, len(lengths)


def without(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without columns that have the name of one to be added, in whatever case: a result
    takes the place of such a column."""
    clashing = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clashing])


def by_text(
    docs: DataFrame,
    text: str,
    added: Sequence[tuple[str, T.DataType, pa.DataType]],
    task: Callable[[], Callable[[list[str]], Sequence]],
    *,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with columns computed from whole texts, in Arrow batches.

    ``task`` is called once in each task and gives the function that turns a list of texts (null
    as empty, about ``CHARS_AT_ONCE`` characters of them) into one list per added column.  The other columns are passed on as they are, so
    nulls and large numbers stay what they were.
    """
    docs = without(docs, *[name for name, _, _ in added])
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, t) for n, t, _ in added]])
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = task()
        for whole in batches:
            lengths = pc.utf8_length(whole.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(lengths, CHARS_AT_ONCE):
                batch = whole.slice(lo, hi - lo)
                texts = ["" if t is None else t for t in batch.column(place).to_pylist()]
                new = [pa.array(v, type=a) for v, (_, _, a) in zip(compute(texts), added, strict=True)]
                own = [batch.column(names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[*kept, *[n for n, _, _ in added]])

    return docs.mapInArrow(run, schema)
