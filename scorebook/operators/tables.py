"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
}


def named_rows(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """A small declared table (levels, bands, cuts): its size is fixed by the caller's code.

    It arrives as one Arrow table, so the optimizer knows its size and decides by it how to join.
    """
    fields = T.StructType.fromDDL(columns).fields
    schema = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in fields])
    values = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(v), type=t.type) for v, t in zip(values, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def beside(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """``df`` with the columns of one-row tables on every row.

    Each part is a scalar subquery: it is computed once and needs no join.  A part without a
    row gives nulls; one with several rows is an error.
    """
    out = df
    for i, part in enumerate(parts):
        row = part.select(F.struct(*[F.col(f"`{c}`") for c in part.columns]).alias("r"))
        out = out.withColumn(f"__part{i}", row.scalar())
    fields = [
        F.col(f"__part{i}").getField(c).alias(c) for i, part in enumerate(parts) for c in part.columns
    ]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *fields)


def row_by(df: DataFrame, order: Column, *, keys: Sequence[str] = (), largest: bool) -> DataFrame:
    """Each key's whole row at the largest (or smallest) ``order``: one aggregate, no sort."""
    pick = F.max_by if largest else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, order).alias("__row")).select("__row.*")
