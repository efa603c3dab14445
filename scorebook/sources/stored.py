"""A book stored once: cut into buckets by ID and sorted, so lookups and joins by ID move none of it.

The rows lie in ``buckets`` files, each with the IDs of one hash bucket in order; what they are
bucketed by is written beside them as one JSON row, which makes the book readable again in any
session.  A join by the ID shuffles only the other side, to the same buckets, and neither sorts nor
moves the book; two stored books with the same number of buckets join without any shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "id string, buckets int, columns string"


@dataclass(frozen=True)
class StoredBook:
    """Where a book lies and what it is bucketed by."""

    path: str
    id: str
    buckets: int
    columns: str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions here: joins need no further ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_book(df: DataFrame, path: str, *, id: str, buckets: int | None = None) -> StoredBook:
    """Write ``df`` to ``path``, bucketed and sorted by ``id``; an existing book there is an error."""
    spark = df.sparkSession
    n = buckets or bucket_count(spark)
    name = f"book_{uuid.uuid4().hex}"
    # One task per bucket, by the hash that buckets go by, so each bucket is one file.
    rows = df.repartition(n, F.col(quoted(id))).sortWithinPartitions(F.col(quoted(id)))
    rows.write.bucketBy(n, id).sortBy(id).option("path", f"{path}/rows").mode("errorifexists").saveAsTable(name)
    columns = spark.table(name).schema.toDDL()
    spark.sql(f"DROP TABLE {name}")
    book = StoredBook(path, id, n, columns)
    spark.createDataFrame([(book.id, n, columns)], META).coalesce(1).write.json(f"{path}/meta")
    return book


def stored_book(spark: SparkSession, path: str) -> StoredBook:
    """The book at ``path`` as it was stored, whoever stored it."""
    row = spark.read.schema(META).option("mode", "FAILFAST").json(f"{path}/meta").first()
    return StoredBook(path, row["id"], row["buckets"], row["columns"])


def read_book(spark: SparkSession, book: StoredBook) -> DataFrame:
    """The rows of a stored book, known to Spark as bucketed and sorted."""
    name = f"book_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({book.columns}) USING parquet CLUSTERED BY ({quoted(book.id)}) "
        f"SORTED BY ({quoted(book.id)}) INTO {book.buckets} BUCKETS LOCATION '{book.path}/rows'"
    )
    return spark.table(name)


def looked_up(book: DataFrame, ids: DataFrame, *, id: str, found: str = "found") -> DataFrame:
    """Every asked ID with the book's row, or nulls and ``found`` false; repeats are kept, an ID
    that is missing is not found."""
    asked = ids.select(F.col(quoted(id)).alias("__asked"))
    rows = book.withColumn(found, F.lit(True))
    joined = asked.join(rows, F.col("__asked") == F.col(quoted(id)), "left")
    rest = [c for c in book.columns if c != id]
    return joined.select(
        F.col("__asked").alias(id), *[F.col(quoted(c)) for c in rest], F.coalesce(found, F.lit(False)).alias(found)
    )
