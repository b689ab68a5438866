"""Artifacts that are joined again and again, stored in buckets of their join keys.

Folds, subsets and predictions of one corpus meet on the same keys in every later step. Written once in buckets of the keys,
sorted inside, they are joined bucket by bucket and nothing is shuffled. The catalog entry is only a name for the files: another
session attaches them by ``attach``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayframe.sources.session import new_table_path

#: Rows that one bucket should hold.
BUCKET_ROWS = 1_000_000


def buckets_for(n_rows: int) -> int:
    """A power of two, so that tables of different sizes can be bucketed alike by taking the larger number."""
    n = 8
    while n * BUCKET_ROWS < n_rows:
        n *= 2
    return n


def write_bucketed(df: DataFrame, keys: list[str], n: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """Store and read back. The rows are put into their buckets by one shuffle, so each bucket is one file."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or new_table_path(spark, name)
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], n: int) -> DataFrame:
    """Name bucketed files that another session has written."""
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)
