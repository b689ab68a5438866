"""Table scans and sinks: corpora, fold artifacts, split exports, run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Scan with an explicit schema (never inferred for text) and only the named columns."""
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_complete(spark: SparkSession, path: str, columns: list[str], **kw) -> DataFrame:
    """Projected scan without the rows missing any of its columns."""
    return read_table(spark, path, columns=columns, **kw).dropna()


def has_columns(df: DataFrame, *names: str) -> bool:
    """Schema probe: metadata only."""
    return set(names) <= set(df.columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> str:
    """Table sink. Partitioned writes replace only the partitions they contain, so a
    unit can be redone after a failure without touching the others."""
    w = df.write.format(fmt).mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.save(path)
    return path


def write_folds(long_folds: DataFrame, path: str) -> str:
    """Fold artifact: split, fold, role, row_id[, key], one directory per split."""
    return write_table(long_folds, path, by=["split"])


def read_folds(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Fold artifact; a split list prunes the other directories."""
    df = spark.read.parquet(path)
    return df if splits is None else df.where(F.col("split").isin(*splits))


def export_parts(parts: DataFrame, path: str, formula: str, target: str, row_id: str = "row_id") -> str:
    """formula, target (single precision), material_id per part, one directory per part."""
    out = parts.select(
        F.col(formula).alias("formula"), F.col(target).cast("float").alias("target"), F.col(row_id).alias("material_id"), "part"
    )
    return write_table(out, path, by=["part"])


def flatten_history(df: DataFrame, keys: list[str], true: str, pred: str, optional: dict[str, str] | None = None) -> DataFrame:
    """Nested run history to one row per prediction: keys, pos, y_true, y_pred and each
    optional array (output name -> column) whose length matches, NULL where it does not.
    Runs lacking either array give no rows."""
    optional = optional or {}
    n = F.size(true)
    fits = {k: F.when(F.size(c) == n, F.col(c)) for k, c in optional.items()}
    flat = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull() & (n > 0)).select(
        *keys,
        F.posexplode(
            F.arrays_zip(
                F.col(true).alias("y_true"), F.col(pred).alias("y_pred"),
                *[F.coalesce(a, F.array_repeat(F.lit(None).cast(df.schema[optional[k]].dataType.elementType), n)).alias(k) for k, a in fits.items()],
            )
        ).alias("pos", "_r"),
    )
    return flat.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.col("_r.y_true").cast("double").alias("y_true"),
        F.col("_r.y_pred").cast("double").alias("y_pred"), *[F.col(f"_r.{k}") for k in fits],
    )


def union_folds(folds: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Predetermined folds (train, test) as one table with fold and role, train first,
    so that each fold's vocabulary can be taken over both sides."""
    out = None
    for name, pair in folds.items():
        if len(pair) != 2 or any(p is None for p in pair):
            raise FileNotFoundError(f"fold {name!r} needs a train and a test table")
        for role, df in zip(("train", "test"), pair):
            part = df.withColumn("fold", F.lit(name)).withColumn("role", F.lit(role))
            out = part if out is None else out.unionByName(part)
    return out
