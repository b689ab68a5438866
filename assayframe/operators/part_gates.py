"""Drift gates that read only what has changed.

Row digests add up, so the fingerprint of a table is the sum of those of its files. A manifest keeps one row a file, with the size
and time of change that its digest belongs to; a new run lists the files, reads those that are new or changed, and takes the rest
from the manifest. A file that is rewritten with the same size within the clock's resolution is not noticed; ``trust=False``
reads everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.draws import hash_int
from assayframe.operators.gates import canonical_row
from assayframe.sources.artifacts import exists
from assayframe.sources.session import settle

FILE = ["path", "size", "modified"]
DIGEST = ["rows", "digest_sum", "digest_xor"]


def files(spark: SparkSession, folder: str, suffix: str = "*.parquet") -> DataFrame:
    """path, size, modified (microseconds) of the files below a folder; nothing is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder)
    return found.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def digests(spark: SparkSession, paths: list[str], schema, fmt: str = "parquet") -> DataFrame:
    """path, rows, digest_sum, digest_xor of each file."""
    rows = spark.read.schema(schema).format(fmt).load(paths)
    # the scan names a file as a URI, the listing as the store does
    plain = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    # digests are of the table's columns, so the text of a row is made before its path joins it
    h = F.md5(canonical_row(rows))
    t = rows.select(plain.alias("path"), hash_int(h).alias("_a"), hash_int(F.substring(h, 9, 8)).alias("_b"))
    return t.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_a").cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor("_b").alias("digest_xor")
    )


def refresh(spark: SparkSession, folder: str, manifest: str, schema, fmt: str = "parquet", trust: bool = True) -> tuple[DataFrame, list[str]]:
    """Bring the manifest of a folder up to date as a new version below ``manifest``; gives it and the files that were read."""
    versions = 0
    now = files(spark, folder, f"*.{fmt}")
    known = None
    if exists(spark, manifest):
        held = spark.read.parquet(manifest)
        versions = held.agg(F.max("version")).first()[0] or 0
        known = held.where(F.col("version") == versions).drop("version") if trust else None
    now = settle(now, "files")
    stale = now if known is None else now.join(known, FILE, "left_anti")
    read = sorted(r["path"] for r in stale.select("path").collect())  # names, as every listing has them
    kept = now.where("false").selectExpr(*FILE, "0L AS rows", "'' AS digest_sum", "0L AS digest_xor") if known is None else known.join(now, FILE, "left_semi").select(*FILE, *DIGEST)
    if read:
        # a file without rows has no group
        new = stale.join(digests(spark, read, schema, fmt), "path", "left").select(
            *FILE, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest_sum", F.lit("0")).alias("digest_sum"), F.coalesce("digest_xor", F.lit(0)).alias("digest_xor")
        )
        kept = kept.unionByName(new)
    path = f"{manifest}/version={versions + 1}"
    kept.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path), read


def total(manifest: DataFrame) -> DataFrame:
    """(rows, digest_sum, digest_xor) of the whole table, as ``gates.fingerprint`` gives them."""
    return manifest.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("digest_sum").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("digest_xor"), F.lit(0)).alias("digest_xor"),
    )
