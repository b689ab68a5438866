"""Predetermined folds that lie in files: one train and one test file a fold.

A file (or a folder of part files) carries its fold and side in its name. All files are one scan: fold and side of
a row come from the path that the scan itself reports, looked up among the names of the files, so a hundred folds are as many tasks and not as many
plans. What is there is compared with what is expected from the listing alone, before a row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of a file without its ending: a fold and a side. The first two groups are taken.
PATTERN = r"fold_?([^/]+?)_(train|test)(?:\.[A-Za-z]+)*(?:/[^/]*)?$"

ROLES = ("train", "test")


def fold_of(path: Column, pattern: str = PATTERN) -> tuple[Column, Column]:
    """Fold and side in a path; null where the name does not say them. Paths are percent-encoded."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    parts = [F.regexp_extract(plain, pattern, i) for i in (1, 2)]
    return tuple(F.when(p != "", p) for p in parts)


def listing(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """fold, role, n_files, n_bytes of the files below the folder, without opening one. Names that say no fold are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    fold, role = fold_of(F.col("path"), pattern)
    named = files.select(fold.alias("fold"), role.alias("role"), "length").where("fold is not null")
    return named.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def missing(spark: SparkSession, folder: str, folds: list[str], pattern: str = PATTERN) -> DataFrame:
    """(fold, role) that are expected and have no file."""
    wanted = spark.createDataFrame([(str(f), r) for f in folds for r in ROLES], "fold string, role string")
    return wanted.join(listing(spark, folder, pattern), ["fold", "role"], "left_anti")


def read_fold_files(
    spark: SparkSession, folder: str, schema: T.StructType, folds: list[str], fmt: str = "csv", pattern: str = PATTERN
) -> DataFrame:
    """The columns of ``schema``, fold and role, for the expected folds; files of other folds are left alone.

    FileNotFoundError names every file that is missing. A CSV file must have the columns of the schema as its header, in
    order, and every row must fit them."""
    lost = [f"{r['fold']}_{r['role']}" for r in missing(spark, folder, folds, pattern).orderBy("fold", "role").collect()]  # at most two a fold
    if lost:
        raise FileNotFoundError(f"no files under {folder} for {', '.join(lost)}")
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    scan = reader.format(fmt).load(folder)
    # a name is taken apart once a file, not once a row
    fold, role = fold_of(F.col("_path"), pattern)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("_path"))
    told = names.select("_path", fold.alias("fold"), role.alias("role")).collect()  # one row a file
    sides: dict[tuple[str, str], list[str]] = {}
    others = []
    for r in told:
        if r["fold"] in {str(f) for f in folds}:
            sides.setdefault((r["fold"], r["role"]), []).append(r["_path"])
        else:
            others.append(r["_path"])
    path = F.col("_metadata.file_path")
    rows = scan.select(*[F.col(f"`{c}`") for c in schema.names], _side(path, sorted(sides.items())).alias("_side"), path.alias("_path"))
    if others:
        rows = rows.where(~F.col("_path").isin(others))  # these are not opened
    rows = rows if sides else rows.where("false")
    return rows.select(*[F.col(f"`{c}`") for c in schema.names], "_side.fold", "_side.role")


def _side(path: Column, sides: list[tuple[tuple[str, str], list[str]]]) -> Column:
    """Fold and side of a path that is one of those listed: halves of the sides are told apart by sets of names."""
    if len(sides) <= 1:
        fold, role = sides[0][0] if sides else (None, None)
        return F.struct(F.lit(fold).cast("string").alias("fold"), F.lit(role).cast("string").alias("role"))
    half = len(sides) // 2
    first = [f for _, files in sides[:half] for f in files]
    return F.when(path.isin(first), _side(path, sides[:half])).otherwise(_side(path, sides[half:]))


def write_fold_files(rows: DataFrame, folder: str, columns: list[str], fmt: str = "csv") -> str:
    """Write rows (columns, fold, role) to one folder of part files for each fold and side, in one job. Rows of a side are spread over
    the tasks that hold them, so a fold of any size is written by many. Names of folds may have letters, digits, spaces and ``_.-``."""
    told = F.when(F.col("fold").rlike(r"^[A-Za-z0-9_. -]+$"), F.col("fold")).otherwise(F.raise_error(F.concat(F.lit("no name for a fold file: "), "fold")))
    name = F.concat(F.lit("fold_"), told, F.lit("_"), "role")
    writer = rows.select(*columns, name.alias("side")).write.partitionBy("side").mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(folder)
    return folder


def fold_vocabularies(rows: DataFrame, element: str) -> DataFrame:
    """(fold, element): one vocabulary a fold, over both of its sides, so that the columns of train and test agree."""
    return rows.where(F.col(element).isNotNull()).select("fold", F.col(element).alias("element")).distinct()
