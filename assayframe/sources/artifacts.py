"""Artifacts that are more than one table: JSON records with a schema, and a ledger of units of work.

A ledger makes a costly run resumable. Each unit is written to a place of its own and counts from the moment its one row
in the table of done units is committed; a unit that was stopped half-way has no such row, and its files are never
read. Publishing swaps one small file that names the places of all units, so a reader sees the old
result or the new one, and never a part of either.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """One JSON record a row, missing values written out, so that every record has every field."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "raise") -> DataFrame:
    """Records of the given schema, never inferred. A record that is no JSON, or has a field of another type, is ``corrupt``: with ``raise`` it
    ends the job that meets it, with ``drop`` it is left out, with ``keep`` it stays, its text in ``_corrupt`` and its fields null."""
    if corrupt not in ("raise", "drop", "keep"):
        raise ValueError(f"corrupt records can be raised, dropped or kept, not {corrupt!r}")
    reader = spark.read.option("mode", {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[corrupt])
    if corrupt == "keep":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by another in one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    out = store.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    choice = spark.sparkContext._gateway.new_array(options, 1)
    choice[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(staged), store.makeQualified(target), choice)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Ledger:
    """Units of work under a folder: ``done`` (one row a finished unit), ``units`` (their files), ``current.json`` (what is published)."""

    SCHEMA = "unit string, place string, n_rows long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self) -> DataFrame:
        """unit, place, n_rows. If two runs finished a unit, the lower place counts for every reader."""
        if not exists(self.spark, f"{self.folder}/done"):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/done")
        return rows.groupBy("unit").agg(F.min(F.struct("place", "n_rows")).alias("_d")).select("unit", "_d.place", "_d.n_rows")

    def pending(self, units: list[str]) -> list[str]:
        """Units without a row in ``done``, in order."""
        wanted = self.spark.createDataFrame([(u,) for u in dict.fromkeys(units)], "unit string")
        left = {r["unit"] for r in wanted.join(self.done(), "unit", "left_anti").collect()}  # one row a unit
        return [u for u in dict.fromkeys(units) if u in left]

    def run(self, units: list[str], work: Callable[[str], DataFrame]) -> list[str]:
        """Do what is pending, a unit at a time, and tell what was done. If ``work`` fails, the units before it stay done."""
        todo = self.pending(units)
        for unit in todo:
            place = f"{self.folder}/units/{uuid.uuid4().hex}"
            work(unit).write.mode("errorifexists").parquet(place)
            n = self.spark.read.parquet(place).count()
            self.spark.createDataFrame([(unit, place, n)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        return todo

    def publish(self, units: list[str]) -> dict:
        """Make the units the current result; all of them must be done."""
        left = self.pending(units)
        if left:
            raise RuntimeError(f"nothing published, units missing: {left}")
        places = {r["unit"]: r for r in self.done().collect()}
        record = {"units": [{"unit": u, "place": places[u]["place"], "n_rows": places[u]["n_rows"]} for u in dict.fromkeys(units)]}
        swap_text(self.spark, f"{self.folder}/current.json", json.dumps(record))
        return record

    def published(self) -> DataFrame:
        """Rows of all published units, each with its ``unit``."""
        item = T.StructType([T.StructField("unit", T.StringType()), T.StructField("place", T.StringType()), T.StructField("n_rows", T.LongType())])
        record = read_json(self.spark, f"{self.folder}/current.json", T.StructType([T.StructField("units", T.ArrayType(item))]))
        units = record.select(F.inline("units")).collect()  # one row a unit
        rows = self.spark.read.parquet(*[u["place"] for u in units])
        named = self.spark.createDataFrame([(u["place"].rsplit("/", 1)[1], u["unit"]) for u in units], "_place string, unit string")
        placed = rows.withColumn("_place", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return placed.join(F.broadcast(named), "_place").drop("_place")
