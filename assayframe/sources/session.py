"""Session set-up and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "assayframe", cores: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed. Functions that run there are
    found by name, so every Python worker must be able to import it."""
    import zipfile

    import assayframe

    home = os.path.dirname(os.path.abspath(assayframe.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="assayframe-"), "assayframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(target)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` when the
    cluster names one, else the context's checkpoint folder, else a new one, which
    only a single-machine session may have: on a cluster each executor would write
    to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assayframe-"))
    return sc.getCheckpointDir()


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    The result has no lineage above the files, so a lost executor costs a re-read
    only, and the planner knows its real size: a small table is broadcast by the
    size check Spark makes itself and a large one is not.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more (only folders below the scratch root)."""
    for df in tables:
        spark = df.sparkSession
        conf, make = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        root = make(scratch_root(spark))
        root = str(root.getFileSystem(conf).makeQualified(root)).rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = make(folder)
            store = path.getFileSystem(conf)
            if not str(store.makeQualified(path)).startswith(root):
                raise ValueError(f"{folder} is no scratch table")
            store.delete(path, True)


class Scratch:
    """Settled tables of one operator, to be released together once its result no longer reads them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        table = settle(df, label)
        self.tables.append(table)
        return table

    def release(self) -> None:
        release(*self.tables)
        self.tables = []
