"""How the driver tables stand in for a corpus, as DataFrames and as SQL.

An order is a material, the brands of its lines are its elements and the summed
quantities their amounts. The SQL twins are used for comparison only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.periodic import SYMBOLS
from assayframe.operators.dedup import Scale

#: Lines that one task groups.
TASK_LINES = 1_000_000

BRANDS = [f"Brand#{i}" for i in range(1, 26)]

# Stand-in categories: some brands belong to none, so both catch-alls occur.
CATEGORY_BRANDS = {
    "Alpha": ("Brand#1",),
    "Beta": ("Brand#2", "Brand#3"),
    "Delta": ("Brand#4", "Brand#5", "Brand#6"),
    "Gamma": ("Brand#7",),
    "Omega": ("Brand#8",),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def composition(spark: SparkSession, sf: str, row: str = "l_orderkey") -> DataFrame:
    """(row_id, element, amount) of orders, or of another lineitem key."""
    lines = table(spark, sf, "lineitem").select(row, "l_partkey", "l_quantity")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("element"))
    placed = lines.join(parts, "l_partkey")
    # Many lines go to as many tasks as their number asks for; groupings by row_id that follow find them in place.
    tasks = -(-lines.count() // TASK_LINES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartition(tasks, row)
    return placed.groupBy(F.col(row).alias("row_id"), "element").agg(F.sum("l_quantity").alias("amount"))


def suffix(c) -> "F.Column":
    return F.substring_index(c, "#", -1).cast("int")


def brand_scale(spark: SparkSession, sf: str) -> Scale:
    """Brand -> its number. The brands of ``part`` are the vocabulary."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("element")).distinct()
    return Scale.from_table(brands.withColumn("position", suffix(F.col("element")).cast("double")))


def symbol(brand) -> "F.Column":
    """Brand number n to the n-th element symbol."""
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS[:25]]), suffix(brand))


def formulas(spark: SparkSession, sf: str, row: str = "l_orderkey", bracket: bool = True) -> DataFrame:
    """(row_id, formula): symbols in order with whole amounts; from three elements on,
    all but the first stand in a doubled bracket."""
    comp = composition(spark, sf, row).select("row_id", symbol(F.col("element")).alias("s"), F.col("amount").cast("bigint").alias("n"))
    bag = comp.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("b"))
    text = lambda b: F.array_join(F.transform(b, lambda x: F.concat(x["s"], x["n"].cast("string"))), "")
    plain = text(F.col("b"))
    grouped = F.concat(text(F.slice("b", 1, 1)), F.lit("("), text(F.slice(F.col("b"), F.lit(2), F.size("b"))), F.lit(")2"))
    formula = F.when(F.size("b") >= 3, grouped).otherwise(plain) if bracket else plain
    return bag.select("row_id", formula.alias("formula"))


def properties(spark: SparkSession, sf: str) -> DataFrame:
    """Property table of the brands with gaps. It has one row per brand. Values are whole
    or halves, so weighted sums are exact in any order."""
    b = F.col("p_brand")
    gap = lambda c, *names: F.when(~b.isin(*names), c)
    g = table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.avg("p_retailprice").alias("price"),
        F.min("p_retailprice").alias("cheap"),
        F.array_sort(F.collect_set(F.when(F.col("p_size") <= 4, F.col("p_size") - 2))).alias("states"),
    )
    return g.select(
        b.alias("element"),
        gap(F.col("lo").cast("double"), "Brand#3", "Brand#11").alias("size"),
        gap(F.floor("price").cast("double"), "Brand#5", "Brand#20").alias("price"),
        gap(F.col("lo") / 2, "Brand#3").alias("valence"),
        gap(F.floor(F.col("price") % 100).cast("double"), "Brand#5").alias("chi"),
        gap(F.col("hi").cast("double"), "Brand#9").alias("ie"),
        gap(F.floor("cheap").cast("double"), "Brand#12").alias("ea"),
        gap(F.floor(F.col("price") % 10).cast("double"), "Brand#7").alias("polarizability"),
        suffix(b).cast("double").alias("z"),
        (suffix(b) >= 20).cast("int").cast("double").alias("f_flag"),
        "states",
    )


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("target"), F.col("o_orderpriority").alias("attribute"),
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as predictions: discount is the truth, tax the prediction, line number the seed."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("fold"), F.col("l_linenumber").alias("seed"),
        F.col("l_discount").alias("y_true"), F.col("l_tax").alias("y_pred"), "l_partkey", "l_orderkey",
    )


FEATURES = ["qty", "n_lines", "top_price", "low_disc", "sum_tax", "twice", "flat", "O", "Fe"]


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order; orders without lines have missing features."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.max("l_extendedprice").alias("top_price"), F.min("l_discount").alias("low_disc"), F.sum("l_tax").alias("sum_tax"),
        (F.sum("l_quantity") * 2).alias("twice"),
        F.max(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).alias("O"),
        F.max(F.lit(0.0)).alias("Fe"),
    )
    return order_rows(spark, sf).join(lines, "row_id", "left").select(
        "row_id", "target", F.col("attribute").alias("fold"), *[F.lit(3.0).alias("flat") if f == "flat" else F.col(f) for f in FEATURES]
    )


# ---- SQL twins -------------------------------------------------------------------

def r6(e: str) -> str:
    return f"(floor(({e})*1e6+0.5)/1e6)"


def comp_sql(row: str = "l_orderkey") -> str:
    return (
        f"SELECT {row} AS row_id, p_brand AS element, sum(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2"
    )


COMP = f"comp AS ({comp_sql()})"
NUM = "CAST(regexp_extract(element, '[0-9]+') AS INTEGER)"
SYM = "CASE " + " ".join(f"WHEN element='Brand#{i + 1}' THEN '{s}'" for i, s in enumerate(SYMBOLS[:25])) + " END"
_FLAGS = ", ".join(
    f"max(CASE WHEN element IN ({','.join(repr(b) for b in bs)}) THEN 1 ELSE 0 END) AS {c.lower()}" for c, bs in CATEGORY_BRANDS.items()
)
_NAMES = [c.lower() for c in CATEGORY_BRANDS]
_PICK = " ".join(f"WHEN {c.lower()}=1 THEN '{c}'" for c in CATEGORY_BRANDS)
CAT = (
    f"flags AS (SELECT row_id, {_FLAGS} FROM comp GROUP BY 1), "
    f"cat AS (SELECT row_id, CASE WHEN {'+'.join(_NAMES)}=0 THEN 'Others' WHEN {'+'.join(_NAMES)}>1 THEN 'multi' {_PICK} END AS category FROM flags)"
)
PROPS = """g0 AS (SELECT p_brand AS element, min(p_size) AS lo, max(p_size) AS hi, avg(p_retailprice) AS price, min(p_retailprice) AS cheap,
  list(DISTINCT p_size-2) FILTER (WHERE p_size<=4) AS states FROM part GROUP BY 1),
props AS (SELECT element,
  CASE WHEN element NOT IN ('Brand#3','Brand#11') THEN lo::DOUBLE END AS size,
  CASE WHEN element NOT IN ('Brand#5','Brand#20') THEN floor(price) END AS price,
  CASE WHEN element NOT IN ('Brand#3') THEN lo/2.0::DOUBLE END AS valence,
  CASE WHEN element NOT IN ('Brand#5') THEN floor(price % 100) END AS chi,
  CASE WHEN element NOT IN ('Brand#9') THEN hi::DOUBLE END AS ie,
  CASE WHEN element NOT IN ('Brand#12') THEN floor(cheap) END AS ea,
  CASE WHEN element NOT IN ('Brand#7') THEN floor(price % 10) END AS polarizability,
  CAST(regexp_extract(element,'[0-9]+') AS DOUBLE) AS z,
  CASE WHEN CAST(regexp_extract(element,'[0-9]+') AS INTEGER)>=20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_flag,
  states FROM g0)"""
CP = "cp AS (SELECT comp.*, props.* EXCLUDE (element) FROM comp LEFT JOIN props ON comp.element=props.element)"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
