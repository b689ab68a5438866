"""Queries A (scans and sinks), B (filters) and K (gates)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.numeric import six
from assayframe.operators import composition as C
from assayframe.operators import filters as B
from assayframe.operators import gates as K
from assayframe.operators import part_gates as PG
from assayframe.operators import splits as S
from assayframe.plans import standins as D
from assayframe.plans.curation import stage_counts
from assayframe.plans.registry import query
from assayframe.plans.standins import CAT, COMP, r6, table, with_
from assayframe.operators.dedup import one_per_key
from assayframe.sources import artifacts as J
from assayframe.sources import fold_files as FF
from assayframe.sources import tables as A
from assayframe.sources.session import new_table_path, settle

#: Rows of a file that a query writes, at most.
_FILE_ROWS = 1_000_000

_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query("a1_corpus_scan", "SELECT o_orderkey AS material_id, o_totalprice AS target, o_orderpriority AS attribute FROM orders")
def _(spark, sf):
    df = A.read_table(spark, f"{sf}/orders.parquet", schema=_ORDERS, columns=["o_orderkey", "o_totalprice", "o_orderpriority"])
    return df.toDF("material_id", "target", "attribute")


@query(
    "a2_projected_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL",
)
def _(spark, sf):
    return A.read_complete(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query(
    "a3_schema_probe",
    """SELECT 'orders' AS tbl, false AS has_column, count(c_acctbal)::BIGINT AS n_known FROM orders LEFT JOIN customer ON o_custkey=c_custkey
    UNION ALL SELECT 'customer', true, count(c_acctbal) FROM customer""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf, "customer")
    out = None
    for name, df in (("orders", orders), ("customer", customer)):
        has = A.has_columns(df, "c_acctbal")
        full = B.with_backfill(df, "c_acctbal", customer, "c_custkey")
        one = full.agg(F.count("c_acctbal").alias("n_known")).select(
            F.lit(name).alias("tbl"), F.lit(has).alias("has_column"), "n_known"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a4_table_sink",
    """SELECT 'csv' AS fmt, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'parquet', c_custkey, c_acctbal FROM customer""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = None
    for fmt in ("csv", "parquet"):
        path = A.write_table(df, new_table_path(spark, "sink"), fmt)
        back = A.read_table(spark, path, fmt, schema=df.schema).select(F.lit(fmt).alias("fmt"), "c_custkey", "c_acctbal")
        out = back if out is None else out.unionByName(back)
    return out


def _lomo(spark, sf):
    return S.leave_one_category_out(settle(C.categories(D.composition(spark, sf), D.CATEGORY_BRANDS), "categories"))


def _by_priority(spark, sf):
    return D.order_rows(spark, sf).select("row_id", F.col("attribute").alias("fold"))


_LOMO = f"""{with_(COMP, CAT, "f AS (SELECT DISTINCT category AS fold FROM cat WHERE category NOT IN ('multi','Others'))")}"""


@query(
    "a5_fold_artifact",
    _LOMO + "SELECT 'lomo' AS split, fold, CASE WHEN category=fold THEN 'test' ELSE 'train' END AS role, row_id FROM cat, f",
)
def _(spark, sf):
    folds = S.expand_folds(_lomo(spark, sf), "lomo").unionByName(S.expand_folds(_by_priority(spark, sf), "priority"))
    path = A.write_folds(folds, new_table_path(spark, "folds"))
    return A.read_folds(spark, path, ["lomo"]).select("split", "fold", "role", "row_id")


_MANIFEST_SQL = (
    _LOMO.rstrip() + """,
    m AS (SELECT 'lomo' AS split, fold, sum((category<>fold)::INT)::BIGINT AS n_train, sum((category=fold)::INT)::BIGINT AS n_test FROM cat, f GROUP BY 2
      UNION ALL SELECT 'priority', p, (SELECT count(*) FROM orders)-count(*), count(*) FROM (SELECT o_orderpriority AS p FROM orders) GROUP BY 2)
    SELECT s.split, fold, coalesce(n_train,0)::BIGINT AS n_train, coalesce(n_test,0)::BIGINT AS n_test
    FROM (VALUES ('lomo'),('priority'),('feature_ood')) s(split) LEFT JOIN m ON m.split=s.split"""
)


def _manifest(spark, sf):
    counts = S.fold_counts(_lomo(spark, sf), "lomo").unionByName(S.fold_counts(_by_priority(spark, sf), "priority"))
    return S.listed(counts, ["lomo", "priority", "feature_ood"])


@query("a6_fold_manifest", _MANIFEST_SQL)
def _(spark, sf):
    return _manifest(spark, sf)


@query("a6_manifest_json", _MANIFEST_SQL)
def _(spark, sf):
    rows = _manifest(spark, sf)
    path = J.write_json(rows, new_table_path(spark, "manifest"), by=["split"])
    return J.read_json(spark, path, rows.schema).select(*rows.columns)


PARTS = """q AS (SELECT count(*) AS n, ceil(0.15e0*count(*))::BIGINT AS nt FROM orders),
q2 AS (SELECT nt, ceil((0.15e0/(1-0.15e0))*(n-nt))::BIGINT AS nv FROM q),
rk AS (SELECT o_orderkey AS row_id, o_totalprice AS target, row_number() OVER (ORDER BY md5('42:parts:'||o_orderkey), o_orderkey) AS r FROM orders),
parts AS (SELECT row_id, target, CASE WHEN r<=nt THEN 'test' WHEN r<=nt+nv THEN 'val' ELSE 'train' END AS part FROM rk, q2)"""


@query(
    "a7_export_parts",
    with_(PARTS) + f"SELECT part, row_id AS material_id, 'F'||row_id AS formula, {r6('target::FLOAT::DOUBLE')} AS target FROM parts",
)
def _(spark, sf):
    rows = S.random_parts(D.order_rows(spark, sf).select("row_id", "target"))
    rows = rows.withColumn("formula", F.concat(F.lit("F"), F.col("row_id").cast("string")))
    path = A.export_parts(rows, new_table_path(spark, "parts"), "formula", "target")
    return spark.read.parquet(path).select("part", "material_id", "formula", six(F.col("target").cast("double")).alias("target"))


_HISTORY_SQL = (
    f"""WITH h AS (SELECT vec_id, label, embedding AS t, list_reverse(embedding) AS p, unnest(range(0, len(embedding))) AS pos FROM embeddings)
    SELECT vec_id, pos::BIGINT AS pos, {r6('t[pos+1]::DOUBLE')} AS y_true, {r6('p[pos+1]::DOUBLE')} AS y_pred,
      CASE WHEN label<>0 THEN pos::BIGINT END AS item FROM h"""
)


def _runs(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("test_true"), F.reverse("embedding").alias("test_pred"),
        F.when(F.col("label") != 0, F.sequence(F.lit(0).cast("bigint"), F.size("embedding").cast("bigint") - 1)).otherwise(
            F.array(F.lit(0).cast("bigint"))
        ).alias("ids"),
    )


def _history(runs):
    out = A.flatten_history(runs, ["vec_id"], "test_true", "test_pred", {"item": "ids"})
    return out.select("vec_id", "pos", six(F.col("y_true")).alias("y_true"), six(F.col("y_pred")).alias("y_pred"), "item")


@query("a8_history_rows", _HISTORY_SQL)
def _(spark, sf):
    return _history(_runs(spark, sf))


@query("a8_history_json", _HISTORY_SQL)
def _(spark, sf):
    """Nested histories, one JSON record a run, read back and flattened."""
    runs = _runs(spark, sf)
    return _history(J.read_json(spark, J.write_json(runs, new_table_path(spark, "history")), runs.schema))


@query(
    "a9_given_folds",
    """WITH l AS (SELECT l_linenumber AS n, p_brand AS b FROM lineitem JOIN part ON l_partkey=p_partkey),
    f AS (SELECT 'fold_'||l_returnflag AS fold, l_returnflag AS rf FROM lineitem GROUP BY 1,2)
    SELECT fold, sum((l_returnflag<>rf)::INT)::BIGINT AS n_train, sum((l_returnflag=rf)::INT)::BIGINT AS n_test, count(DISTINCT p_brand)::BIGINT AS n_elements
    FROM lineitem JOIN part ON l_partkey=p_partkey, f GROUP BY 1""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("element"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").join(parts, "l_partkey")
    flag = F.col("l_returnflag")
    given = {f"fold_{v}": (lines.where(flag != v), lines.where(flag == v)) for v in ("A", "N", "R")}
    return (
        A.union_folds(given)
        .groupBy("fold", "element")
        .agg(F.count_if(F.col("role") == "train").alias("t"), F.count_if(F.col("role") == "test").alias("s"))
        .groupBy("fold")
        .agg(F.sum("t").alias("n_train"), F.sum("s").alias("n_test"), F.count(F.lit(1)).alias("n_elements"))
    )


_LINES = T.StructType([T.StructField("l_partkey", T.LongType()), T.StructField("element", T.StringType()), T.StructField("l_quantity", T.DoubleType())])


def _fold_files(spark, sf):
    """Folds by return flag, written to one train and one test file each and read from them."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("element"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag").join(parts, "l_partkey")
    flags = ("A", "N", "R")
    sided = lines.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in flags])))
    sided = sided.withColumn("role", F.when(F.col("fold") == F.col("l_returnflag"), "test").otherwise("train"))
    folder = FF.write_fold_files(sided, new_table_path(spark, "fold-files"), _LINES.names)
    return FF.read_fold_files(spark, folder, _LINES, list(flags))


@query(
    "a9_folds_from_files",
    f"""SELECT f.fold, CASE WHEN l_returnflag=f.fold THEN 'test' ELSE 'train' END AS role, count(*)::BIGINT AS n_rows, {r6('sum(l_quantity)::DOUBLE')} AS quantity,
      sum(l_partkey)::BIGINT AS key_sum FROM lineitem JOIN part ON l_partkey=p_partkey, (VALUES ('A'),('N'),('R')) f(fold) GROUP BY 1, 2""",
)
def _(spark, sf):
    return _fold_files(spark, sf).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), six(F.sum("l_quantity")).alias("quantity"), F.sum("l_partkey").alias("key_sum")
    )


@query(
    "a9_fold_vocabularies",
    """SELECT f.fold, p_brand AS element, count(*) FILTER (WHERE l_returnflag<>f.fold)::BIGINT AS n_train, count(*) FILTER (WHERE l_returnflag=f.fold)::BIGINT AS n_test
    FROM lineitem JOIN part ON l_partkey=p_partkey, (VALUES ('A'),('N'),('R')) f(fold) GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = settle(_fold_files(spark, sf), "fold-rows")
    counts = rows.groupBy("fold", "element").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
    return FF.fold_vocabularies(rows, "element").join(counts, ["fold", "element"])


# ---- B ---------------------------------------------------------------------------

_ATOMS = "atoms AS (SELECT row_id, sum(amount) AS num_atoms FROM comp GROUP BY 1)"


@query(
    "b1_complete_rows",
    with_(COMP, _ATOMS) + "SELECT o_orderkey AS row_id, num_atoms, o_totalprice AS target FROM orders JOIN atoms ON row_id=o_orderkey",
)
def _(spark, sf):
    rows = D.order_rows(spark, sf).join(C.atom_count(D.composition(spark, sf)), "row_id", "left")
    return B.complete_rows(rows.select("row_id", "num_atoms", "target"), ["num_atoms", "target"])


@query("b2_nonzero_target", "SELECT l_orderkey, l_partkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0")
def _(spark, sf):
    return B.nonzero_target(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount"), "l_discount")


@query(
    "b3_stability_filter",
    """SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice NULLS LAST, p_partkey) AS r
    FROM part WHERE p_retailprice <= 1000 AND p_brand IS NOT NULL) WHERE r=1""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_partkey", "p_retailprice", "p_brand")
    return one_per_key(B.within_hull(part, "p_retailprice", ["p_name", "p_brand"], 1000.0), "p_name", "p_retailprice", "p_partkey").drop("p_brand")


@query("b4_backfill", "SELECT o_orderkey, c_custkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return B.with_backfill(orders, "c_acctbal", table(spark, sf, "customer"), "c_custkey").select("o_orderkey", "c_custkey", "c_acctbal")


@query(
    "b5_without_rare_elements",
    with_(
        COMP,
        "n AS (SELECT element, count(*) AS c FROM comp GROUP BY 1)",
        "rare AS (SELECT element FROM n WHERE c < (SELECT floor(avg(c)) FROM n))",
        "hit AS (SELECT DISTINCT row_id FROM comp WHERE element IN (SELECT element FROM rare))",
    )
    + "SELECT o_orderkey AS row_id, o_totalprice AS target FROM orders WHERE o_orderkey IN (SELECT row_id FROM comp) AND o_orderkey NOT IN (SELECT row_id FROM hit)",
)
def _(spark, sf):
    comp = settle(D.composition(spark, sf), "comp")
    minimum = int(B.element_counts(comp).agg(F.floor(F.avg("n_rows"))).first()[0])
    return B.rows_without_rare(comp, D.order_rows(spark, sf).select("row_id", "target"), minimum)


@query(
    "b6_corpus_report",
    """WITH s AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Z][a-z]?')) AS e FROM documents)
    SELECT d.lang, d.n::BIGINT AS n_rows, coalesce(e.k,0)::BIGINT AS n_elements FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) d
    LEFT JOIN (SELECT lang, count(DISTINCT e) AS k FROM s GROUP BY 1) e ON e.lang=d.lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    found = docs.select("lang", F.explode_outer(C.symbols_in(F.col("text"))).alias("e")).where("e is not null").distinct()
    rows = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(found.groupBy("lang").agg(F.count("e").alias("n_elements")), "lang", "left").na.fill(0, ["n_elements"])


@query(
    "b7_real_compositions",
    with_(COMP, f"bad AS (SELECT DISTINCT row_id FROM comp WHERE {D.NUM} > 20)")
    + "SELECT row_id, element, amount FROM comp WHERE row_id NOT IN (SELECT row_id FROM bad)",
)
def _(spark, sf):
    known = table(spark, sf, "part").select(F.col("p_brand").alias("element")).distinct().where(D.suffix(F.col("element")) <= 20)
    return C.only_known(D.composition(spark, sf), known).select("row_id", "element", "amount")


_SYS = "sys AS (SELECT row_id, string_agg(element,'-' ORDER BY element) AS system FROM comp GROUP BY 1)"


@query(
    "b8_kept_set",
    with_(COMP, _SYS) + "SELECT row_id, system FROM sys WHERE system IN (SELECT system FROM sys GROUP BY 1 HAVING count(*)>=3)",
)
def _(spark, sf):
    systems = C.element_set_key(D.composition(spark, sf))
    kept = systems.groupBy("system").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return B.in_kept_set(systems, kept, "system").select("row_id", "system")


_MAN = with_(
    COMP, CAT, "f AS (SELECT DISTINCT category AS fold FROM cat WHERE category NOT IN ('multi','Others'))",
    "m AS (SELECT 'lomo' AS split, fold, sum((category<>fold)::INT)::BIGINT AS n_train, sum((category=fold)::INT)::BIGINT AS n_test FROM cat, f GROUP BY 2)",
    "lim AS (SELECT floor(avg(n_test))::BIGINT AS t FROM m)",
)


@query(
    "b9_fold_eligibility",
    _MAN + """SELECT split, fold, n_train, n_test, n_test >= t AND n_train >= 200 AS eligible,
    concat_ws(',', CASE WHEN n_test < t THEN 'test too small' END, CASE WHEN n_train < 200 THEN 'train too small' END) AS reason FROM m, lim""",
)
def _(spark, sf):
    m = settle(S.fold_counts(_lomo(spark, sf), "lomo"), "manifest")
    floor = int(m.agg(F.floor(F.avg("n_test"))).first()[0])
    return B.fold_eligibility(m, min_test=floor)


@query("b10_fold_selection", _MAN + "SELECT split, fold, n_train, n_test FROM m WHERE fold IN ('Alpha','Delta')")
def _(spark, sf):
    return B.select_folds(S.fold_counts(_lomo(spark, sf), "lomo"), ["lomo_Alpha", "lomo_Delta"])


# ---- K ---------------------------------------------------------------------------

_LINE_TEXTS = (
    "l_discount::VARCHAR l_extendedprice::VARCHAR l_linenumber::VARCHAR l_linestatus l_orderkey::VARCHAR l_partkey::VARCHAR "
    "l_quantity::VARCHAR l_returnflag epoch_us(l_shipdate)::VARCHAR l_suppkey::VARCHAR l_tax::VARCHAR"
).split()
_LINE_ROW = "concat_ws('|', " + ", ".join(f"coalesce(length({t})||':'||{t},'~')" for t in _LINE_TEXTS) + ")"
_FP = "count(*)::BIGINT AS rows, sum(('0x'||substr(h,1,8))::BIGINT)::VARCHAR AS digest_sum, bit_xor(('0x'||substr(h,9,8))::BIGINT)::BIGINT AS digest_xor"


@query("k1_table_fingerprint", f"SELECT {_FP} FROM (SELECT md5({_LINE_ROW}) AS h FROM lineitem)")
def _(spark, sf):
    return K.fingerprint(table(spark, sf, "lineitem"))


@query(
    "k2_part_manifest",
    f"""WITH p AS (SELECT l_returnflag, {_FP} FROM (SELECT l_returnflag, md5({_LINE_ROW}) AS h FROM lineitem) GROUP BY 1)
    SELECT count(*)::BIGINT AS parts, md5(string_agg(l_returnflag||':'||rows||':'||digest_sum||':'||digest_xor, chr(10) ORDER BY l_returnflag||':'||rows)) AS manifest FROM p""",
)
def _(spark, sf):
    return K.part_manifest(table(spark, sf, "lineitem"), "l_returnflag")


@query(
    "k1_incremental_fingerprint",
    f"SELECT {_FP} FROM (SELECT md5({_LINE_ROW}) AS h FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber=1))",
)
def _(spark, sf):
    """Digests of a table's files, then of those that come to it: the second run reads these alone. Every task writes the files of its own rows."""
    lines = table(spark, sf, "lineitem")
    folder, manifest = new_table_path(spark, "lines"), new_table_path(spark, "lines-manifest")
    lines.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(folder)
    before, _ = PG.refresh(spark, folder, manifest, lines.schema)
    lines.where("l_linenumber = 1").write.mode("append").option("maxRecordsPerFile", _FILE_ROWS).parquet(folder)
    now, read = PG.refresh(spark, folder, manifest, lines.schema)
    held = {r["path"] for r in before.select("path").collect()}  # names, as every listing has them
    if not read or held & set(read):
        raise RuntimeError(f"{len(held & set(read))} files were read again")
    return PG.total(now)
