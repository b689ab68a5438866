"""Queries F (de-duplication and training arms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.numeric import six
from assayframe.operators import arms as R
from assayframe.operators import dedup as X
from assayframe.operators import neighbours as N
from assayframe.operators import splits as S
from assayframe.plans import curation
from assayframe.plans import standins as D
from assayframe.plans.registry import query
from assayframe.plans.standins import COMP, NUM, SYM, r6, table, with_
from assayframe.sources.artifacts import Ledger
from assayframe.sources.session import new_table_path, settle


@query(
    "f1_one_per_key",
    """SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice NULLS LAST, p_partkey) AS r FROM part) WHERE r=1""",
)
def _(spark, sf):
    return X.one_per_key(table(spark, sf, "part").select("p_name", "p_partkey", "p_retailprice"), "p_name", "p_retailprice", "p_partkey")


def _points_sql(comp="comp", last=25):
    """SQL for pts(row_id, n, c): total amount and the list of cumulative shares."""
    return f"""bt AS (SELECT row_id, {NUM} AS p, amount FROM {comp}),
    tt AS (SELECT row_id, sum(amount) AS n FROM bt GROUP BY 1),
    pts AS (SELECT row_id, any_value(n) AS n, list(s/n ORDER BY i) AS c FROM (
      SELECT tt.row_id, i, n, coalesce(sum(CASE WHEN p<=i THEN amount END),0) AS s FROM tt CROSS JOIN range(1,{last}) r(i) JOIN bt ON bt.row_id=tt.row_id GROUP BY 1,2,3) GROUP BY 1)"""


def _dist_sql(a, b, last=25):
    return f"(floor(list_sum(list_transform(range(1,{last}), lambda i: abs({a}[i]-{b}[i])))*1e9+0.5)/1e9)"


def _greedy_sql(t, src="pts", grp="'all'", last=25):
    """SQL for kept(grp, row_id): the sequential scan as a recursion over ranks."""
    return f"""ord AS (SELECT {grp} AS grp, row_id, c, row_number() OVER (PARTITION BY {grp} ORDER BY n, row_id) AS rk FROM {src}),
    scan AS (SELECT grp, rk, [c] AS kc, [row_id] AS ids FROM ord WHERE rk=1
      UNION ALL SELECT s.grp, o.rk, CASE WHEN far THEN list_append(kc, o.c) ELSE kc END, CASE WHEN far THEN list_append(ids, o.row_id) ELSE ids END
      FROM (SELECT s.*, o.rk AS nrk, o.c AS oc, o.row_id AS oid, list_min(list_transform(kc, lambda k: {_dist_sql('k', 'o.c', last)})) > {t} AS far FROM scan s JOIN ord o ON o.grp=s.grp AND o.rk=s.rk+1) s
      JOIN ord o ON o.grp=s.grp AND o.rk=s.nrk),
    kept AS (SELECT grp, unnest(ids) AS row_id FROM (SELECT grp, max_by(ids, rk) AS ids FROM scan GROUP BY 1))"""


SUPP = f"comp AS ({D.comp_sql('l_suppkey')})"
_T = 0.3


@query(
    "f2_pair_distance",
    with_(COMP, _points_sql(), "pr AS (SELECT o_orderkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS b FROM orders)")
    + f"SELECT pr.a, pr.b, {r6(_dist_sql('x.c', 'y.c'))} AS distance FROM pr JOIN pts x ON x.row_id=pr.a JOIN pts y ON y.row_id=pr.b",
)
def _(spark, sf):
    orders = D.order_rows(spark, sf)
    first = orders.groupBy("cust").agg(F.min("row_id").alias("b"))
    pairs = orders.join(first, "cust").select(F.col("row_id").alias("a"), "b")
    out = X.pair_distances(pairs, settle(D.composition(spark, sf), "comp"), D.brand_scale(spark, sf))
    return out.withColumn("distance", six(F.col("distance")))


@query("f3_greedy_orders")
def _(spark, sf):
    return X.greedy_keep(settle(D.composition(spark, sf), "comp"), D.brand_scale(spark, sf), X.ARM_THRESHOLD)


@query("f3_greedy_orders_wide", with_(COMP, _points_sql(), _greedy_sql(5.0), recursive=True) + "SELECT row_id FROM kept")
def _(spark, sf):
    return X.greedy_keep(settle(D.composition(spark, sf), "comp"), D.brand_scale(spark, sf), X.DEFAULT_THRESHOLD)


@query("f3_greedy_suppliers", with_(SUPP, _points_sql(), _greedy_sql(_T), recursive=True) + "SELECT row_id FROM kept")
def _(spark, sf):
    return X.greedy_keep(settle(D.composition(spark, sf, "l_suppkey"), "comp"), D.brand_scale(spark, sf), _T)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


_LETTER_POINTS = """bt AS (SELECT row_id, p, amount FROM (SELECT doc_id AS row_id, p, length(lower(text))-length(replace(lower(text), chr((97+p)::INTEGER), '')) AS amount
    FROM documents, range(0,26) r(p)) WHERE amount > 0),
    tt AS (SELECT row_id, sum(amount)::DOUBLE AS n FROM bt GROUP BY 1),
    pts AS (SELECT row_id, any_value(n) AS n, list(s/n ORDER BY i) AS c FROM (
      SELECT tt.row_id, i, n, coalesce(sum(CASE WHEN p<=i THEN amount END),0)::DOUBLE AS s FROM tt CROSS JOIN range(0,25) r(i) JOIN bt ON bt.row_id=tt.row_id GROUP BY 1,2,3) GROUP BY 1)"""


@query("f3_greedy_documents", with_(_LETTER_POINTS, _greedy_sql(0.5, last=26), recursive=True) + "SELECT row_id FROM kept")
def _(spark, sf):
    # Letter shares of whole texts; near copies of a document lie close to it.
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    counts = [F.struct(F.lit(c).alias("element"), (F.length("t") - F.length(F.replace("t", F.lit(c)))).cast("double").alias("amount")) for c in _LETTERS]
    comp = docs.select(F.col("doc_id").alias("row_id"), F.inline(F.array(*counts))).where("amount > 0")
    scale = X.Scale({c: float(i) for i, c in enumerate(_LETTERS)})
    return X.greedy_keep(settle(comp, "letters"), scale, X.ARM_THRESHOLD)


def _supplier_corpus(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("hull"))
    f = D.formulas(spark, sf, "l_suppkey", bracket=False)
    return settle(rows.join(f, "row_id", "left"), "supplier-corpus")


_CURATE = with_(
    SUPP, f"sy AS (SELECT row_id, {SYM} AS s, amount, {NUM} AS p FROM comp)",
    "fo AS (SELECT row_id AS supp, string_agg(s||amount::BIGINT, '' ORDER BY s) AS formula FROM sy GROUP BY 1)",
    _points_sql(),
    # Ties in the total amount are broken by the formula itself.
    "fp AS (SELECT formula AS row_id, any_value(n) AS n, any_value(c) AS c FROM pts JOIN fo ON supp=row_id GROUP BY 1)",
    _greedy_sql(_T, "fp"), recursive=True,
)


@query(
    "f4_curated_corpus",
    _CURATE + "SELECT s_suppkey AS row_id, s_nationkey AS nation, s_acctbal AS hull, formula FROM supplier JOIN fo ON supp=s_suppkey WHERE formula IN (SELECT row_id FROM kept)",
)
def _(spark, sf):
    from assayframe.functions.periodic import SYMBOLS

    scale = X.Scale({s: float(i + 1) for i, s in enumerate(SYMBOLS[:25])})
    final, _ = curation.curate(_supplier_corpus(spark, sf), "row_id", "formula", "hull", ["formula"], scale, _T)
    return final.select("row_id", "nation", "hull", "formula")


@query(
    "f4_stage_counts",
    _CURATE + """SELECT 'complete' AS stage, count(*)::BIGINT AS n_rows FROM fo UNION ALL SELECT 'kept_formulas', count(*) FROM kept
    UNION ALL SELECT 'filtered', count(*) FROM fo WHERE formula IN (SELECT row_id FROM kept) UNION ALL SELECT 'final', count(*) FROM fo WHERE formula IN (SELECT row_id FROM kept)""",
)
def _(spark, sf):
    from assayframe.functions.periodic import SYMBOLS

    scale = X.Scale({s: float(i + 1) for i, s in enumerate(SYMBOLS[:25])})
    _, stages = curation.curate(_supplier_corpus(spark, sf), "row_id", "formula", "hull", ["formula"], scale, _T)
    return curation.stage_counts(stages)


def _supplier_train(spark, sf):
    """Leave-one-region-out training sides of the suppliers."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("string").alias("fold"))
    rows = table(spark, sf, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("row_id"), "fold")
    train = S.expand_folds(settle(rows, "suppliers"), "region").where("role = 'train'")
    return train.select("split", "fold", "row_id", F.col("row_id").alias("item"))


_FOLDS = with_(
    SUPP, _points_sql(),
    "sr AS (SELECT s_suppkey, n_regionkey::VARCHAR AS reg FROM supplier JOIN nation ON s_nationkey=n_nationkey)",
    "fl AS (SELECT DISTINCT reg AS fold FROM sr)",
    "tr AS (SELECT fold, s_suppkey AS row_id FROM sr, fl WHERE reg<>fold)",
    "fpts AS (SELECT fold, pts.* FROM tr JOIN pts ON pts.row_id=tr.row_id)",
    _greedy_sql(_T, "fpts", "fold"),
    "ded AS (SELECT grp AS fold, row_id FROM kept)",
    "sz AS (SELECT fold, count(*) AS k FROM ded GROUP BY 1)",
    "ctl AS (SELECT fold, row_id FROM (SELECT tr.fold, tr.row_id, k, row_number() OVER (PARTITION BY tr.fold ORDER BY md5('42:region/'||tr.fold||':'||tr.row_id), tr.row_id) AS r FROM tr JOIN sz ON sz.fold=tr.fold) WHERE r<=k)",
    recursive=True,
)


def _subsets(spark, sf):
    comp = settle(D.composition(spark, sf, "l_suppkey"), "comp")
    return R.train_subsets(_supplier_train(spark, sf), comp, D.brand_scale(spark, sf), _T)


@query("f5_fold_dedup_arm", _FOLDS + "SELECT 'region' AS split, fold, 'dedup' AS arm, row_id FROM ded")
def _(spark, sf):
    comp = settle(D.composition(spark, sf, "l_suppkey"), "comp")
    kept = R.survivors(_supplier_train(spark, sf), comp, D.brand_scale(spark, sf), _T, ["split", "fold"])
    return kept.select("split", "fold", F.lit("dedup").alias("arm"), "row_id")


_LEVELS = (0.1, 0.3, 0.6)
_LEVELS_SQL = ", ".join(f"({t})" for t in _LEVELS)


@query(
    "f4_threshold_variants",
    with_(
        SUPP, _points_sql(), f"leveled AS (SELECT pts.*, t FROM pts, (VALUES {_LEVELS_SQL}) v(t))",
        _greedy_sql("o.grp::DOUBLE", "leveled", "t::DOUBLE::VARCHAR"), recursive=True,
    ) + "SELECT grp::DOUBLE AS threshold, row_id FROM kept",
)
def _(spark, sf):
    comp = settle(D.composition(spark, sf, "l_suppkey"), "comp")
    return N.greedy_cases(comp, D.brand_scale(spark, sf), list(_LEVELS)).select("threshold", "row_id")


@query(
    "f5_threshold_sweep",
    with_(
        SUPP, _points_sql(),
        "sr AS (SELECT s_suppkey, n_regionkey::VARCHAR AS reg FROM supplier JOIN nation ON s_nationkey=n_nationkey)",
        f"tr AS (SELECT fold, s_suppkey AS row_id, t FROM sr, (SELECT DISTINCT reg AS fold FROM sr), (VALUES {_LEVELS_SQL}) v(t) WHERE reg<>fold)",
        "fpts AS (SELECT fold, t, pts.* FROM tr JOIN pts ON pts.row_id=tr.row_id)",
        _greedy_sql("split_part(o.grp, '@', 2)::DOUBLE", "fpts", "fold||'@'||t::DOUBLE"), recursive=True,
    ) + """SELECT split_part(grp, '@', 2)::DOUBLE AS threshold, split_part(grp, '@', 1) AS fold, count(*)::BIGINT AS n_kept, sum(row_id)::BIGINT AS id_sum
    FROM kept GROUP BY 1, 2""",
)
def _(spark, sf):
    comp = settle(D.composition(spark, sf, "l_suppkey"), "comp")
    members = _supplier_train(spark, sf).select(F.col("fold").alias("grp"), "row_id")
    kept = N.greedy_cases(comp, D.brand_scale(spark, sf), list(_LEVELS), members)
    return kept.groupBy("threshold", F.col("grp").alias("fold")).agg(F.count(F.lit(1)).alias("n_kept"), F.sum("row_id").alias("id_sum"))


@query("f6_size_matched_control", _FOLDS + "SELECT 'region' AS split, fold, 'sizematched' AS arm, row_id FROM ctl")
def _(spark, sf):
    return _subsets(spark, sf).where("arm = 'sizematched'").drop("item")


@query("f7_arm_sizes", _FOLDS + "SELECT 'region' AS split, tr.fold, count(*)::BIGINT AS n_train, any_value(k)::BIGINT AS n_dedup FROM tr JOIN sz ON sz.fold=tr.fold GROUP BY 2")
def _(spark, sf):
    return R.arm_sizes(_supplier_train(spark, sf), _subsets(spark, sf))


@query("f7_resumed_subsets", _FOLDS + "SELECT 'region' AS split, tr.fold, count(*)::BIGINT AS n_train, any_value(k)::BIGINT AS n_dedup FROM tr JOIN sz ON sz.fold=tr.fold GROUP BY 2")
def _(spark, sf):
    """A first run does two folds and stops; a second one finishes, publishes and is read."""
    train = settle(_supplier_train(spark, sf), "train")
    comp, scale = settle(D.composition(spark, sf, "l_suppkey"), "comp"), D.brand_scale(spark, sf)
    ledger = Ledger(spark, new_table_path(spark, "ledger"))
    folds = sorted(r[0] for r in train.select(F.concat_ws("/", "split", "fold")).distinct().collect())
    ledger.run(folds[:2], lambda unit: R.train_subsets(train.where(F.concat_ws("/", "split", "fold") == unit), comp, scale, _T))
    return R.arm_sizes(train, R.resumed_subsets(ledger, train, comp, scale, _T))


_ARMS = with_(
    SUPP, _points_sql(),
    "q AS (SELECT ceil(0.15e0*count(*))::BIGINT AS nt FROM supplier)",
    "sd AS (SELECT row_id, CASE WHEN r<=nt THEN 'test' ELSE 'pool' END AS side FROM (SELECT s_suppkey AS row_id, row_number() OVER (ORDER BY md5('42:parts:'||s_suppkey), s_suppkey) AS r FROM supplier), q)",
    "fpts AS (SELECT side, pts.* FROM sd JOIN pts ON pts.row_id=sd.row_id)",
    _greedy_sql(_T, "fpts", "side"),
    "ctl AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:arms/sizematched:'||row_id), row_id) AS r FROM sd WHERE side='pool') WHERE r<=(SELECT count(*) FROM kept WHERE grp='pool'))",
    """mem AS (SELECT 'test' AS role, sd.row_id, kept.row_id IS NOT NULL AS test_dedup_survivor FROM sd LEFT JOIN kept ON kept.row_id=sd.row_id AND grp='test' WHERE side='test'
    UNION ALL SELECT 'train_full', row_id, false FROM sd WHERE side='pool' UNION ALL SELECT 'train_dedup', row_id, false FROM kept WHERE grp='pool'
    UNION ALL SELECT 'train_sizematched', row_id, false FROM ctl)""",
    recursive=True,
)


def _locked(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_suppkey").alias("item"))
    return R.locked_test_arms(rows, settle(D.composition(spark, sf, "l_suppkey"), "comp"), D.brand_scale(spark, sf), _T)


@query("f8_locked_test_arms", _ARMS + "SELECT role, row_id, test_dedup_survivor FROM mem")
def _(spark, sf):
    return _locked(spark, sf).drop("item")


@query("f9_test_survivors", _ARMS + "SELECT row_id, test_dedup_survivor FROM mem WHERE role='test'")
def _(spark, sf):
    return _locked(spark, sf).where("role = 'test'").select("row_id", "test_dedup_survivor")
