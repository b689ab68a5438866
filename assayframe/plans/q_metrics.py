"""Queries I (evaluation analytics) and J (model evaluation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.numeric import six
from assayframe.operators import linear as L
from assayframe.operators import metrics as I
from assayframe.operators import models as J
from assayframe.plans import standins as D
from assayframe.plans.q_sources import PARTS
from assayframe.plans.registry import query
from assayframe.plans.standins import r6, table, with_
from assayframe.sources.session import settle

_M = ["mae", "rmse", "r2", "mrae", "mape", "mae_nonmetals", "rmse_nonmetals", "r2_nonmetals"]
PRED = """pred AS (SELECT l_linestatus AS split, l_returnflag AS fold, l_linenumber AS seed, l_discount AS y, l_tax AS p, l_partkey, l_orderkey FROM lineitem)"""


def _r2(y, p, cond="true"):
    sse = f"sum(CASE WHEN {cond} THEN ({p}-{y})*({p}-{y}) END)"
    n = f"count(CASE WHEN {cond} THEN 1 END)"
    sst = f"(var_pop(CASE WHEN {cond} THEN {y} END)*{n})"
    return f"CASE WHEN {n}<2 THEN NULL WHEN {sst}=0 THEN (CASE WHEN {sse}=0 THEN 1.0 ELSE 0.0 END) ELSE 1-{sse}/{sst} END"


def _metric_sql(y="y", p="p"):
    nz = f"{y}<>0"
    return {
        "mae": f"avg(abs({p}-{y}))",
        "rmse": f"sqrt(avg(({p}-{y})*({p}-{y})))",
        "r2": _r2(y, p),
        "mrae": f"avg(CASE WHEN {nz} THEN abs({p}-{y})/abs({y}) END)",
        "mape": f"avg(CASE WHEN {nz} THEN abs({p}-{y})/abs({y}) END)*100",
        "mae_nonmetals": f"CASE WHEN count(CASE WHEN {nz} THEN 1 END)>=2 THEN avg(CASE WHEN {nz} THEN abs({p}-{y}) END) END",
        "rmse_nonmetals": f"CASE WHEN count(CASE WHEN {nz} THEN 1 END)>=2 THEN sqrt(avg(CASE WHEN {nz} THEN ({p}-{y})*({p}-{y}) END)) END",
        "r2_nonmetals": f"CASE WHEN count(CASE WHEN {nz} THEN 1 END)>=2 THEN {_r2(y, p, nz)} END",
    }


def _cols(names, y="y", p="p"):
    m = _metric_sql(y, p)
    return ", ".join(f"{r6(m[n])} AS {n}" for n in names)


def _rounded(df, *keep):
    return df.select(*keep, *[six(F.col(c)).alias(c) for c in df.columns if c not in keep])


@query("i1_error_metrics", with_(PRED) + f"SELECT count(*)::BIGINT AS n_test, {_cols(['mae', 'rmse', 'r2'])} FROM pred")
def _(spark, sf):
    return _rounded(I.evaluate(D.predictions(spark, sf), []).select("n_test", "mae", "rmse", "r2"), "n_test")


_NM = ["mae_nonmetals", "rmse_nonmetals", "r2_nonmetals"]


@query("i2_nonzero_metrics", with_(PRED) + f"SELECT split, {_cols(_NM)} FROM pred GROUP BY 1")
def _(spark, sf):
    return _rounded(I.evaluate(D.predictions(spark, sf), ["split"]).select("split", *_NM), "split")


@query("i3_relative_errors", with_(PRED) + f"SELECT fold, {_cols(['mrae', 'mape'])} FROM pred GROUP BY 1")
def _(spark, sf):
    return _rounded(I.evaluate(D.predictions(spark, sf), ["fold"]).select("fold", "mrae", "mape"), "fold")


@query(
    "i4_divergence",
    with_(PRED)
    + f"""SELECT scale, max(abs(sp)) > 100 OR coalesce({_r2('y', 'sp')}, -1) < 0 AS diverged, {r6('max(abs(sp))')} AS max_abs_pred
    FROM (SELECT y, CASE scale WHEN 'huge' THEN y+p*10000 WHEN 'fair' THEN y+p/100 ELSE p END AS sp, scale FROM pred, (VALUES ('raw'),('huge'),('fair')) s(scale)) GROUP BY 1""",
)
def _(spark, sf):
    p, y = F.col("y_pred"), F.col("y_true")
    variants = {"raw": p, "huge": y + p * 10000, "fair": y + p / 100}
    scaled = D.predictions(spark, sf).select(
        "y_true", F.inline(F.array(*[F.struct(F.lit(n).alias("scale"), c.alias("y_pred")) for n, c in variants.items()]))
    )
    return I.evaluate(scaled, ["scale"]).select("scale", "diverged", six(F.col("max_abs_pred")).alias("max_abs_pred"))


_G = ["mae", "rmse", "r2", *_NM]


@query("i5_metrics_by_group", with_(PRED) + f"SELECT fold AS class, count(*)::BIGINT AS n_test, {_cols(_G)} FROM pred GROUP BY 1 HAVING count(*)>=5")
def _(spark, sf):
    return _rounded(I.evaluate_by_group(D.predictions(spark, sf), "fold").select("class", "n_test", *_G), "class", "n_test")


@query(
    "i6_metrics_by_attribute",
    with_(PRED) + f"SELECT p_type AS class, count(*)::BIGINT AS n_test, {_cols(_G)} FROM pred JOIN part ON l_partkey=p_partkey GROUP BY 1 HAVING count(*)>=5",
)
def _(spark, sf):
    from assayframe.operators.matching import backfill_attributes

    preds = D.predictions(spark, sf)
    attrs = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    ids = preds.select("l_partkey").distinct()
    known = backfill_attributes(ids, "l_partkey", ["p_type"], [attrs])
    out = I.evaluate_by_group(preds.join(known, "l_partkey", "left"), "p_type")
    return _rounded(out.select("class", "n_test", *_G), "class", "n_test")


_FS = f"fs AS (SELECT split, fold, seed, count(*)::BIGINT AS n_test, " + ", ".join(f"{e} AS {n}" for n, e in _metric_sql().items()) + " FROM pred GROUP BY 1,2,3)"


@query("i7_fold_seed_metrics", with_(PRED, _FS) + "SELECT split, fold, seed, n_test, " + ", ".join(f"{r6(m)} AS {m}" for m in _M) + " FROM fs")
def _(spark, sf):
    return _rounded(_fold_seed(spark, sf).select("split", "fold", "seed", "n_test", *_M), "split", "fold", "seed", "n_test")


def _fold_seed(spark, sf):
    return I.evaluate(D.predictions(spark, sf), ["split", "fold", "seed"])


@query(
    "i8_split_summary",
    with_(PRED, _FS) + "SELECT split, count(*)::BIGINT AS n_rows, "
    + ", ".join(f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_samp({m})')} AS {m}_std" for m in I.SUMMARY_METRICS) + " FROM fs GROUP BY 1",
)
def _(spark, sf):
    return _rounded(I.split_summary(_fold_seed(spark, sf)), "split", "n_rows")


@query(
    "i9_bootstrap_ci",
    with_(
        PRED, _FS,
        "v AS (SELECT split, mae, row_number() OVER (PARTITION BY split ORDER BY fold, seed)-1 AS i FROM fs)",
        "n AS (SELECT split, count(*) AS n FROM v GROUP BY 1)",
        "d AS (SELECT split, rep, ('0x'||substr(md5('42:'||split||':'||rep||':'||draw),1,8))::BIGINT % n AS i FROM n, range(1,2001) r(rep), LATERAL (SELECT unnest(range(1,n+1)) AS draw))",
        "m AS (SELECT d.split, rep, avg(mae) AS mean FROM d JOIN v ON v.split=d.split AND v.i=d.i GROUP BY 1,2)",
    )
    + f"SELECT m.split, any_value(n)::BIGINT AS n, {r6('quantile_cont(mean,0.025)')} AS ci_lo, {r6('quantile_cont(mean,0.975)')} AS ci_hi FROM m JOIN n ON n.split=m.split GROUP BY 1",
)
def _(spark, sf):
    return _rounded(I.bootstrap_ci(_fold_seed(spark, sf), "split", "mae", ["fold", "seed"]), "split", "n")


_ARM = """arm AS (SELECT l_linestatus AS model, CASE l_returnflag WHEN 'A' THEN 'full' WHEN 'N' THEN 'dedup' ELSE 'sizematched' END AS arm, l_linenumber AS seed,
 avg(abs(l_tax-l_discount)) AS mae FROM lineitem WHERE NOT (l_returnflag='N' AND l_linenumber=7) GROUP BY 1,2,3)"""


def _arm_results(spark, sf):
    flag = F.col("fold")
    arm = F.when(flag == "A", "full").when(flag == "N", "dedup").otherwise("sizematched")
    p = D.predictions(spark, sf).where(~((flag == "N") & (F.col("seed") == 7)))
    p = p.withColumn("arm", arm).withColumnRenamed("split", "model")
    return I.evaluate(p, ["model", "arm", "seed"])


@query(
    "i10_extrapolation_penalty",
    """WITH f AS (SELECT CASE l_returnflag WHEN 'A' THEN 'extrapolation' WHEN 'N' THEN 'inrange_control' ELSE 'random_control' END AS fold, l_linenumber AS seed,
    avg(abs(l_tax-l_discount)) AS mae FROM lineitem GROUP BY 1,2), m AS (SELECT fold, avg(mae) AS mean, stddev_samp(mae) AS std FROM f GROUP BY 1)
    """
    + f"""SELECT fold, {r6('mean')} AS mean, {r6('std')} AS std FROM m
    UNION ALL SELECT 'penalty_vs_inrange', {r6("(SELECT mean FROM m WHERE fold='extrapolation')-(SELECT mean FROM m WHERE fold='inrange_control')")}, NULL
    UNION ALL SELECT 'penalty_vs_random', {r6("(SELECT mean FROM m WHERE fold='extrapolation')-(SELECT mean FROM m WHERE fold='random_control')")}, NULL""",
)
def _(spark, sf):
    name = F.when(F.col("fold") == "A", "extrapolation").when(F.col("fold") == "N", "inrange_control").otherwise("random_control")
    fm = I.evaluate(D.predictions(spark, sf).withColumn("fold", name), ["fold", "seed"])
    return _rounded(I.extrapolation_penalty(fm), "fold")


@query(
    "i11_paired_deltas",
    with_(
        _ARM, "w AS (SELECT model, seed, max(CASE WHEN arm='full' THEN mae END) AS f, max(CASE WHEN arm='dedup' THEN mae END) AS d, max(CASE WHEN arm='sizematched' THEN mae END) AS s FROM arm GROUP BY 1,2)",
        "x AS (SELECT model, 'total' AS contrast, f-d AS v FROM w UNION ALL SELECT model, 'volume', f-s FROM w UNION ALL SELECT model, 'redundancy', s-d FROM w)",
    )
    + f"SELECT model, contrast, {r6('avg(v)')} AS mean_delta, {r6('stddev_samp(v)')} AS std_delta, count(v)::BIGINT AS n_seeds FROM x WHERE v IS NOT NULL GROUP BY 1,2",
)
def _(spark, sf):
    return _rounded(I.paired_deltas(_arm_results(spark, sf)), "model", "contrast", "n_seeds")


@query(
    "i12_nonredundant_mae",
    with_(PRED) + f"""SELECT split, fold, {r6('avg(abs(p-y))')} AS mae, {r6('avg(CASE WHEN s THEN abs(p-y) END)')} AS mae_test_nonredundant, sum(s::INT)::BIGINT AS n_survivors
    FROM (SELECT split, fold, p, y, min(l_orderkey) OVER (PARTITION BY l_partkey)=l_orderkey AS s FROM pred) GROUP BY 1,2""",
)
def _(spark, sf):
    # A line survives when it belongs to the first order of its part.
    preds = D.predictions(spark, sf)
    first = preds.groupBy("l_partkey").agg(F.min("l_orderkey").alias("_first"))
    flagged = preds.join(first, "l_partkey").withColumn("survivor", F.col("l_orderkey") == F.col("_first"))
    return _rounded(I.nonredundant_mae(flagged, ["split", "fold"], "survivor"), "split", "fold", "n_survivors")


@query(
    "i13_arm_table",
    with_(_ARM) + f"""SELECT model, arm, {r6('avg(mae)')} AS mae_mean, {r6('stddev_samp(mae)')} AS mae_std,
    CASE arm WHEN 'full' THEN 1 WHEN 'dedup' THEN 2 ELSE 3 END::BIGINT AS position FROM arm GROUP BY 1,2""",
)
def _(spark, sf):
    return _rounded(I.arm_table(_arm_results(spark, sf), ["mae"]), "model", "arm", "position")


@query(
    "i14_best_epoch",
    """SELECT user_id, (SELECT min(event_id) FROM events e WHERE e.user_id=u.user_id AND floor(e.value)=u.best) AS best_earliest,
    (SELECT max(event_id) FROM events e WHERE e.user_id=u.user_id AND floor(e.value)=u.best) AS best_latest FROM (SELECT user_id, min(floor(value)) AS best FROM events GROUP BY 1) u""",
)
def _(spark, sf):
    curves = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").alias("val_mae"))
    return I.best_epochs(curves, ["user_id"], "event_id", "val_mae").drop("best_value")


@query(
    "i15_long_curves",
    f"""WITH s AS (SELECT vec_id, unnest(range(1, len(embedding)+1)) AS step, embedding AS e FROM embeddings)
    SELECT vec_id, 'train' AS dataset, 'mae' AS metric, step::BIGINT AS step, {r6('e[step]::DOUBLE')} AS value FROM s
    UNION ALL SELECT vec_id, 'val', 'mae', step, {r6('e[len(e)+1-step]::DOUBLE')} FROM s""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("t"), F.reverse("embedding").alias("v"))
    out = I.long_curves(e, ["vec_id"], {("train", "mae"): "t", ("val", "mae"): "v"})
    return out.withColumn("value", six(F.col("value")))


@query(
    "i16_completeness_gate",
    with_(PRED, "have AS (SELECT DISTINCT split, fold FROM pred WHERE y > 0.095)")
    + """SELECT e.split, e.fold, h.fold IS NULL AS missing FROM (SELECT DISTINCT l_linestatus AS split, r.f AS fold FROM lineitem, (VALUES ('A'),('N'),('R'),('X')) r(f)) e
    LEFT JOIN have h ON h.split=e.split AND h.fold=e.fold WHERE h.fold IS NULL""",
)
def _(spark, sf):
    preds = D.predictions(spark, sf)
    expected = preds.select("split").distinct().select("split", F.explode(F.array(*[F.lit(x) for x in "ANRX"])).alias("fold"))
    results = I.evaluate(preds.where("y_true > 0.095"), ["split", "fold"])
    published, missing = I.publish_if_complete(expected, results, ["split", "fold"])
    if published is not None:
        raise AssertionError("fold X has no rows and must block publication")
    return missing.withColumn("missing", F.lit(True))


@query(
    "i17_extrapolation_reach",
    with_(PRED) + f"SELECT split AS benchmark, fold, {r6('avg(abs(p-y))')} AS mae, {r6('max(p)')} AS max_pred, {r6('min(y)')} AS min_test_label FROM pred GROUP BY 1,2",
)
def _(spark, sf):
    out = I.evaluate(
        D.predictions(spark, sf).withColumnRenamed("split", "benchmark"), ["benchmark", "fold"],
        extra=[F.max("y_pred").alias("max_pred"), F.min("y_true").alias("min_test_label")],
    )
    return _rounded(out.select("benchmark", "fold", "mae", "max_pred", "min_test_label"), "benchmark", "fold")


@query(
    "i18_dataset_comparison",
    with_(PRED, "u AS (SELECT 'raw' AS dataset, * FROM pred UNION ALL SELECT 'filtered', * FROM pred WHERE y > 0.03)")
    + f"""SELECT a.dataset, n_train, n_test, mae, rmse, r2, mape FROM (SELECT dataset, count(*)::BIGINT AS n_train FROM u WHERE fold<>'R' GROUP BY 1) a
    JOIN (SELECT dataset, count(*)::BIGINT AS n_test, {_cols(['mae', 'rmse', 'r2', 'mape'])} FROM u WHERE fold='R' GROUP BY 1) b ON a.dataset=b.dataset""",
)
def _(spark, sf):
    preds = D.predictions(spark, sf).withColumn("role", F.when(F.col("fold") == "R", "test").otherwise("train"))
    out = I.compare_datasets({"raw": preds, "filtered": preds.where("y_true > 0.03")})
    return _rounded(out, "dataset", "n_train", "n_test")


# ---- J: fitted models have no SQL twin -------------------------------------------------

_X = ["qty", "n_lines", "top_price", "low_disc", "sum_tax"]


def _model_rows(spark, sf):
    from assayframe.operators.splits import random_parts

    df = settle(D.order_features(spark, sf), "features").na.fill(0.0, _X)
    parts = random_parts(df.select("row_id")).withColumnRenamed("part", "role")
    return settle(J.assemble(df.join(parts, "row_id"), _X, ["row_id", "target", "role", "fold"]), "model-rows")


@query("j1_boosted_trees")
def _(spark, sf):
    pred, facts = J.boosted_trees(_model_rows(spark, sf), "target", _X, max_iter=8)
    out = I.evaluate(pred.withColumnRenamed("target", "y_true"), [])
    imp = J.importance_rows(spark, facts)
    return out.select(F.lit("mae").alias("name"), six(F.col("mae")).alias("value")).unionByName(
        imp.select(F.concat(F.lit("importance_"), "feature").alias("name"), six(F.col("importance")).alias("value"))
    )


@query("j1_tree_curves")
def _(spark, sf):
    _, facts = J.boosted_trees(_model_rows(spark, sf), "target", _X, max_iter=4, curves=True)
    return _rounded(J.curve_rows(spark, facts), "seed", "dataset", "n_trees", "metric")


@query("j2_fold_seed_sweep")
def _(spark, sf):
    rows = _model_rows(spark, sf).drop("role")
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    pred = J.sweep(rows, "target", _X, folds, [42, 43], max_iter=3, depth=3)
    return _rounded(I.evaluate(pred, ["fold", "seed"]).select("fold", "seed", "n_test", "mae", "rmse", "r2"), "fold", "seed", "n_test")


def _plain_rows(spark, sf, features):
    """Orders with plain feature columns (no gaps), part and fold."""
    from assayframe.operators.splits import random_parts

    df = D.order_features(spark, sf).select("row_id", "target", "fold", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    df = settle(df, "plain-features")
    parts = random_parts(df.select("row_id")).withColumnRenamed("part", "role")
    return settle(df.join(parts, "row_id"), "plain-rows")


@query("j3_grid_search")
def _(spark, sf):
    return _rounded(L.elastic_grid(_plain_rows(spark, sf, _X), "target", _X, (0.0, 0.1, 100.0, 10_000.0), (0.0, 0.5, 1.0)), "reg", "mix")


@query("j4_log_target")
def _(spark, sf):
    pred, _ = J.boosted_trees(_model_rows(spark, sf), "target", _X, max_iter=5, log_target=True)
    return _rounded(I.evaluate(pred.withColumnRenamed("target", "y_true"), []).select("n_test", "mae", "rmse", "r2"), "n_test")


# One-feature least squares, which SQL can fit as well. Errors are in the unit of the target and compared at three decimals.
_MX = """mx AS (SELECT o_orderkey AS row_id, o_totalprice AS y, o_orderpriority AS fold, coalesce(q, 0)::DOUBLE AS x FROM orders
 LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey)"""


def _three(e):
    return f"floor(({e})*1e3+0.5)/1e3"


def _errors_sql(p):
    return f"""count(*)::BIGINT AS n_test, {_three(f'avg(abs({p}-y))')} AS mae, {_three(f'sqrt(avg(({p}-y)*({p}-y)))')} AS rmse,
    {r6(f'1-sum(({p}-y)*({p}-y))/(var_pop(y)*count(*))')} AS r2"""


def _three_mae(out):
    return out.select("reg", "mix", (F.floor(F.col("val_mae") * 1e3 + 0.5) / 1e3).alias("val_mae"))


def _three_all(df, *keep):
    out = df.select(*keep, "n_test", *[(F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c) for c in ("mae", "rmse")], six(F.col("r2")).alias("r2"))
    return out


@query(
    "j2_least_squares_sweep",
    with_(
        _MX,
        """cr AS (SELECT f.fold AS f, s.seed AS seed, y, x, mx.fold=f.fold AS test, row_number() OVER (PARTITION BY f.fold, s.seed, mx.fold=f.fold
          ORDER BY md5(s.seed||':val/'||f.fold||':'||row_id), row_id) AS r, count(*) OVER (PARTITION BY f.fold, s.seed, mx.fold=f.fold) AS n
          FROM mx, (SELECT DISTINCT fold FROM mx) f, (VALUES (42),(43)) s(seed))""",
        "ft AS (SELECT f, seed, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM cr WHERE NOT test AND r > greatest(1, n//10) GROUP BY 1,2)",
    )
    + f"SELECT cr.f AS fold, cr.seed, {_errors_sql('(a+b*x)')} FROM cr JOIN ft ON ft.f=cr.f AND ft.seed=cr.seed WHERE test GROUP BY 1,2",
)
def _(spark, sf):
    pred, _ = L.elastic_sweep(_plain_rows(spark, sf, ["qty"]), "target", ["qty"], [42, 43], [(0.0, 0.0)])
    return _three_all(I.evaluate(pred, ["fold", "seed"]), "fold", "seed")


# Two-feature ridge and one-feature elastic net have closed forms: with standardised features and the penalty on them.
_M2 = """m2 AS (SELECT o_orderkey AS row_id, o_totalprice AS y, o_orderpriority AS fold, coalesce(q, 0)::DOUBLE AS x1, coalesce(n, 0)::DOUBLE AS x2 FROM orders
 LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey)"""


def _ridge_sql(src, keys, reg):
    """CTEs mo and ft (keys, a, b1, b2) of the ridge on x1 and x2."""
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""mo AS (SELECT {by}avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1,x2) AS c12, covar_pop(x1,y) AS c1y, covar_pop(x2,y) AS c2y FROM {src} {group}),
    st AS (SELECT *, c12/(s1*s2) AS r, c1y/s1 AS u1, c2y/s2 AS u2 FROM mo),
    pe AS (SELECT *, (1+reg)*(1+reg)-r*r AS det FROM st, (VALUES {reg}) g(reg)),
    co AS (SELECT *, ((1+reg)*u1-r*u2)/det/s1 AS b1, ((1+reg)*u2-r*u1)/det/s2 AS b2 FROM pe),
    ft AS (SELECT *, my-b1*m1-b2*m2 AS a FROM co)"""


@query(
    "j2_ridge_sweep",
    with_(
        _M2,
        """cr AS (SELECT f.fold AS f, s.seed AS seed, y, x1, x2, m2.fold=f.fold AS test, row_number() OVER (PARTITION BY f.fold, s.seed, m2.fold=f.fold
          ORDER BY md5(s.seed||':val/'||f.fold||':'||row_id), row_id) AS r, count(*) OVER (PARTITION BY f.fold, s.seed, m2.fold=f.fold) AS n
          FROM m2, (SELECT DISTINCT fold FROM m2) f, (VALUES (42),(43),(44)) s(seed))""",
        "tr AS (SELECT * FROM cr WHERE NOT test AND r > greatest(1, n//10))",
        _ridge_sql("tr", "f, seed", "(0.0e0),(0.5e0),(4.0e0)"),
    )
    + f"SELECT cr.f AS fold, cr.seed, reg, {_errors_sql('(a+b1*x1+b2*x2)')} FROM cr JOIN ft ON ft.f=cr.f AND ft.seed=cr.seed WHERE test GROUP BY 1,2,3",
)
def _(spark, sf):
    features = ["qty", "n_lines"]
    pred, _ = L.elastic_sweep(_plain_rows(spark, sf, features), "target", features, [42, 43, 44], [(0.0, 0.0), (0.5, 0.0), (4.0, 0.0)])
    return _three_all(I.evaluate(pred, ["fold", "seed", "reg"]), "fold", "seed", "reg")


_PX = with_(PARTS, _MX, "px AS (SELECT mx.*, part FROM mx JOIN parts ON parts.row_id=mx.row_id)")


@query(
    "j3_least_squares_grid",
    _PX + f""", ft AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM px WHERE part='train')
    SELECT 0e0 AS reg, mix, {_three('avg(abs(a+b*x-y))')} AS val_mae FROM px, ft, (VALUES (0e0),(0.5e0)) m(mix) WHERE part='val' GROUP BY mix""",
)
def _(spark, sf):
    return _three_mae(L.elastic_grid(_plain_rows(spark, sf, ["qty"]), "target", ["qty"], (0.0,), (0.0, 0.5)))


@query(
    "j3_ridge_grid",
    with_(PARTS, _M2, "px AS (SELECT m2.*, part FROM m2 JOIN parts ON parts.row_id=m2.row_id)", "tr AS (SELECT * FROM px WHERE part='train')", _ridge_sql("tr", "", "(0.1e0),(1.0e0),(25.0e0)"))
    + f"SELECT reg, 0e0 AS mix, {_three('avg(abs(a+b1*x1+b2*x2-y))')} AS val_mae FROM px, ft WHERE part='val' GROUP BY reg",
)
def _(spark, sf):
    features = ["qty", "n_lines"]
    return _three_mae(L.elastic_grid(_plain_rows(spark, sf, features), "target", features, (0.1, 1.0, 25.0), (0.0,)))


@query(
    "j3_elastic_grid",
    _PX + f""", mo AS (SELECT avg(y) AS my, avg(x) AS m, stddev_pop(x) AS s, covar_pop(x,y) AS c FROM px WHERE part='train'),
    co AS (SELECT *, sign(c/s)*greatest(abs(c/s)-reg*mix, 0)/(1+reg*(1-mix))/s AS b FROM mo, (VALUES (0.5e0),(1000e0),(1000000e0)) g(reg), (VALUES (0e0),(0.3e0),(1e0)) h(mix))
    SELECT reg, mix, {_three('avg(abs(my+b*(x-m)-y))')} AS val_mae FROM px, co WHERE part='val' GROUP BY 1, 2""",
)
def _(spark, sf):
    return _three_mae(L.elastic_grid(_plain_rows(spark, sf, ["qty"]), "target", ["qty"], (0.5, 1000.0, 1_000_000.0), (0.0, 0.3, 1.0)))


@query(
    "j4_least_squares_log",
    _PX + f""", ft AS (SELECT regr_slope(ln(1+y),x) AS b, regr_intercept(ln(1+y),x) AS a FROM px WHERE part='train')
    SELECT {_errors_sql('(exp(a+b*x)-1)')} FROM px, ft WHERE part='test'""",
)
def _(spark, sf):
    rows = J.assemble(_plain_rows(spark, sf, ["qty"]), ["qty"], ["row_id", "target", "role", "fold"])
    pred, _ = J.least_squares(rows, "target", ["qty"], log_target=True)
    return _three_all(I.evaluate(pred.withColumnRenamed("target", "y_true"), []))
