"""Queries D4-D12 (property features) and H (train-only preparation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.numeric import six
from assayframe.operators import prep as H
from assayframe.operators import properties as P
from assayframe.operators import sketches as Q
from assayframe.plans import standins as D
from assayframe.plans.registry import query
from assayframe.plans.standins import COMP, CP, PROPS, r6, with_
from assayframe.sources.session import settle


def _six_all(df, *keep):
    return df.select(*keep, *[six(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in keep])


def _blocks(spark, sf, *blocks):
    return _six_all(P.build_blocks(D.composition(spark, sf), D.properties(spark, sf), list(blocks)), "row_id")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "d4_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c})::BIGINT AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
        {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, {r6(f'quantile_cont({c},0.25)')} AS q25, {r6(f'quantile_cont({c},0.5)')} AS q50,
        {r6(f'quantile_cont({c},0.75)')} AS q75 FROM lineitem"""
        for c in _COLS
    ),
)
def _(spark, sf):
    return _six_all(P.describe_exact(D.table(spark, sf, "lineitem"), _COLS), "feature", "count")


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "d4_sketched_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, p::DOUBLE AS prob, (SELECT count({c}) FROM lineitem)::BIGINT AS n, true AS near FROM (VALUES {', '.join(f'({p})' for p in _PROBS)}) v(p)"
        for c in _COLS
    ),
)
def _(spark, sf):
    """Sketches of the table's parts by return flag, merged; and whether the ranks of their quantiles, counted in the table, are near enough."""
    lines = D.table(spark, sf, "lineitem")
    stored = settle(Q.sketched(lines, _COLS, "l_returnflag"), "sketches")
    asked = settle(Q.quantiles(Q.merged(stored), list(_PROBS)).select("feature", "prob", "n", "quantile"), "quantiles")
    limits = {(r["feature"], r["prob"]): r["quantile"] for r in asked.collect()}  # one row a feature and probability
    # the quantile is near if the share of smaller values and the share of values up to it reach around the probability
    shares = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(p).alias("prob"), F.avg((F.col(f) < F.lit(v)).cast("double")).alias("below"), F.avg((F.col(f) <= F.lit(v)).cast("double")).alias("upto")
        )
        for (f, p), v in limits.items()
    ]
    ranks = lines.agg(F.array(*shares).alias("s")).select(F.inline("s"))
    slack = 2 * Q.rank_error(800)
    near = (F.col("below") <= F.col("prob") + slack) & (F.col("upto") >= F.col("prob") - slack)
    return asked.join(ranks, ["feature", "prob"]).select("feature", "prob", "n", near.alias("near"))


def _wmean(p):
    return f"sum(CASE WHEN {p} IS NOT NULL THEN amount*{p} END)/sum(CASE WHEN {p} IS NOT NULL THEN amount END)"


@query("d5_weighted_mean", with_(COMP, PROPS, CP) + f"SELECT row_id, {r6(_wmean('size'))} AS size_mean FROM cp GROUP BY 1")
def _(spark, sf):
    return _blocks(spark, sf, P.mean_block(["size"]))


def _stats(p):
    return (
        f"{r6(_wmean(p))} AS {p}_mean, {r6(f'min({p})')} AS {p}_min, {r6(f'max({p})')} AS {p}_max, {r6(f'max({p})-min({p})')} AS {p}_range"
    )


@query("d6_property_stats", with_(COMP, PROPS, CP) + f"SELECT row_id, {_stats('size')}, {_stats('price')} FROM cp GROUP BY 1")
def _(spark, sf):
    return _blocks(spark, sf, P.stats_block(["size", "price"]))


_MANY = ["size", "price", "valence", "chi", "ie", "ea", "polarizability", "z", "f_flag"]


@query(
    "d7_element_means",
    with_(COMP, PROPS, CP) + "SELECT row_id, " + ", ".join(f"{r6(_wmean(p))} AS mean_{p}" for p in _MANY) + " FROM cp GROUP BY 1",
)
def _(spark, sf):
    return _blocks(spark, sf, P.mean_block(_MANY, prefix="mean_", suffix=""))


_LIT = dict(
    avg_dev=["chi", "ie"], std_dev=["z"], mean=["ea"], maximum=["chi"],
    shares={"frac_p_valence": ("valence", "z")}, totals={"total_e": "z"},
)
_LIT_SQL = """lm AS (SELECT row_id, sum(amount) AS w, sum(amount*chi) AS schi, sum(amount*ie) AS sie, sum(amount*z) AS sz,
 count(*) AS k, least(count(chi),count(ie),count(ea),count(valence),count(z)) AS ok FROM cp GROUP BY 1)"""


def _lit(e):
    return r6(f"CASE WHEN any_value(ok)=any_value(k) THEN {e} END")


_LIT_COLS = f"""{_lit('sum(amount*abs(w*chi-schi))/(any_value(w)*any_value(w))')} AS avg_dev_chi, {_lit('sum(amount*abs(w*ie-sie))/(any_value(w)*any_value(w))')} AS avg_dev_ie,
 {_lit('sqrt(sum(amount*((w*z-sz)*(w*z-sz))))/(any_value(w)*sqrt(any_value(w)))')} AS std_dev_z, {_lit('sum(amount*ea)/any_value(w)')} AS mean_ea, {_lit('max(chi)')} AS maximum_chi,
 {_lit('sum(amount*valence)/sum(amount*z)')} AS frac_p_valence, {_lit('sum(amount*z)')} AS total_e"""


@query(
    "d8_literature_block",
    with_(COMP, PROPS, CP, _LIT_SQL) + f"SELECT cp.row_id, {_LIT_COLS} FROM cp JOIN lm ON lm.row_id=cp.row_id GROUP BY 1",
)
def _(spark, sf):
    return _blocks(spark, sf, P.literature_block(**_LIT))


_PHYS_SQL = {
    "phys_parity_odd": "round_even(sum(coalesce(amount*valence,0)),0) % 2",
    "phys_vec_per_atom": "sum(coalesce(amount*valence,0))/sum(amount)",
    "phys_dist_octet": "abs(sum(coalesce(amount*valence,0))/sum(amount)-8)",
    "phys_dist_18e": "abs(sum(coalesce(amount*valence,0))/sum(amount)-18)",
    "phys_max_dchi": "CASE WHEN count(*)=1 THEN 0 ELSE max(chi)-min(chi) END",
    "phys_mulliken_chi": "sum(coalesce(amount*(ie+ea)/2,0))/sum(amount)",
    "phys_mean_polarizability": "CASE WHEN count(polarizability)=count(*) THEN sum(amount*polarizability)/sum(amount) END",
    "phys_f_fraction": "sum(amount*f_flag)/sum(amount)",
    "phys_mean_Z": "sum(amount*z)/sum(amount)",
}
_ALT_SQL = {
    "phys_hardness_min": "CASE WHEN count((ie-ea)/2)=count(*) THEN min((ie-ea)/2) END",
    "phys_frac_multivalent": "sum(amount*(CASE WHEN len(list_filter(states, lambda s: s>0))>=2 THEN 1 ELSE 0 END))/sum(amount)",
    "phys_oxstate_span": "sum(amount*coalesce(list_max(states)-list_min(states),0))/sum(amount)",
}


def _phys(name, cols):
    sql = with_(COMP, PROPS, CP) + "SELECT row_id, " + ", ".join(f"{r6(_PHYS_SQL[c])} AS {c}" for c in cols) + " FROM cp GROUP BY 1"

    @query(name, sql)
    def _(spark, sf):
        return _blocks(spark, sf, P.physics_block()).select("row_id", *cols)


_phys("d9a_parity", ["phys_parity_odd"])
_phys("d9b_valence_distance", ["phys_vec_per_atom", "phys_dist_octet", "phys_dist_18e"])
_phys("d9c_chi_spread", ["phys_max_dchi"])
_phys("d9d_mulliken", ["phys_mulliken_chi"])
_phys("d9e_polarizability", ["phys_mean_polarizability"])
_phys("d9f_relativity", ["phys_f_fraction", "phys_mean_Z"])


@query("d10a_hardness", with_(COMP, PROPS, CP) + f"SELECT row_id, {r6(_ALT_SQL['phys_hardness_min'])} AS phys_hardness_min FROM cp GROUP BY 1")
def _(spark, sf):
    return _blocks(spark, sf, P.alt_physics_block()).select("row_id", "phys_hardness_min")


@query(
    "d10b_multivalence",
    with_(COMP, PROPS, CP) + "SELECT row_id, " + ", ".join(f"{r6(_ALT_SQL[c])} AS {c}" for c in ("phys_frac_multivalent", "phys_oxstate_span")) + " FROM cp GROUP BY 1",
)
def _(spark, sf):
    return _blocks(spark, sf, P.alt_physics_block()).select("row_id", "phys_frac_multivalent", "phys_oxstate_span")


def _fracs(lo, hi):
    return ", ".join(r6(f"sum(CASE WHEN {D.NUM}={i} THEN amount ELSE 0 END)/sum(amount)").replace("element", "cp.element") + f" AS b{i}" for i in range(lo, hi))


def _tier_blocks():
    return {
        "fractions": P.fraction_block(D.BRANDS),
        "literature": P.literature_block(**_LIT),
        "physics": P.physics_block(),
        "alt": P.alt_physics_block(),
    }


@query(
    "d11_physics_tier",
    with_(COMP, PROPS, CP, _LIT_SQL)
    + f"SELECT cp.row_id, {_fracs(1, 26)}, {_LIT_COLS}, "
    + ", ".join(f"{r6(e)} AS {c}" for c, e in _PHYS_SQL.items())
    + " FROM cp JOIN lm ON lm.row_id=cp.row_id GROUP BY 1",
)
def _(spark, sf):
    out = P.build_tier(D.composition(spark, sf), D.properties(spark, sf), "physics", _tier_blocks())
    return _six_all(out.withColumnsRenamed({b: b.replace("Brand#", "b") for b in D.BRANDS}), "row_id")


@query(
    "d11_alt_tier",
    with_(COMP, PROPS, CP, _LIT_SQL)
    + f"SELECT cp.row_id, {_fracs(1, 26)}, {_LIT_COLS}, "
    + ", ".join(f"{r6(e)} AS {c}" for c, e in _ALT_SQL.items())
    + " FROM cp JOIN lm ON lm.row_id=cp.row_id GROUP BY 1",
)
def _(spark, sf):
    out = P.build_tier(D.composition(spark, sf), D.properties(spark, sf), "physics-alt", _tier_blocks())
    return _six_all(out.withColumnsRenamed({b: b.replace("Brand#", "b") for b in D.BRANDS}), "row_id")


@query(
    "d12_nonzero_features",
    "WITH comp AS (SELECT l_orderkey AS row_id, p_brand AS element, sum(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_discount>0 GROUP BY 1,2), "
    "cp AS (SELECT * FROM comp) SELECT row_id, " + _fracs(1, 26) + " FROM cp GROUP BY 1",
)
def _(spark, sf):
    from assayframe.operators.composition import fraction_matrix, vocabulary
    from assayframe.operators.filters import nonzero_target

    lines = nonzero_target(D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount"), "l_discount")
    parts = D.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("b"), D.suffix(F.col("p_brand")).cast("string")).alias("element"))
    comp = lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("row_id"), "element").agg(F.sum("l_quantity").alias("amount"))
    comp = settle(comp, "comp")
    vocab = sorted(r[0] for r in vocabulary(comp).collect())  # the columns of the result
    return _six_all(fraction_matrix(comp, vocab), "row_id")


# ---- H ---------------------------------------------------------------------------

_FEAT = """ag AS (SELECT l_orderkey AS row_id, sum(l_quantity) AS qty, count(*)::DOUBLE AS n_lines, max(l_extendedprice) AS top_price, min(l_discount) AS low_disc,
 sum(l_tax) AS sum_tax, sum(l_quantity)*2 AS twice, max(CASE WHEN l_returnflag='A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS O, 0.0::DOUBLE AS Fe FROM lineitem GROUP BY 1),
feat AS (SELECT o_orderkey AS row_id, o_totalprice AS target, o_orderpriority AS fold, qty, n_lines, top_price, low_disc, sum_tax, twice, 3.0::DOUBLE AS flat, O, Fe
 FROM orders LEFT JOIN ag ON row_id=o_orderkey)"""


def _imputed(where=""):
    cols = ", ".join(f"coalesce({f}, (SELECT median({f}) FROM feat {where})) AS {f}" for f in D.FEATURES)
    return f"imp AS (SELECT row_id, target, fold, {cols} FROM feat)"


@query(
    "h1_median_impute",
    with_(_FEAT, _imputed()) + "SELECT row_id, " + ", ".join(f"{r6(f)} AS {f}" for f in D.FEATURES) + " FROM imp",
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    med = {r["feature"]: r["quantile"] for r in H.medians(df, D.FEATURES).collect()}
    return df.select("row_id", *[six(F.coalesce(H.number(f), F.lit(med[f]))).alias(f) for f in D.FEATURES])


def _stat_rows(select):
    return " UNION ALL ".join(select(f) for f in D.FEATURES)


@query(
    "h2_zero_variance",
    with_(_FEAT, _imputed())
    + _stat_rows(lambda f: f"SELECT '{f}' AS feature, max({f})>min({f}) OR '{f}' IN ('O','Fe') AS kept, CASE WHEN NOT(max({f})>min({f}) OR '{f}' IN ('O','Fe')) THEN 'zero variance' END AS reason FROM imp"),
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    # A limit no correlation exceeds leaves the variance rule alone.
    got = H.fit(df, D.FEATURES, "target", limit=2.0, names=D.FEATURES)
    return H.stats_table(spark, {"all": got}).select("feature", "kept", "reason")


@query(
    "h3_correlated_dropped",
    # twice is an exact multiple of qty: the tie drops the later one; no other pair passes the limit.
    with_(_FEAT, _imputed(), "c AS (SELECT abs(corr(qty,twice)) AS same, abs(corr(qty,n_lines)) AS near, abs(corr(qty,target)) AS tq, abs(corr(n_lines,target)) AS tn, abs(corr(qty,sum_tax)) AS qs, abs(corr(n_lines,sum_tax)) AS ns, abs(corr(qty,top_price)) AS qp FROM imp)")
    + "SELECT 'twice' AS feature, 'correlated' AS reason FROM c WHERE same > 0.95 AND near <= 0.95 AND qs <= 0.95 AND ns <= 0.95 AND qp <= 0.95",
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    got = H.fit(df, D.FEATURES, "target", names=D.FEATURES)
    return H.stats_table(spark, {"all": got}).where("reason = 'correlated'").select("feature", "reason")


# Three copies of one column, one of them protected, a near copy, and two others.
_PRUNED = ["qty", "twice", "O", "near_qty", "n_lines", "top_price"]


@query(
    "h3_pruning_scan",
    with_(
        _FEAT.replace("max(CASE WHEN l_returnflag='A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS O", "sum(l_quantity)*3 AS O, sum(l_quantity)+count(*)*0.5e0 AS near_qty").replace("flat, O, Fe", "flat, O, near_qty"),
        "imp AS (SELECT target, " + ", ".join(f"coalesce({f}, (SELECT median({f}) FROM feat))::DOUBLE AS {f}" for f in _PRUNED) + " FROM feat)",
        "cr AS (" + " UNION ALL ".join(
            f"SELECT {i} AS i, {j} AS j, round(abs(corr({f}, {g})), 9) AS r FROM imp" for i, f in enumerate(_PRUNED) for j, g in enumerate(_PRUNED) if i < j
        ) + ")",
        "tg AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {f == 'O'} AS safe, round(abs(corr({f}, target)), 9) AS t FROM imp" for i, f in enumerate(_PRUNED)) + ")",
        "pr AS (SELECT cr.i, cr.j, x.safe AS si, y.safe AS sj, x.t AS ti, y.t AS tj, row_number() OVER (ORDER BY cr.i, cr.j) AS rn FROM cr JOIN tg x ON x.i=cr.i JOIN tg y ON y.i=cr.j WHERE r > 0.95)",
        """sc AS (SELECT 0::BIGINT AS rn, []::INT[] AS gone UNION ALL SELECT pr.rn, CASE WHEN list_contains(gone, pr.i) OR list_contains(gone, pr.j) OR (si AND sj) THEN gone
          WHEN NOT sj AND (si OR tj <= ti) THEN list_append(gone, pr.j) ELSE list_append(gone, pr.i) END FROM sc JOIN pr ON pr.rn = sc.rn + 1)""",
        recursive=True,
    )
    + "SELECT feature, list_contains(gone, i) AS dropped FROM (SELECT gone FROM sc ORDER BY rn DESC LIMIT 1), (VALUES "
    + ", ".join(f"({i}, '{f}')" for i, f in enumerate(_PRUNED)) + ") n(i, feature)",
)
def _(spark, sf):
    df = D.order_features(spark, sf).withColumn("O", F.col("qty") * 3).withColumn("near_qty", F.col("qty") + F.col("n_lines") * 0.5)
    got = H.fit(settle(df, "features"), _PRUNED, "target", names=_PRUNED)
    return H.stats_table(spark, {"all": got}).select("feature", (~F.col("kept")).alias("dropped"))


@query(
    "h4_protected_columns",
    with_(_FEAT, _imputed())
    + _stat_rows(lambda f: f"SELECT '{f}' AS feature, '{f}' IN ('O','Fe') AS protected, max({f})>min({f}) OR '{f}' IN ('O','Fe') AS kept_by_name, max({f})>min({f}) AS kept_without_names FROM imp"),
)
def _(spark, sf):
    # Protection shows in what the variance rule keeps when the columns have names and when they have none.
    df = settle(D.order_features(spark, sf), "features")
    safe = H.protected_columns(D.FEATURES)
    named, bare = (H.fit(df, D.FEATURES, "target", limit=2.0, names=names) for names in (D.FEATURES, None))
    rows = [(f, f in safe, f in named.kept, f in bare.kept) for f in D.FEATURES]
    return spark.createDataFrame(rows, "feature string, protected boolean, kept_by_name boolean, kept_without_names boolean")


_KEPT = ["qty", "n_lines", "top_price", "low_disc", "sum_tax", "O", "Fe"]


@query(
    "h5_scale_stats",
    with_(_FEAT, _imputed())
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r6(f'avg({f})')} AS mean, {r6(f'CASE WHEN max({f})>min({f}) THEN stddev_pop({f}) ELSE 1 END')} AS scale FROM imp" for f in _KEPT
    ),
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    got = H.fit(df, D.FEATURES, "target", names=D.FEATURES)
    return H.stats_table(spark, {"all": got}).where("kept").select("feature", six(F.col("mean")).alias("mean"), six(F.col("scale")).alias("scale"))


@query(
    "h6_prepared_features",
    with_(_FEAT, _imputed(), "st AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN max({f})>min({f}) THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in _KEPT) + " FROM imp)")
    + "SELECT row_id, " + ", ".join(f"{r6(f'({f}-m_{f})/s_{f}')} AS {f}" for f in _KEPT) + " FROM imp, st",
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    return _six_all(H.fit(df, D.FEATURES, "target", names=D.FEATURES).transform(df, ["row_id"]), "row_id")


@query(
    "h7_fold_stats",
    with_(_FEAT, "fl AS (SELECT DISTINCT fold AS f FROM feat)")
    + " UNION ALL ".join(
        f"""SELECT fold, '{f}' AS feature, {r6('any_value(med)')} AS median, {r6('avg(v)')} AS mean, {r6('CASE WHEN max(v)>min(v) THEN stddev_pop(v) ELSE 1 END')} AS scale FROM
        (SELECT m.f AS fold, med, coalesce({f}, med) AS v FROM (SELECT f, median({f}) AS med FROM feat, fl WHERE fold<>f GROUP BY 1) m JOIN feat ON feat.fold<>m.f) GROUP BY 1"""
        for f in _KEPT
    ),
)
def _(spark, sf):
    df = settle(D.order_features(spark, sf), "features")
    labels = sorted(r[0] for r in df.select("fold").distinct().collect())
    got = H.fit_folds(df, D.FEATURES, "target", "fold", labels, names=D.FEATURES)
    t = H.stats_table(spark, got).where("kept")
    return t.select("fold", "feature", *[six(F.col(c)).alias(c) for c in ("median", "mean", "scale")])
