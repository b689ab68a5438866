"""Queries G (split constructors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import composition as C
from assayframe.operators import splits as S
from assayframe.plans import standins as D
from assayframe.plans import suite
from assayframe.plans.q_composition import brand_groups
from assayframe.plans.q_sources import PARTS
from assayframe.plans.registry import query
from assayframe.plans.standins import CAT, COMP, table, with_
from assayframe.sources.session import settle


def md5_rank(label, part=""):
    return f"row_number() OVER ({part} ORDER BY md5('42:{label}:'||row_id), row_id)"


@query("g1_random_parts", with_(PARTS) + "SELECT row_id, part FROM parts")
def _(spark, sf):
    return S.random_parts(D.order_rows(spark, sf).select("row_id")).select("row_id", "part")


_STRATA = f"""rows0 AS (SELECT row_id, CASE WHEN category='multi' THEN 'Others' ELSE category END AS stratum FROM cat),
c AS (SELECT stratum, count(*) AS c, sum(count(*)) OVER ()::BIGINT AS n FROM rows0 GROUP BY 1),
c1 AS (SELECT *, n-ceil(0.1e0*n)::BIGINT AS n_train FROM c),
c2 AS (SELECT *, c*n_train//n AS base, c*n_train%n AS rem FROM c1),
c3 AS (SELECT *, base + (row_number() OVER (ORDER BY rem DESC, stratum) <= n_train - sum(base) OVER ())::INT AS q_train FROM c2),
st AS (SELECT stratum, c, n_train, q_train, c-q_train AS q_test FROM c3),
ranked AS (SELECT rows0.row_id, rows0.stratum, q_test, q_train, n_train, {md5_rank('stratified', 'PARTITION BY rows0.stratum').replace('row_id', 'rows0.row_id')} AS r FROM rows0 JOIN st ON st.stratum=rows0.stratum)"""


def _strata(spark, sf):
    cat = settle(C.categories(D.composition(spark, sf), D.CATEGORY_BRANDS), "categories")
    return cat.select("row_id", S.stratum_of(F.col("category")).alias("stratum"))


@query("g2_stratified_holdout", with_(COMP, CAT, _STRATA) + "SELECT row_id, stratum, r<=q_test AS is_test FROM ranked")
def _(spark, sf):
    return S.stratified_holdout(_strata(spark, sf))


@query(
    "g3_data_efficiency",
    with_(
        COMP, CAT, _STRATA,
        "fr AS (SELECT * FROM (VALUES ('10pct',0.1e0),('25pct',0.25e0),('50pct',0.5e0)) f(fold, f))",
        "s1 AS (SELECT fold, stratum, q_train, n_train, floor(f*n_train)::BIGINT AS size FROM st, fr)",
        "s2 AS (SELECT *, q_train*size//n_train AS base, q_train*size%n_train AS rem FROM s1)",
        "s3 AS (SELECT fold, stratum, base + (row_number() OVER (PARTITION BY fold ORDER BY rem DESC, stratum) <= size - sum(base) OVER (PARTITION BY fold))::INT AS q FROM s2)",
        "al AS (SELECT * FROM s3 UNION ALL SELECT '100pct', stratum, q_train FROM st)",
    )
    + "SELECT 'data_efficiency' AS split, fold, CASE WHEN r<=q_test THEN 'test' ELSE 'train' END AS role, row_id FROM ranked JOIN al ON al.stratum=ranked.stratum WHERE r<=q_test+q",
)
def _(spark, sf):
    return S.data_efficiency(_strata(spark, sf))


@query(
    "g4_leave_one_category_out",
    with_(COMP, CAT, "f AS (SELECT DISTINCT category AS fold FROM cat WHERE category NOT IN ('multi','Others'))")
    + "SELECT 'lomo' AS split, fold, CASE WHEN category=fold THEN 'test' ELSE 'train' END AS role, row_id FROM cat, f",
)
def _(spark, sf):
    cat = settle(C.categories(D.composition(spark, sf), D.CATEGORY_BRANDS), "categories")
    return S.expand_folds(S.leave_one_category_out(cat), "lomo")


_SYS = "sys AS (SELECT row_id, string_agg(element,'-' ORDER BY element) AS grp FROM comp GROUP BY 1)"


def _dealt_sql(k, src):
    return f"""gs AS (SELECT grp, count(*) AS size FROM {src} GROUP BY 1),
    gr AS (SELECT grp, row_number() OVER (ORDER BY size DESC, md5(grp), grp)-1 AS r FROM gs),
    gk AS (SELECT least({k}, count(*)) AS k FROM gs),
    gf AS (SELECT grp, (CASE WHEN (r//k)%2=0 THEN r%k ELSE k-1-r%k END)::VARCHAR AS fold FROM gr, gk)"""


@query("g5_chemical_system_folds", with_(COMP, _SYS, _dealt_sql(10, "sys")) + "SELECT row_id, fold FROM sys JOIN gf ON gf.grp=sys.grp")
def _(spark, sf):
    rows = settle(C.element_set_key(D.composition(spark, sf)), "systems")
    return S.chemical_system_folds(rows)[0]


_GRP = f"mem AS (SELECT DISTINCT row_id, 'g'||({D.NUM} % 4) AS g FROM comp), grps AS (SELECT row_id, string_agg(g,'-' ORDER BY g) AS grp FROM mem GROUP BY 1)"


@query("g6_periodic_group_folds", with_(COMP, _GRP, _dealt_sql(10, "grps")) + "SELECT row_id, fold FROM grps JOIN gf ON gf.grp=grps.grp")
def _(spark, sf):
    rows = settle(C.element_groups(D.composition(spark, sf), brand_groups(spark, sf)), "groups")
    return S.group_kfold(rows, "groups", 10, deal=True)[0]


@query(
    "g6_any_member_holdout",
    with_(COMP, _GRP, "f AS (SELECT DISTINCT g AS fold FROM mem)")
    + "SELECT 'periodic_group' AS split, fold, CASE WHEN mem.g IS NULL THEN 'train' ELSE 'test' END AS role, grps.row_id FROM grps CROSS JOIN f LEFT JOIN mem ON mem.row_id=grps.row_id AND mem.g=f.fold",
)
def _(spark, sf):
    members = D.composition(spark, sf).join(brand_groups(spark, sf), "element").select("row_id", "grp").distinct()
    return S.member_holdout(settle(members, "members"))


@query(
    "g7_crystal_system_folds",
    """WITH g AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority)-1 AS f FROM orders GROUP BY 1)
    SELECT o_orderkey AS row_id, f::VARCHAR AS fold FROM orders JOIN g ON p=o_orderpriority""",
)
def _(spark, sf):
    return S.crystal_system_folds(D.order_rows(spark, sf), "attribute")[0]


EXT = f"""o AS (SELECT o_orderkey AS row_id, o_totalprice::FLOAT >= 450000::FLOAT AS wide FROM orders),
w AS (SELECT count(*) AS n FROM o WHERE wide),
rc AS (SELECT row_id, wide, {md5_rank('random_control')} AS r, {md5_rank('inrange_control', 'PARTITION BY wide')} AS h FROM o)"""


@query(
    "g8_range_extrapolation",
    with_(EXT)
    + """SELECT 'extrapolation' AS split, fold, CASE WHEN t THEN 'test' ELSE 'train' END AS role, row_id FROM (
    SELECT row_id, 'extrapolation' AS fold, wide AS t FROM rc UNION ALL SELECT row_id, 'random_control', r<=n FROM rc, w
    UNION ALL SELECT row_id, 'inrange_control', wide AND h>n//2 FROM rc, w)""",
)
def _(spark, sf):
    return S.range_extrapolation(D.order_rows(spark, sf), "target", 450000.0)


_K, _STEPS = 8, 10


def _cluster_sql(src, p, k=_K, steps=_STEPS, seed=42):
    """CTEs up to lab(row_id, j, far): seeding races and centre steps over src(row_id, v), spelled out round by round."""
    d = lambda c: f"list_sum(list_transform(range(1,{p + 1}), lambda i: (z[i]-{c}[i])*(z[i]-{c}[i])))::BIGINT"
    u = lambda r: f"((('0x'||md5('{seed}:centre/{r}:'||row_id)[1:8])::BIGINT::DOUBLE + 0.5e0)/4294967296e0)"
    out = [
        f"q AS MATERIALIZED (SELECT row_id, list_transform(v, lambda x: floor(x::DOUBLE/1e-6+0.5e0)::BIGINT) AS q FROM {src})",
        "e AS (SELECT row_id, i, q[i] AS x FROM q, range(1, %d) r(i))" % (p + 1),
        """m AS (SELECT i, sum(x)::HUGEINT::DOUBLE/count(*) AS m, sqrt((count(*)*sum(x::HUGEINT*x)::HUGEINT-sum(x)::HUGEINT*sum(x)::HUGEINT)::DOUBLE)/count(*) AS s FROM e GROUP BY i)""",
        f"z AS MATERIALIZED (SELECT row_id, list(CASE WHEN s>0 THEN floor((x-m)/s*65536+0.5e0)::BIGINT ELSE 0 END ORDER BY e.i) AS z FROM e JOIN m ON e.i=m.i GROUP BY row_id)",
        f"w0 AS MATERIALIZED (SELECT arg_min(z, {{'k': -ln({u(0)}), 'r': row_id}}) AS c FROM z)",
        f"n0 AS MATERIALIZED (SELECT row_id, z, {d('c')} AS far FROM z, w0)",
    ]
    for r in range(1, k):
        out.append(f"w{r} AS MATERIALIZED (SELECT arg_min(z, {{'k': -ln({u(r)})/far::DOUBLE, 'r': row_id}}) AS c FROM n{r - 1} WHERE far>0)")
        out.append(f"n{r} AS MATERIALIZED (SELECT row_id, z, least(far, {d('c')}) AS far FROM n{r - 1}, w{r})")
    out.append("c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {r} AS j, c FROM w{r}" for r in range(k)) + ")")
    for s in range(steps + 1):
        out.append(f"a{s} AS MATERIALIZED (SELECT row_id, z, arg_min(j, {{'d': {d('c')}, 'j': j}}) AS j FROM z, c{s} GROUP BY row_id, z)")
        if s < steps:
            mean = f"SELECT j, list(floor(t/n)::BIGINT ORDER BY i) AS c FROM (SELECT j, i, sum(z[i])::HUGEINT AS t, count(*) AS n FROM a{s}, range(1, {p + 1}) r(i) GROUP BY 1, 2) GROUP BY j"
            out.append(f"c{s + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{s} c LEFT JOIN ({mean}) n ON n.j=c.j)")
    out.append(f"fc AS (SELECT arg_max(j, {{'d': list_sum(list_transform(c, lambda x: x*x))::BIGINT, 'j': -j}}) AS far FROM c{steps})")
    out.append(f"lab AS (SELECT row_id, j, far FROM a{steps}, fc)")
    return ",\n".join(out)


@query(
    "g9_feature_holdout",
    with_("src AS (SELECT vec_id AS row_id, embedding AS v FROM embeddings)", _cluster_sql("src", 64))
    + "SELECT row_id, j=far AS is_test FROM lab WHERE (SELECT count(*) FROM lab WHERE j=far) >= 30",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    out = S.feature_holdout(e, "embedding", _K, steps=_STEPS)
    return spark.createDataFrame([], "row_id long, is_test boolean") if out is None else out


def _carve_sql(rule, take):
    return f"""SELECT '{rule}' AS rule, x.fold, x.row_id, r <= take AS is_val FROM (SELECT fold, row_id, row_number() OVER (PARTITION BY fold ORDER BY md5('42:val/'||fold||':'||row_id), row_id) AS r FROM tr) x
    JOIN (SELECT fold, least(n, {take}) AS take FROM (SELECT fold, count(*) AS n FROM tr GROUP BY 1)) q ON q.fold=x.fold"""


@query(
    "g10_validation_carve",
    "WITH tr AS (SELECT o_orderkey AS row_id, o_orderpriority AS fold FROM orders) "
    + " UNION ALL ".join(
        [
            _carve_sql("checkpoint", "CASE WHEN round_even(n*0.1e0,0)>=2 AND n-round_even(n*0.1e0,0)>=2 THEN round_even(n*0.1e0,0) ELSE 0 END"),
            _carve_sql("arm", "greatest(round_even(n*0.1e0,0),1)"),
            _carve_sql("bounded", "greatest(least(n//10,2000),32)"),
            _carve_sql("tree", "greatest(n//10,1)"),
        ]
    ),
)
def _(spark, sf):
    train = D.order_rows(spark, sf).select("row_id", F.col("attribute").alias("fold"))
    return S.carve_validations(train, list(S.VALIDATION_RULES))


@query(
    "g11_named_folds",
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus='P' THEN o_custkey::VARCHAR ELSE o_orderpriority END AS fold FROM orders",
)
def _(spark, sf):
    rows = D.order_rows(spark, sf).withColumn("label", F.when(F.col("status") != "P", F.col("attribute")))
    return S.named_folds(rows, "label", "cust").select("row_id", "fold")


def suite_rows(spark, sf):
    comp = settle(D.composition(spark, sf), "comp")
    cat = C.categories(comp, D.CATEGORY_BRANDS)
    rows = cat.join(C.element_set_key(comp), "row_id").join(C.element_groups(comp, brand_groups(spark, sf)), "row_id")
    return settle(rows.join(D.order_rows(spark, sf).select("row_id", "target", "attribute"), "row_id"), "suite-rows")


_SUITE_EXT = EXT.replace("FROM orders)", "FROM orders WHERE o_orderkey IN (SELECT row_id FROM comp))")


def _kfold_counts(split, fold_cte, source):
    return f"""SELECT '{split}' AS split, fold, (SELECT count(*) FROM {source})-count(*) AS n_train, count(*) AS n_test FROM {source} x JOIN {fold_cte} y ON y.grp=x.grp GROUP BY 2"""


@query(
    "g12_suite_manifest",
    with_(
        COMP, CAT, _STRATA, _SYS, _GRP,
        _dealt_sql(10, "sys").replace("gs AS", "cs_gs AS").replace("FROM gs", "FROM cs_gs").replace("gr AS", "cs_gr AS").replace("FROM gr", "FROM cs_gr").replace("gk AS", "cs_gk AS").replace(", gk", ", cs_gk").replace("gf AS", "cs_gf AS"),
        _dealt_sql(10, "grps"), _SUITE_EXT,
        "f AS (SELECT DISTINCT category AS fold FROM cat WHERE category NOT IN ('multi','Others'))",
        "pr AS (SELECT row_id, o_orderpriority AS p FROM cat JOIN orders ON o_orderkey=row_id)",
        "fr AS (SELECT * FROM (VALUES ('10pct',0.1e0),('25pct',0.25e0),('50pct',0.5e0),('100pct',1e0)) f(fold, f))",
        "tt AS (SELECT sum(q_test)::BIGINT AS n_test, sum(q_train)::BIGINT AS n_train FROM st)",
        f"""m AS (SELECT 'random' AS split, '0' AS fold, n_train, n_test FROM tt
        UNION ALL SELECT 'lomo', fold, sum((category<>fold)::INT), sum((category=fold)::INT) FROM cat, f GROUP BY 2
        UNION ALL {_kfold_counts('chemical_system', 'cs_gf', 'sys')}
        UNION ALL {_kfold_counts('periodic_group', 'gf', 'grps')}
        UNION ALL SELECT 'crystal_system', (row_number() OVER (ORDER BY count(*) DESC, p)-1)::VARCHAR, (SELECT count(*) FROM pr)-count(*), count(*) FROM pr GROUP BY p
        UNION ALL SELECT 'data_efficiency', fold, floor(f*n_train)::BIGINT, n_test FROM tt, fr
        UNION ALL SELECT 'extrapolation', 'extrapolation', (SELECT count(*) FROM o)-n, n FROM w
        UNION ALL SELECT 'extrapolation', 'random_control', (SELECT count(*) FROM o)-n, n FROM w
        UNION ALL SELECT 'extrapolation', 'inrange_control', (SELECT count(*) FROM o)-n+n//2, n-n//2 FROM w)""",
    )
    + """SELECT split, fold, n_train::BIGINT AS n_train, n_test::BIGINT AS n_test, NULL AS note FROM m
    UNION ALL SELECT 'feature_ood', NULL, 0, 0, 'its folds move with the descriptors chosen, so they pin down no property of a row'""",
)
def _(spark, sf):
    return suite.suite_manifest(suite_rows(spark, sf), 450000.0)
