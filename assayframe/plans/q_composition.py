"""Queries C (compositions) and D1-D3 (composition statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.numeric import six
from assayframe.operators import composition as C
from assayframe.operators import filters as B
from assayframe.plans import standins as D
from assayframe.plans.registry import query
from assayframe.plans.standins import CAT, COMP, NUM, PROPS, SYM, r6, with_
from assayframe.sources.session import settle

_SYMS = f"sy AS (SELECT row_id, {SYM} AS s, amount FROM comp)"


@query(
    "c1_parse_formulas",
    with_(
        COMP, _SYMS,
        "p AS (SELECT row_id, s, amount, row_number() OVER (PARTITION BY row_id ORDER BY s) AS r, count(*) OVER (PARTITION BY row_id) AS k FROM sy)",
    )
    + """SELECT row_id, s AS element, CASE WHEN k>=3 AND r>1 THEN amount*2 ELSE amount END AS amount FROM p
    JOIN orders ON o_orderkey=row_id WHERE o_orderstatus<>'P'""",
)
def _(spark, sf):
    # Orders without lines have no formula and those of one status get a broken one.
    rows = D.order_rows(spark, sf).join(settle(D.formulas(spark, sf), "formulas"), "row_id", "left")
    rows = rows.withColumn("formula", F.when(F.col("status") == "P", F.concat("formula", F.lit("?"))).otherwise(F.col("formula")))
    return C.to_composition(rows, "row_id", "formula")


@query(
    "c2_reduced_key",
    with_(
        COMP,
        "g AS (SELECT row_id, list_reduce(list(amount::BIGINT), lambda a, b: gcd(a, b)) AS d FROM comp GROUP BY 1)",
    )
    + """SELECT comp.row_id, string_agg(element||':'||(amount::BIGINT // d), ' ' ORDER BY element) AS key FROM comp JOIN g ON g.row_id=comp.row_id GROUP BY 1""",
)
def _(spark, sf):
    return C.reduced_key(D.composition(spark, sf))


@query("c3_atom_count", with_(COMP) + "SELECT row_id, sum(amount) AS num_atoms FROM comp GROUP BY 1")
def _(spark, sf):
    return C.atom_count(D.composition(spark, sf))


@query(
    "c4_fractions",
    with_(COMP) + f"SELECT row_id, element, amount, {r6('amount/sum(amount) OVER (PARTITION BY row_id)')} AS fraction FROM comp",
)
def _(spark, sf):
    out = C.fractions(D.composition(spark, sf))
    return out.withColumn("fraction", six(F.col("fraction")))


def _short(comp):
    return comp.withColumn("element", F.concat(F.lit("b"), D.suffix(F.col("element")).cast("string")))


@query(
    "c5_fraction_matrix",
    with_(COMP, "tot AS (SELECT row_id, sum(amount) AS t FROM comp GROUP BY 1)")
    + "SELECT comp.row_id, "
    + ", ".join(f"floor(sum(CASE WHEN {NUM}={i} THEN amount ELSE 0 END)/any_value(t)*1e6+0.5)/1e6 AS b{i}" for i in range(1, 26))
    + " FROM comp JOIN tot ON tot.row_id=comp.row_id GROUP BY 1",
)
def _(spark, sf):
    comp = settle(_short(D.composition(spark, sf)), "comp")
    vocab = sorted(r[0] for r in C.vocabulary(comp).collect())  # the columns of the result
    m = C.fraction_matrix(comp, vocab)
    return m.select("row_id", *[six(F.col(v)).alias(v) for v in vocab])


@query("c6_vocabulary", with_(COMP) + f"SELECT DISTINCT element FROM comp WHERE row_id NOT IN (SELECT row_id FROM comp WHERE {NUM} > 20)")
def _(spark, sf):
    known = D.table(spark, sf, "part").select(F.col("p_brand").alias("element")).distinct().where(D.suffix(F.col("element")) <= 20)
    return C.vocabulary(C.only_known(D.composition(spark, sf), known))


@query(
    "c7_reindexed",
    with_(COMP, "tot AS (SELECT row_id, sum(amount) AS t FROM comp GROUP BY 1)")
    + "SELECT comp.row_id, "
    + ", ".join(f"floor(sum(CASE WHEN {NUM}={i} THEN amount ELSE 0 END)/any_value(t)*1e6+0.5)/1e6 AS b{i}" for i in range(11, 31))
    + " FROM comp JOIN tot ON tot.row_id=comp.row_id JOIN orders ON o_orderkey=comp.row_id WHERE o_orderstatus='F' GROUP BY 1",
)
def _(spark, sf):
    # One population carried to the vocabulary of another, which lacks b1-b10 and knows b26-b30.
    rows = D.order_rows(spark, sf).where("status = 'F'").select("row_id")
    comp = settle(_short(D.composition(spark, sf).join(rows, "row_id", "left_semi")), "comp")
    own = sorted(r[0] for r in C.vocabulary(comp).collect())
    other = [f"b{i}" for i in range(11, 31)]
    m = C.reindexed(C.fraction_matrix(comp, own), other)
    return m.select("row_id", *[six(F.col(v)).alias(v) for v in other])


@query("c8_categories", with_(COMP, CAT) + "SELECT row_id, category FROM cat")
def _(spark, sf):
    return C.categories(D.composition(spark, sf), D.CATEGORY_BRANDS)


@query("c9_element_set", with_(COMP) + "SELECT row_id, string_agg(element,'-' ORDER BY element) AS system FROM comp GROUP BY 1")
def _(spark, sf):
    return C.element_set_key(D.composition(spark, sf))


@query(
    "c10_element_groups",
    with_(COMP) + f"SELECT row_id, string_agg(DISTINCT g,'-' ORDER BY g) AS groups FROM (SELECT row_id, 'g'||({NUM} % 4) AS g FROM comp) GROUP BY 1",
)
def _(spark, sf):
    return C.element_groups(D.composition(spark, sf), brand_groups(spark, sf))


def brand_groups(spark, sf):
    brands = D.table(spark, sf, "part").select(F.col("p_brand").alias("element")).distinct()
    return brands.withColumn("grp", F.concat(F.lit("g"), (D.suffix(F.col("element")) % 4).cast("string")))


@query("d1_element_counts", with_(COMP) + "SELECT element, count(*)::BIGINT AS n_rows FROM comp GROUP BY 1")
def _(spark, sf):
    return B.element_counts(D.composition(spark, sf))


@query(
    "d2_element_summary",
    with_(COMP) + f"SELECT element, {NUM}::BIGINT AS z, count(*)::BIGINT AS n_rows FROM comp GROUP BY 1,2 ORDER BY n_rows DESC, z LIMIT 20",
)
def _(spark, sf):
    counts = B.element_counts(D.composition(spark, sf)).withColumn("z", D.suffix(F.col("element")).cast("bigint"))
    return counts.orderBy(F.desc("n_rows"), "z").limit(20)


@query(
    "d3_overview_histograms",
    with_(COMP, PROPS, D.CP, "r AS (SELECT row_id, count(*) AS k, sum(amount) AS a, sum(coalesce(amount*valence,0))/sum(amount) AS v FROM cp GROUP BY 1)")
    + """SELECT 'unique_elements' AS figure, k::DOUBLE AS bin, count(*)::BIGINT AS n FROM r GROUP BY 2
    UNION ALL SELECT 'total_atoms', a, count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'valence_per_atom', floor(v*10+1e-9)/10, count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'materials_per_element', CAST(regexp_extract(element,'[0-9]+') AS DOUBLE), count(*) FROM comp GROUP BY 2""",
)
def _(spark, sf):
    comp = settle(D.composition(spark, sf), "comp")
    props = D.properties(spark, sf).select("element", "valence")
    per = comp.join(props, "element", "left").groupBy("row_id").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("amount").alias("a"),
        (F.sum(F.coalesce(F.col("amount") * F.col("valence"), F.lit(0.0))) / F.sum("amount")).alias("v"),
    )
    v_bin = F.floor(F.col("v") * 10 + 1e-9).cast("double") / 10
    figures = F.array(
        *[
            F.struct(F.lit(n).alias("figure"), c.alias("bin"))
            for n, c in (("unique_elements", F.col("k")), ("total_atoms", F.col("a")), ("valence_per_atom", v_bin))
        ]
    )
    rows = per.select(F.inline(figures)).groupBy("figure", "bin").agg(F.count(F.lit(1)).alias("n"))
    coverage = B.element_counts(comp).select(
        F.lit("materials_per_element").alias("figure"), D.suffix(F.col("element")).cast("double").alias("bin"), F.col("n_rows").alias("n")
    )
    return rows.unionByName(coverage)
