import pytest
from pyspark.sql import functions as F

from assayframe.operators import composition as C
from assayframe.operators import filters as B


def parse(spark, *formulas):
    df = spark.createDataFrame(list(enumerate(formulas)), "id int, f string")
    out = {}
    for r in C.to_composition(df, "id", "f").collect():
        out.setdefault(r["row_id"], {})[r["element"]] = r["amount"]
    return [out.get(i) for i in range(len(formulas))]


def test_parse(spark):
    got = parse(spark, "Ca0.5TiO3", "Ca(OH)2", "X?", None, "K4[Fe(CN)6]", "((H2)3)2", "H2O)", "(H", "", "Ca1.2.3", "Al2 (SO4)3", "()2", "OO2", "a", "2H")
    assert got[0] == {"Ca": 0.5, "Ti": 1.0, "O": 3.0}
    assert got[1] == {"Ca": 1.0, "O": 2.0, "H": 2.0}
    assert got[4] == {"K": 4.0, "Fe": 1.0, "C": 6.0, "N": 6.0}
    assert got[5] == {"H": 12.0}
    assert got[10] == {"Al": 2.0, "S": 3.0, "O": 12.0}
    assert got[12] == {"O": 3.0}
    assert all(got[i] is None for i in (2, 3, 6, 7, 8, 9, 11, 13, 14))


def test_parse_strict_raises(spark):
    df = spark.createDataFrame([(1, "X?")], "id int, f string")
    with pytest.raises(Exception, match="does not parse"):
        C.to_composition(df, "id", "f", strict=True).collect()
    ok = spark.createDataFrame([(1, "H2O"), (2, None)], "id int, f string")
    assert C.to_composition(ok, "id", "f", strict=True).count() == 2
    assert C.unparsed(df, "f").count() == 1


def comp_of(spark, rows):
    return spark.createDataFrame(rows, "row_id int, element string, amount double")


def test_fractions_and_keys(spark):
    comp = comp_of(spark, [(1, "A", 2.0), (1, "B", 1.0), (2, "A", 4.0), (2, "B", 2.0), (3, "A", 0.5), (3, "B", 0.25), (4, "A", 21.0), (4, "B", 14.0), (4, "C", 35.0)])
    fr = {(r["row_id"], r["element"]): r["fraction"] for r in C.fractions(comp).collect()}
    assert round(fr[1, "A"], 6) == 0.666667 and round(fr[1, "B"], 6) == 0.333333
    keys = {r["row_id"]: r["key"] for r in C.reduced_key(comp).collect()}
    assert keys[1] == keys[2] == "A:2 B:1"
    assert keys[3] == "A:0.500000 B:0.250000"
    assert keys[4] == "A:3 B:2 C:5"


def test_categories(spark):
    comp = comp_of(spark, [(1, "Na", 1.0), (1, "Cl", 1.0), (2, "Na", 1.0), (2, "Cl", 1.0), (2, "O", 1.0), (3, "Fe", 1.0), (3, "Al", 1.0)])
    got = {r["row_id"]: r["category"] for r in C.categories(comp).collect()}
    assert got == {1: "Halides", 2: "multi", 3: "Others"}


def test_rare_filter_is_single_pass(spark):
    # B is rare; dropping its row makes A rare too, which is not followed up.
    comp = comp_of(spark, [(1, "A", 1.0), (1, "B", 1.0), (2, "A", 1.0), (3, "C", 1.0), (4, "C", 5.0)])
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "row_id int")
    assert sorted(r[0] for r in B.rows_without_rare(comp, rows, 2).collect()) == [2, 3, 4]


def test_backfill_and_selection(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 0.5)], "k int, hull double")
    assert {r["k"]: r["hull"] for r in B.with_backfill(a, "hull", b, "k").collect()} == {1: 0.5, 2: None}
    with pytest.raises(ValueError):
        B.with_backfill(a, "hull", a, "k")
    m = spark.createDataFrame([("s", "a", 300, 30), ("s", "b", 100, 30), ("s", "c", 300, 3)], "split string, fold string, n_train int, n_test int")
    assert {r["fold"]: r["eligible"] for r in B.fold_eligibility(m).collect()} == {"a": True, "b": False, "c": False}
    assert B.select_folds(m, ["s_a"]).count() == 1
    with pytest.raises(KeyError):
        B.select_folds(m, ["s_z"])
    assert B.select_folds(m, index=9).count() == 0 and B.select_folds(m, index=1).first()["fold"] == "b"


def test_results_do_not_depend_on_partitioning(spark):
    rows = [(i, e, float(i % 5 + 1)) for i in range(200) for e in ("A", "B", "C")[: i % 3 + 1]]
    comp = comp_of(spark, rows)
    for fn in (C.reduced_key, C.fractions, C.element_set_key):
        one, eight = fn(comp.repartition(1)), fn(comp.repartition(8))
        assert sorted(map(str, one.collect())) == sorted(map(str, eight.collect()))
    assert comp.where(F.col("amount") > 0).count() == len(rows)


def test_many_lines_go_to_as_many_tasks(spark, tmp_path, monkeypatch):
    from assayframe.plans import standins as D

    lines = [(i % 301 if i % 50 else None, i % 40, float(i % 7 + 1)) for i in range(2_000)]
    parts = [(p, f"Brand#{p % 25 + 1}") for p in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for o, p, q in lines:
        want[o, f"Brand#{p % 25 + 1}"] = want.get((o, f"Brand#{p % 25 + 1}"), 0.0) + q
    monkeypatch.setattr(D, "TASK_LINES", 100)
    comp = D.composition(spark, str(tmp_path))
    assert comp.rdd.getNumPartitions() == 20
    rows = [tuple(r) for r in comp.collect()]
    assert sorted(rows, key=str) == sorted(((*k, v) for k, v in want.items()), key=str)
