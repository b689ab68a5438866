"""JSON records, the ledger of units, and gates that read changed files only."""

import pytest
from pyspark.sql import types as T

from assayframe.operators import gates as K
from assayframe.operators import part_gates as PG
from assayframe.sources import artifacts as A
from assayframe.sources.session import new_table_path

RUN = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("at", T.StructType([T.StructField("n", T.LongType())]))]
)


def test_json_round_trip_keeps_nested_and_missing_values(spark):
    rows = [("a", [1.5, None, 1e-300], (7,)), ("b", [], None), (None, None, (None,)), ("ü \"q\"\n", [0.1 + 0.2], (2**62,))]
    path = A.write_json(spark.createDataFrame(rows, RUN), new_table_path(spark, "json"))
    back = {r.run: (r.y, r["at"] and r["at"].n) for r in A.read_json(spark, path, RUN).collect()}
    assert back == {r[0]: (r[1], r[2] and r[2][0]) for r in rows}


def test_corrupt_records_have_a_rule(spark, tmp_path):
    (tmp_path / "runs.json").write_text('{"run": "a", "y": [1], "at": {"n": 3}, "more": 1}\n{"run": "b", "y": "none"}\nnot json\n{"run": "c"}\n')
    path = str(tmp_path / "runs.json")
    with pytest.raises(Exception, match="(?i)malformed"):
        A.read_json(spark, path, RUN).collect()
    assert {r.run for r in A.read_json(spark, path, RUN, "drop").collect()} == {"a", "c"}
    kept = A.read_json(spark, path, RUN, "keep").cache()
    assert {r.run for r in kept.where("_corrupt is null").collect()} == {"a", "c"}
    assert kept.where("_corrupt is not null").count() == 2
    with pytest.raises(ValueError, match="raised, dropped or kept"):
        A.read_json(spark, path, RUN, "ignore")


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on_where_it_was(spark):
    ledger, calls, units = A.Ledger(spark, new_table_path(spark, "ledger")), [], [f"s/{k}" for k in range(5)]

    def work(unit, stop=None):
        calls.append(unit)
        if unit == stop:
            raise Stopped(unit)
        return spark.createDataFrame([(unit, k) for k in range(int(unit[-1]))], "name string, k long")

    with pytest.raises(Stopped):
        ledger.run(units, lambda u: work(u, "s/2"))
    assert calls == ["s/0", "s/1", "s/2"] and ledger.pending(units) == ["s/2", "s/3", "s/4"]
    with pytest.raises(RuntimeError, match="s/2.*s/3.*s/4"):
        ledger.publish(units)
    assert not A.exists(spark, f"{ledger.folder}/current.json")
    # another driver goes on
    again = A.Ledger(spark, ledger.folder)
    assert again.run(units, work) == ["s/2", "s/3", "s/4"] and calls[3:] == ["s/2", "s/3", "s/4"]
    again.publish(units)
    got = sorted((r.unit, r.name, r.k) for r in again.published().collect())
    assert got == sorted((u, u, k) for u in units for k in range(int(u[-1])))


def test_a_half_written_unit_is_never_seen(spark):
    ledger = A.Ledger(spark, new_table_path(spark, "ledger"))
    half = spark.createDataFrame([("bad", 1)], "name string, k long")
    half.write.parquet(f"{ledger.folder}/units/leftover")
    ledger.run(["a"], lambda u: spark.createDataFrame([(u, 1)], "name string, k long"))
    ledger.publish(["a"])
    assert [r.name for r in ledger.published().collect()] == ["a"]


def test_two_runs_of_a_unit_count_once(spark):
    ledger = A.Ledger(spark, new_table_path(spark, "ledger"))
    for name in ("x", "y"):
        place = f"{ledger.folder}/units/{name}"
        spark.createDataFrame([(name,)], "name string").write.parquet(place)
        spark.createDataFrame([("u", place, 1)], A.Ledger.SCHEMA).write.mode("append").parquet(f"{ledger.folder}/done")
    ledger.publish(["u"])
    assert [r.name for r in ledger.published().collect()] == ["x"]


def test_publishing_again_swaps_the_whole_result(spark):
    ledger = A.Ledger(spark, new_table_path(spark, "ledger"))
    frame = lambda u: spark.createDataFrame([(u,)], "name string")
    ledger.run(["a", "b"], frame)
    ledger.publish(["a", "b"])
    ledger.run(["c"], frame)
    assert {r.name for r in ledger.published().collect()} == {"a", "b"}
    ledger.publish(["b", "c"])
    assert {r.name for r in ledger.published().collect()} == {"b", "c"}


def test_only_changed_files_are_read_again(spark, tmp_path):
    folder, manifest = str(tmp_path / "with space"), str(tmp_path / "manifest")
    part = lambda k, n: spark.range(n).selectExpr("id", f"id * {k} AS v", "cast(id AS string) AS s").coalesce(1)
    for k in range(4):
        part(k, 10 + k).write.parquet(f"{folder}/part{k}")
    schema = part(0, 1).schema
    whole = lambda: K.fingerprint(spark.read.option("recursiveFileLookup", True).schema(schema).parquet(folder)).first()
    first, read = PG.refresh(spark, folder, manifest, schema)
    assert len(read) == 4 and PG.total(first).first() == whole()
    same, read = PG.refresh(spark, folder, manifest, schema)
    assert read == [] and PG.total(same).first() == whole()
    part(9, 25).write.mode("overwrite").parquet(f"{folder}/part2")  # changed
    part(5, 0).write.parquet(f"{folder}/part9")  # new, without rows
    import shutil

    shutil.rmtree(f"{folder}/part0")  # gone
    third, read = PG.refresh(spark, folder, manifest, schema)
    assert len(read) == 2 and all("part2" in p or "part9" in p for p in read)
    assert PG.total(third).first() == whole() and third.count() == 4
    _, read = PG.refresh(spark, folder, manifest, schema, trust=False)
    assert len(read) == 4


def test_files_that_come_to_a_table_are_written_by_many(spark, monkeypatch):
    """The rows appended to a fingerprinted table are no file of one task: there may be several, and they alone are read."""
    from assayframe.plans import q_sources
    from assayframe.plans.registry import QUERIES, load_all

    load_all()
    reads, refresh = [], q_sources.PG.refresh
    monkeypatch.setattr(q_sources, "_FILE_ROWS", 400)
    monkeypatch.setattr(q_sources.PG, "refresh", lambda *a, **k: reads.append(refresh(*a, **k)) or reads[-1])
    sf = "/root/testdata/sf0.001"
    got = QUERIES["k1_incremental_fingerprint"](spark, sf).first()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert got == K.fingerprint(lines.unionByName(lines.where("l_linenumber = 1"))).first()
    assert len(reads[1][1]) > 1 and not set(reads[0][1]) & set(reads[1][1])
