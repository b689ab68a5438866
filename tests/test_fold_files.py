"""Folds read from train and test files."""

import pytest
from pyspark.sql import types as T

from assayframe.sources import fold_files as FF
from assayframe.sources.session import new_table_path

SCHEMA = T.StructType([T.StructField("formula", T.StringType()), T.StructField("gap", T.DoubleType())])


def lay(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "given folds"
    for k in range(3):
        lay(home, f"official_fold{k}_train.csv", ["formula,gap", *[f"T{k}x{i},{i}.5" for i in range(4 + k)]])
        lay(home, f"official_fold{k}_test.csv", ["formula,gap", f"S{k},{k}", f'"a,b%{k}",'])
    lay(home, "notes.csv", ["not,a", "fold,file"])
    return home


def test_files_of_the_usual_names(spark, folder):
    rows = FF.read_fold_files(spark, str(folder), SCHEMA, ["0", "1"])
    got = sorted((r.fold, r.role, r.formula, r.gap) for r in rows.collect())
    want = [(str(k), "train", f"T{k}x{i}", i + 0.5) for k in (0, 1) for i in range(4 + k)]
    want += [(str(k), "test", f"S{k}", float(k)) for k in (0, 1)] + [(str(k), "test", f"a,b%{k}", None) for k in (0, 1)]
    assert sorted(want, key=str) == sorted(got, key=str)


def test_one_scan_for_all_files(spark, folder):
    rows = FF.read_fold_files(spark, str(folder), SCHEMA, ["0", "1", "2"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "Exchange" not in plan


def test_missing_files_are_named_before_reading(spark, folder):
    (folder / "official_fold1_test.csv").unlink()
    # a file that cannot be read is not opened: the listing alone decides
    lay(folder, "official_fold0_train.csv", ["wrong,header", "1,2"])
    with pytest.raises(FileNotFoundError, match="1_test, 7_test, 7_train"):
        FF.read_fold_files(spark, str(folder), SCHEMA, ["0", "1", "7"])


def test_header_and_rows_must_fit(spark, folder):
    lay(folder, "official_fold0_train.csv", ["gap,formula", "1,2"])
    with pytest.raises(Exception, match="(?i)header|schema"):
        FF.read_fold_files(spark, str(folder), SCHEMA, ["0"]).collect()
    lay(folder, "official_fold0_train.csv", ["formula,gap", "A,no number"])
    with pytest.raises(Exception, match="(?i)malformed"):
        FF.read_fold_files(spark, str(folder), SCHEMA, ["0"]).collect()


def test_empty_side_is_no_missing_side(spark, folder):
    lay(folder, "official_fold2_test.csv", ["formula,gap"])
    rows = FF.read_fold_files(spark, str(folder), SCHEMA, ["2"])
    assert {r.role for r in rows.collect()} == {"train"}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip_with_odd_fold_names(spark, fmt):
    given = [("A", 1.0, "x y", "train"), ("B", None, "x y", "test"), ("C", 2.0, "no-1.5", "train"), ("A", 3.0, "no-1.5", "test")]
    rows = spark.createDataFrame(given, "formula string, gap double, fold string, role string")
    path = FF.write_fold_files(rows, new_table_path(spark, "folds"), ["formula", "gap"], fmt)
    back = FF.read_fold_files(spark, path, SCHEMA, ["x y", "no-1.5"], fmt)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, given))
    listed = {(r.fold, r.role) for r in FF.listing(spark, path).collect()}
    assert listed == {(f, r) for _, _, f, r in given}


def test_vocabulary_is_taken_over_both_sides(spark, folder):
    rows = FF.read_fold_files(spark, str(folder), SCHEMA, ["0"])
    assert {r.element for r in FF.fold_vocabularies(rows, "formula").collect()} == {"T0x0", "T0x1", "T0x2", "T0x3", "S0", "a,b%0"}


def test_names_that_paths_would_change_are_refused(spark):
    rows = spark.createDataFrame([("A", 1.0, "a/b", "train")], "formula string, gap double, fold string, role string")
    with pytest.raises(Exception, match="no name for a fold file: a/b"):
        FF.write_fold_files(rows, new_table_path(spark, "folds"), ["formula", "gap"])


def test_names_are_taken_apart_once_a_file(spark, folder):
    """What is done for each row has no pattern in it: fold and side are joined on."""
    plan = FF.read_fold_files(spark, str(folder), SCHEMA, ["0", "1"])._jdf.queryExecution().toString()
    assert "regexp_extract" not in plan and "url_decode" not in plan
