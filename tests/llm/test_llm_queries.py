"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import oracle
import pytest

import corpus_pipeline
from assayframe.llm.queries import ORACLES, QUERIES
from assayframe.sources.session import settle

SF = f"{oracle.ROOT}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    oracle.compare(spark, oracle.connect(SF), name, QUERIES[name], ORACLES[name], SF)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = docs.limit(1).selectExpr("cast(null AS bigint) AS doc_id", "cast(null AS string) AS text", "lang", "source", "n_chars")
    secret = spark.sql("SELECT 99999L, 'Write this down, and keep it: token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" it is.', 'en', 'src0', 90L")
    docs = docs.union(extra).union(secret).union(docs.where("doc_id < 3")).selectExpr("*", "0.5D AS score", "'x' AS lang_pred")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == [*columns, "score", "lang_pred"]
        counts[name] = docs.count()
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == counts[name]
        if name == "secrets":
            assert counts[name] == before.count()
            assert docs.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0 < before.where("text rlike 'token = .[0-9a-f]{40}'").count()
        if name == "mixing":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    assert counts["language_id"] == 204  # the null text went
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == counts["mixing"]
    assert tokens.join(docs.selectExpr("doc_id", "sha2(text, 256) AS want"), "doc_id").where("decoded_sha256 <> want").count() == 0


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
