"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import bpe, html, langid, merkle, mixing, neardup, packing, quality, runs, secrets, substrings, token_files, topk
from assayframe.llm.common import documents, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(documents(spark, sf_dir)))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), token_files.Format(public_tokenizers.path("byte_bpe_50k.json")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(documents(spark, sf_dir), ranks, pattern)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(documents(spark, sf_dir), change=runs.planted))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(documents(spark, sf_dir)))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.Packing(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_token_files, op3_quality, op4_html, op5_bpe, op6_topk, op7_neardup, op8_mixing, op9_substrings,
        op10_language_id, op11_runs, op12_merkle, op13_packing,
    )
}

ORACLES = {
    "op3_quality": quality.SQL, "op6_topk": topk.SQL, "op7_neardup": neardup.SQL, "op8_mixing": mixing.SQL, "op12_merkle": merkle.SQL,
}
