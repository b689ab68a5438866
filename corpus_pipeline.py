"""From raw documents to token ids: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each result as Parquet to the shared scratch area and gives what it reads back to
the next stage.

A stage's empty input gives an empty result; columns beyond those of documents travel along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm import bpe, langid, mixing, neardup, secrets
from assayframe.llm.common import documents
from assayframe.sources.session import release, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters, and those further out of place with every language learned than documents
    of that many n-grams are in it."""
    labelled = docs.select("doc_id", "text", "lang").where(~langid.held_out())
    profile = settle(langid.profiles(labelled), "langid-profiles")
    least = langid.limits(labelled, profile)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    judged = langid.predict(docs.select(whole), profile, text="document.text", counted=True)
    return judged.join(least, ["lang_pred", "power"]).where(F.col("score") >= F.col("least")).select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id, one row of it. Rows without a doc_id are in no group."""
    found = neardup.linked(docs, neardup.Near(words=5)).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(found, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source"))
    one = named.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(*docs.columns)
    return one.union(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All findings are blotted out."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in one of the two whole numbers of copies around its share of the mix (none, one or two), so that
    the words put out of a source meet its target. Repeated rows share their copies."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text", "source"))
    whole = mixing.whole(keyed.select(F.col("_row").alias("doc_id"), "text", "source"))
    taken = whole.groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows")).where("_all > 0")
    place = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    copies = F.floor(F.col("_all") / F.col("_rows")) + F.when(place <= F.col("_all") % F.col("_rows"), 1).otherwise(0)
    dealt = keyed.join(taken, "_row").withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), hashes of the ids and of the bytes decoded from them."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, ranks, pattern, keep_ids=True)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs


#: The network of the secret scan has no SQL; the stages are tested one by one.
ORACLE_SQL = None
