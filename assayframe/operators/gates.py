"""Drift gates: order- and partition-insensitive table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.draws import hash_int


def canonical_row(df: DataFrame) -> Column:
    """A row as text: columns by name, each value with its length before it, so that no two rows
    share a text; doubles as their shortest exact decimals, times as microseconds, NULL as a bare sign."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            # Wall-clock time, whatever the session's zone.
            c = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{f.name}`)")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat_ws("|", *parts)


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., rows, digest_sum, digest_xor): sums and xors of 32-bit row digests. Two
    independent words of the md5 are used, and duplicates count."""
    h = F.md5(canonical_row(df))
    t = df.select(*(by or []), hash_int(h).alias("_a"), hash_int(F.substring(h, 9, 8)).alias("_b"))
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("_a").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("_b"), F.lit(0)).alias("digest_xor"),
    ]
    return t.groupBy(*by).agg(*aggs) if by else t.agg(*aggs)


def part_manifest(df: DataFrame, part: str) -> DataFrame:
    """One row: number of parts and the md5 over the sorted "name:fingerprint" lines.
    Parts are a partition list, so the list of lines is short."""
    fp = fingerprint(df, [part])
    line = F.concat_ws(":", F.col(part).cast("string"), F.col("rows").cast("string"), "digest_sum", F.col("digest_xor").cast("string"))
    return fp.agg(
        F.count(F.lit(1)).alias("parts"),
        F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("manifest"),
    )


def verify_table(df: DataFrame, expected: dict) -> dict:
    """Compare with pinned rows / digest_sum / digest_xor; raise on any difference."""
    got = fingerprint(df).first().asDict()
    wrong = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
    if wrong:
        raise RuntimeError(f"table drift (found, expected): {wrong}")
    return got


def verify_parts(
    df: DataFrame | None, part: str, expected_parts: int, expected_manifest: str | None = None, allow_absent: bool = False
) -> dict:
    """Compare a partitioned table with its pinned manifest. Without a pin only the part
    count is asserted and the manifest is returned for recording; a table that does not
    exist yet passes only when allowed."""
    if df is None:
        if allow_absent:
            return {"parts": 0, "absent": True}
        raise RuntimeError("the table is absent")
    got = part_manifest(df, part).first().asDict()
    if got["parts"] != expected_parts:
        raise RuntimeError(f"found {got['parts']} parts, expected {expected_parts}")
    if expected_manifest is None:
        return {**got, "pinned": False}
    if got["manifest"] != expected_manifest:
        raise RuntimeError(f"manifest {got['manifest']} differs from the pinned {expected_manifest}")
    return {**got, "pinned": True}
