"""Run a registered query and its SQL twin and compare them as multisets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return v
    return str(v)


def _kind(v):
    return "none" if v is None else type(v).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got, f"{name}: no rows"
    for r in got:
        assert "NaN" not in r, f"{name}: NaN in {r}"
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_cols, want = rows_of(cols, rel.fetchall())
    assert got_cols == want_cols, f"{name}: columns {got_cols} vs {want_cols}"
    assert len(got) == len(want), f"{name}: {len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, f"{name}: {len(bad)} rows differ, e.g. {bad[:2]}"
    types = {(_kind(a), _kind(b)) for g, w in zip(got, want) for a, b in zip(g, w) if _kind(a) != _kind(b)}
    assert not types, f"{name}: types differ {types}"
    return len(got), True
