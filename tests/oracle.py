"""Run a query and its reference SQL on the same Parquet files and compare the results."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if value != value else float(repr(value))
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:  # whole numbers with nulls: one side gives them as floats
        held = frame[name].dropna()
        if frame[name].dtype.kind == "f" and len(held) < len(frame) and (held % 1 == 0).all():
            frame[name] = frame[name].astype("Int64")
    frame = frame.astype(object)
    out = [
        tuple(None if v is pd.NaT or v is pd.NA else _plain(v) for v in r)
        for r in frame.itertuples(index=False, name=None)
    ]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if len(a) != len(b):
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} != {len(b)}; spark only {only_a}; sql only {only_b}"
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} != {y}"
        if any(type(p) is not type(q) for p, q in zip(x, y)):
            return f"types differ in {x} / {y}"
    return None


def sf(default: str = "0.001") -> str:
    return f"/root/testdata/sf{os.environ.get('SIFTMILL_SF', default)}"
