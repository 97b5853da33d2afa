"""Comparing a Spark result with DuckDB's."""

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def _value(x):
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return round(x, 6) if isinstance(x, float) else x


def rows_of(frame) -> list[str]:
    names = sorted(frame.columns)
    return sorted(repr([_value(x) for x in r]) for r in frame[names].astype(object).itertuples(index=False))
