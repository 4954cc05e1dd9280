"""Comparing registered queries with their SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb

SF_DIR = os.environ.get("KOINE_TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(frame, sql: str) -> list:
    """Rows, as strings by sorted column names, that only one side has."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    ours, theirs = frame.toPandas(), con.sql(sql).df()
    columns = sorted(ours.columns)
    if columns != sorted(theirs.columns):
        return [columns, sorted(theirs.columns)]
    a, b = (sorted(map(tuple, df[columns].astype(str).to_numpy())) for df in (ours, theirs))
    return [] if a == b else [*(set(a) ^ set(b)), len(a), len(b)]
