"""Compares a query with its SQL: same columns, same bag of rows."""

from __future__ import annotations

import collections

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got = spark_df.toArrow()
    want = con.sql(sql).to_arrow_table()
    out = []
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return [f"columns {names} != {sorted(want.column_names)}"]
    for n in names:
        a, b = got.schema.field(n).type, want.schema.field(n).type
        if a != b:
            out.append(f"type of {n}: {a} != {b}")
    rows = [
        collections.Counter(zip(*[t.column(n).to_pylist() for n in names])) for t in (got, want)
    ]
    if rows[0] != rows[1]:
        extra = list((rows[0] - rows[1]).items())
        lacking = list((rows[1] - rows[0]).items())
        out.append(
            f"{got.num_rows} rows != {want.num_rows}; "
            f"{len(extra)} only here {extra[:2]}; {len(lacking)} only there {lacking[:2]}"
        )
    return out
