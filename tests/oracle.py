"""Runs a query and its SQL side by side."""

from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*names).collect())))
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    want = sorted(map(repr, rel.project(",".join(f'"{n}"' for n in names)).fetchall()))
    assert {n: TYPES[t] for n, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    assert got == want
