"""Compare a query with its SQL in DuckDB, columns by name, rows in any order."""

import glob
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def text(v) -> str:
    return "~" if v is None else repr(v) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def same_rows(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(text(r[n]) for n in names) for r in df.collect())
    found = con.execute(sql)
    at = [x[0] for x in found.description]
    assert sorted(at) == names
    want = sorted(tuple(text(r[at.index(n)]) for n in names) for r in found.fetchall())
    assert got == want
