"""Comparison of a query's rows with those of DuckDB."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(folder: str = SMALL):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        where = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{where}'").fetchall()
    return c


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, list):
        return repr([_norm(v) for v in x])
    return repr(x)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple(_norm(r[n]) for n in names) for r in table.to_pylist())


def check(df, sql: str, folder: str = SMALL) -> None:
    want = connection(folder).sql(sql).to_arrow_table()
    got = df.toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
    kinds = {"large_string": "string", "large_binary": "binary"}
    kind = lambda t: {f.name: kinds.get(str(f.type), str(f.type)) for f in t.schema if "timestamp" not in str(f.type) and "list" not in str(f.type)}
    assert kind(got) == kind(want)
