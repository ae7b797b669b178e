"""Row-set comparison of a Spark result with a DuckDB result."""

import glob
import math
import os

import duckdb

# Spark type -> the DuckDB type it must be answered with
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[: -len('.parquet')]} as select * from '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def differences(df, con, sql):
    """Column, type and row differences; empty when both sides agree."""
    result = con.execute(sql)
    names, types = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    out += [f"type of {c}: {t} against {types[c]}" for c, t in df.dtypes if TYPES.get(t) != types[c]]
    order = sorted(names)
    left = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    right = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    if left != right:
        ours, theirs = set(left), set(right)
        out.append(f"{len(left)} against {len(right)} rows; only ours {[r for r in left if r not in theirs][:3]}")
        out.append(f"only theirs {[r for r in right if r not in ours][:3]}")
    return out
