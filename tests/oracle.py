"""Rows of a Spark query against rows of DuckDB over the same parquet files."""

import datetime
import decimal
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same_rows(df, sql: str, folder: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck(folder).execute(sql)
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == names
    place = [theirs.index(c) for c in names]
    assert ours == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
