"""A query against its SQL: the same rows, whatever their order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if hasattr(x, "as_tuple"):
        x = float(x)
    return round(float(x), 5) + 0.0 if isinstance(x, float) else x


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns), (name, got.columns, columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted([tuple(_plain(r[c]) for c in columns) for r in got.collect()], key=key)
    b = sorted([tuple(_plain(x) for x in r) for r in want.fetchall()], key=key)
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, int | float) and isinstance(q, int | float) and abs(p - q) < 1e-5) for p, q in zip(x, y, strict=True)), (name, x, y)
