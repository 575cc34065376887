"""Small tables for tests."""

from __future__ import annotations

import datetime as dt

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def day(i: int, start: str = "2024-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


def bars(spark, closes, symbol="A", start="2024-01-01", exchange="TEST"):
    rows = [(symbol, exchange, "raw", day(i, start), float(c), float(c), float(c), float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, exchange string, price_basis string, trading_date date, open double, high double, low double, close double, volume double")


def events(spark, rows):
    return spark.createDataFrame(rows, "symbol string, effective_date date, split_ratio double, cash_per_unit double")


def duck(sf: str):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def same(df, rel) -> None:
    """Rows of a Spark frame and of a DuckDB relation agree, whatever their order."""
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    a = [tuple(plain(r[n]) for n in names) for r in (x.asDict() for x in df.collect())]
    at = [rel.columns.index(n) for n in names]
    b = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for p, q in zip(x, y):
            assert p == q or (p is not None and q is not None and not isinstance(p, (str, bool)) and abs(float(p) - float(q)) <= 1e-9 * max(1, abs(float(q)))), (x, y)
