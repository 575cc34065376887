"""Backfills ask for what is missing, write once, and leave the table whole when they fail."""

import glob
import os

import pytest
from helpers import bars as plain_bars
from helpers import day

from barloom.sources import backfill, publish


def bars(spark, *args, **kwargs):
    return plain_bars(spark, *args, **kwargs).selectExpr("symbol", "exchange", "price_basis", "trading_date", *(f"cast({c} as decimal(28,10)) {c}" for c in ("open", "high", "low", "close")), "cast(volume as decimal(28,6)) volume")


def test_only_what_is_missing_is_written_and_once(spark, tmp_path):
    root = str(tmp_path / "years")
    b = bars(spark, range(1, 41), start="2023-12-10").unionByName(bars(spark, range(1, 41), "B", start="2023-12-10"))
    days = [day(i, "2023-12-10") for i in range(40)]
    sessions = spark.createDataFrame([("TEST", d, k + 1) for k, d in enumerate(days)], "exchange string, session_date date, ordinal int")
    universe = spark.createDataFrame([("TEST", s, days[0], None) for s in "AB"], "exchange string, symbol string, effective_from date, effective_to date")
    documented = spark.createDataFrame([("TEST", "A", days[5], "halt")], "exchange string, symbol string, session_date date, reason string")
    ask = lambda: backfill.ranges_to_ask(spark, root, sessions, universe, documented, "raw", str(days[0]), str(days[-1]), str(days[-1]))
    told = lambda df: sorted((r["symbol"], str(r["range_start"]), str(r["range_end"]), r["n"]) for r in df.collect())
    assert told(ask()) == [("A", "2023-12-10", "2023-12-14", 5), ("A", "2023-12-16", "2023-12-31", 16), ("A", "2024-01-01", "2024-01-18", 18), ("B", "2023-12-10", "2023-12-31", 22), ("B", "2024-01-01", "2024-01-18", 18)]
    first = b.where(f"symbol = 'A' or trading_date < '{days[30]}'")
    assert sorted(r["gained"] for r in backfill.backfill(spark, root, first, ask()).collect()) == [8, 18, 21, 22]
    assert told(ask()) == [("B", str(days[30]), str(days[-1]), 10)]
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}
    assert [(r["symbol"], r["year"], r["gained"]) for r in backfill.backfill(spark, root, b, ask()).collect()] == [("B", 2024, 10)]
    now = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}
    kept = {f for f in files if not ("symbol=B" in f and "year=2024" in f)}
    assert len(kept) == 3 and all(now.get(f) == files[f] for f in kept)  # the other partitions are not touched
    assert told(ask()) == [] and backfill.backfill(spark, root, b, ask()).count() == 0
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**/*.parquet", recursive=True)} == now
    table = backfill.scan_years(spark, root)
    assert table.count() == 79 and table.where("symbol = 'B'").count() == 40 and table.where(f"symbol = 'A' and trading_date = '{days[5]}'").count() == 0


def test_a_failed_backfill_leaves_the_table(spark, tmp_path):
    root = str(tmp_path / "years")
    b = bars(spark, range(1, 11))
    all_ = spark.createDataFrame([("TEST", "A", day(0), day(100))], "exchange string, symbol string, range_start date, range_end date")
    backfill.backfill(spark, root, b.where("close < 5"), all_)
    before = sorted(map(tuple, backfill.scan_years(spark, root).collect()))
    with pytest.raises(publish.LoadRejected):
        backfill.backfill(spark, root, b.unionByName(b.where("close = 9")), all_)
    with pytest.raises(Exception, match="lost"):
        backfill.backfill(spark, root, b.selectExpr(*(c if c != "volume" else "if(close = 9, cast(raise_error('lost') as decimal(28,6)), volume) volume" for c in b.columns)), all_)
    assert sorted(map(tuple, backfill.scan_years(spark, root).collect())) == before
