"""Bins of intervals against plain loops."""

import datetime as dt
import random

from helpers import day
from pyspark.sql import functions as F

from barloom.operators import evaluate, intervals, provenance


def test_bins_are_disjoint_and_whole(spark):
    rng = random.Random(3)
    rows = [(k, a := rng.randrange(0, 500), a + rng.randrange(-3, 300)) for k in range(300)]
    df = spark.createDataFrame([(k, dt.date(2000, 1, 1) + dt.timedelta(a), dt.date(2000, 1, 1) + dt.timedelta(z)) for k, a, z in rows], "k int, a date, z date")
    base = (dt.date(2000, 1, 1) - dt.date(1, 1, 1)).days
    for r in df.select("k", intervals.bins_of_interval(F.col("a"), F.col("z")).alias("b")).collect():
        k, a, z = rows[r["k"]]
        days = [d for b in r["b"] for d in range(b["bin"] << b["level"], (b["bin"] + 1) << b["level"])]
        assert sorted(days) == list(range(base + a, base + z + 1)) and len(r["b"]) <= 2 * intervals.LEVELS
    open_ = df.limit(1).select(F.size(intervals.bins_of_interval(F.col("a"), F.lit(None).cast("date"))).alias("n"))
    assert open_.first()["n"] > 0


def test_days_in_intervals(spark):
    rng = random.Random(4)
    days = [(k, day(rng.randrange(400)) if k % 17 else None) for k in range(500)]
    spans = [(k, day(a := rng.randrange(-20, 420)), day(a + rng.randrange(-2, 90)) if k % 9 else None) for k in range(60)]
    got = intervals.days_in(spark.createDataFrame(days, "i int, d date"), spark.createDataFrame(spans, "j int, s date, e date"), "d", "s", "e")
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, d in days for j, s, e in spans if d and s <= d and (e is None or d <= e))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


REQUEST = "exchange string, symbol string, price_basis string, request_id int, start_date date, as_of_date date"
MANIFEST = "exchange string, symbol string, price_basis string, manifest_id string, start_date date, as_of_date date, captured_at int"


def test_covering_requests(spark):
    rng = random.Random(5)
    span = lambda most: ((a := rng.randrange(300)), a + rng.randrange(most))
    asks = [("X", rng.choice("AB"), "raw", k, *map(day, span(60))) for k in range(400)]
    have = [("X", rng.choice("AB"), "raw", f"m{k}", *map(day, span(200)), rng.randrange(20)) for k in range(150)]
    got = {r["request_id"]: r["manifest_id"] for r in provenance.covering_request(spark.createDataFrame(asks, REQUEST), spark.createDataFrame(have, MANIFEST)).collect()}
    for a in asks:
        own = [(m[6], m[3]) for m in have if m[:3] == a[:3] and m[4] <= a[4] and m[5] >= a[5]]
        assert got[a[3]] == (max(own)[1] if own else None)
    assert len(got) == 400


def test_ten_thousand_overlapping_manifests_of_one_series(spark):
    """Rows between the operators stay a fixed multiple of the input, where all pairs would be 100 million."""
    r = spark.range(10_000).selectExpr("'X' exchange", "'A' symbol", "'raw' price_basis", "cast(id as int) request_id", "date_add(date'2020-01-01', cast(id % 100 as int)) start_date", "date_add(date'2020-06-01', cast(id % 100 as int)) as_of_date")
    m = spark.range(10_000).selectExpr("'X' exchange", "'A' symbol", "'raw' price_basis", "cast(id as string) manifest_id", "date_add(date'2019-01-01', cast(id % 50 as int)) start_date", "date_add(date'2021-01-01', cast(id % 70 as int)) as_of_date", "cast(id as int) captured_at")
    out = provenance.covering_request(r, m)
    assert {x["manifest_id"] for x in out.collect()} == {"9999"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folds_pass_no_nested_loop(spark):
    curves = spark.createDataFrame([("c", day(i), 1.0) for i in range(10)], "curve string, trading_date date, equity double")
    folds = spark.createDataFrame([(1, day(0), day(4)), (2, day(3), day(20))], "fold int, test_start date, test_end date")
    got = evaluate.fold_assignment(curves, folds)
    assert sorted((r["fold"], r["trading_date"]) for r in got.collect()) == [(1, day(i)) for i in range(5)] + [(2, day(i)) for i in range(3, 10)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
