"""Calendars as bitmaps and hash trees of series, against plain loops."""

import bisect
import random

from helpers import bars, day
from pyspark.sql import functions as F

from barloom.operators import calendar, hash_tree
from barloom.operators import rank_calendar as R


def test_ranks_and_steps_equal_a_sorted_list(spark):
    rng = random.Random(6)
    own = {"X": sorted(rng.sample(range(-300, 900), 400)), "Y": [0, 1, 63, 64, 127, 500, 1000], "Z": [5]}
    sessions = spark.createDataFrame([(e, day(i)) for e, days in own.items() for i in days], "exchange string, session_date date")
    asks = spark.createDataFrame([(e, day(i), i) for e in own for i in range(-420, 1100)] + [("none", day(0), 0)], "exchange string, d date, i int")
    d = F.col("d")
    got = R.on_calendar(asks, sessions, "exchange").select("exchange", "i", R.rank(d).alias("rank"), R.is_session(d).alias("is"), R.previous_session(d).alias("prev"), R.next_session(d).alias("next"), R.next_session(d, 3).alias("third")).collect()
    for r in got:
        days, i = own.get(r["exchange"]), r["i"]
        if days is None:
            assert r["rank"] is None and not r["is"] and r["prev"] is None and r["next"] is None
            continue
        upto, before = bisect.bisect_right(days, i), bisect.bisect_left(days, i)
        at = lambda k: day(days[k]) if 0 <= k < len(days) else None
        assert (r["rank"], r["is"], r["prev"], r["next"], r["third"]) == (upto, i in days, at(before - 1), at(upto), at(upto + 2)), r


def test_packed_calendars_shuffle_no_rows(spark, tmp_path):
    sessions = spark.createDataFrame([("X", day(i)) for i in range(0, 100, 3)], "exchange string, session_date date")
    R.pack(sessions, "exchange").write.parquet(str(tmp_path / "c"))
    packed = spark.read.parquet(str(tmp_path / "c"))
    signals = spark.createDataFrame([("X", day(i)) for i in range(100)], "exchange string, signal_date date")
    for out in (calendar.execution_schedule(signals, packed, 2), calendar.session_neighbors(signals.withColumnRenamed("signal_date", "day"), packed)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "NestedLoop" not in plan
        assert out.count() == 100


def test_one_changed_bar_is_found_by_few_hashes(spark, tmp_path):
    a = bars(spark, [100 + k % 7 for k in range(4000)], start="2010-01-01").unionByName(bars(spark, [5.0] * 50, "B", start="2010-01-01"))
    when = "2015-03-05"
    b = a.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("trading_date") == when), F.col("close") + 1e-6).otherwise(F.col("close")))
    hash_tree.series_tree(a, "close", "symbol").write.parquet(str(tmp_path / "a"))
    hash_tree.series_tree(b, "close", "symbol").write.parquet(str(tmp_path / "b"))
    one, other = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    got = hash_tree.differing_leaves(one, other, "symbol").collect()
    assert len(got) == 1 and got[0]["symbol"] == "A" and str(got[0]["first_date"]) <= when <= str(got[0]["last_date"]) and got[0]["only_in"] is None
    # The nodes whose hashes are compared: at most the children of one node a level, in place of 125 leaves.
    differs = one.join(other.withColumnRenamed("hash", "other"), ["symbol", "level", "node"]).where("hash <> other")
    assert differs.count() == hash_tree.TOP + 1
    assert hash_tree.differing_leaves(one, one, "symbol").count() == 0
    assert one.where(f"level = {hash_tree.TOP}").count() == 2


def test_missing_and_repeated_points_change_the_tree(spark):
    a = bars(spark, [1, 2, 3])
    root = lambda df: hash_tree.series_tree(df, "close", "symbol").where(f"level = {hash_tree.TOP}").first()
    base = root(a)
    assert root(a.repartition(3))["hash"] == base["hash"] and base["points"] == 3
    for other in (a.where("close < 3"), a.unionByName(a.where("close = 2")), a.withColumn("close", F.when(F.col("close") != 2, F.col("close")))):
        assert root(other)["hash"] != base["hash"]
    assert hash_tree.series_tree(a.limit(0), "close", "symbol").count() == 0
