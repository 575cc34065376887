import pytest
from helpers import bars, day, events
from pyspark.sql import functions as F

from barloom.operators import adjust, features


def test_ramp(spark):
    rows = features.features(bars(spark, range(1, 254))).orderBy("trading_date").collect()
    assert rows[198]["ma"] is None and rows[199]["ma"] == 100.5
    assert rows[62]["mom_63"] is None and rows[63]["mom_63"] == 63
    assert rows[252]["mom_252"] == 252
    assert rows[59]["vol"] is None and rows[60]["vol"] is not None


def test_split_and_cash(spark):
    b = bars(spark, [10, 5])
    e = events(spark, [("A", day(1), 2.0, None)])
    assert [(r["close"], r["factor"]) for r in adjust.backward_adjust(b, e).orderBy("trading_date").collect()] == [(5, 0.5), (5, 1)]
    assert [(r["close"], r["factor"]) for r in adjust.forward_adjust(b, e).orderBy("trading_date").collect()] == [(10, 1), (10, 2)]
    c = events(spark, [("A", day(1), None, 1.0)])
    assert [r["factor"] for r in adjust.forward_adjust(bars(spark, [10, 9]), c).orderBy("trading_date").collect()] == pytest.approx([1, 10 / 9])
    assert adjust.cash_errors(bars(spark, [10, 9]), events(spark, [("A", day(1), None, 10.0)])).count() == 1


def test_action_on_a_closed_day(spark):
    b = bars(spark, [10, 10, 5]).where(F.col("trading_date") != F.lit(day(1)))
    assert [r["factor"] for r in adjust.forward_adjust(b, events(spark, [("A", day(1), 2.0, None)])).orderBy("trading_date").collect()] == [1, 2]


def test_later_action_leaves_earlier_rows(spark):
    b = bars(spark, [10 + i / 100 for i in range(260)])
    none, late = events(spark, []), events(spark, [("A", day(259), None, 1.0)])
    x, y = adjust.forward_adjust(b, none), adjust.forward_adjust(b, late)
    assert adjust.changed_rows(x.where(F.col("trading_date") < F.lit(day(259))), y, "close").count() == 0
    assert adjust.changed_rows(x, y, "close").count() == 1


def test_factor_changes(spark):
    s = spark.createDataFrame([("A", day(0), 1.0, 0.5), ("A", day(5), 2.0, 0.5), ("A", day(9), 2.0, 0.75)], "symbol string, day date, split double, cash double")
    got = adjust.factor_change_points(s).orderBy("day").collect()
    assert [(r["split_ratio"], r["cash_per_unit"]) for r in got] == [(None, 0.5), (2.0, None), (None, 0.25)]


def test_weights_add_up_and_cap(spark):
    rows = spark.createDataFrame([("A", 0.1), ("B", 0.3)], "symbol string, vol double").withColumn("trading_date", F.lit(day(0)))
    dates = spark.createDataFrame([(day(0),), (day(1),)], "trading_date date")
    got = {(r["trading_date"], r["symbol"]): r["weight"] for r in features.inverse_vol_weights(dates, rows).collect()}
    assert got[(day(0), "A")] == 0.5 and got[(day(0), "B")] == pytest.approx(0.225)
    assert got[(day(0), "CASH")] == pytest.approx(0.275) and got[(day(1), "CASH")] == 1


def test_rank_ties_by_symbol(spark):
    rows = spark.createDataFrame([("B", 1.0, 1.0, 2.0, 1.0), ("A", 1.0, 1.0, 2.0, 1.0), ("C", 2.0, 0.0, 2.0, 1.0), ("D", 3.0, 1.0, 0.5, 1.0)], "symbol string, mom_126 double, vol double, close double, ma double").withColumn("trading_date", F.lit(day(0)))
    assert [r["symbol"] for r in features.momentum_rank(rows, hold=1).collect()] == ["A"]


def test_walk_forward_positions(spark):
    d = spark.createDataFrame([(day(i),) for i in range(10)], "trading_date date")
    got = features.walk_forward_splits(d, 4, 2).orderBy("split").collect()
    assert [(r["train_start"], r["train_end"], r["test_start"], r["test_end"]) for r in got] == [(day(k), day(k + 3), day(k + 4), day(k + 5)) for k in (0, 2, 4)]
    assert features.walk_forward_splits(d, 9, 2).count() == 0


def test_t1_shift(spark):
    b = bars(spark, [10, 20, 30, 60]).withColumn("signal", F.col("close") == 20)
    got = features.t1_signal_shift(b, "signal", "symbol").orderBy("trading_date").collect()
    assert [r["entry"] for r in got] == [False, False, True, False]
    assert [r["equity"] for r in got] == [100000, 100000, 100000, 200000]


def test_adjustment_refuses_bad_events(spark):
    b = bars(spark, [10, 9, 8])
    two = events(spark, [("A", day(1), 2.0, None), ("A", day(1), None, 1.0)])
    for e, why in ((two, "two events"), (events(spark, [("A", day(9), 2.0, None)]), "no session follows"), (events(spark, [("A", day(0), 2.0, None)]), "first bar"), (events(spark, [("A", day(1), None, 10.0)]), "previous close")):
        for f in (adjust.forward_adjust, adjust.backward_adjust):
            with pytest.raises(Exception, match=why):
                f(b, e).collect()
    with pytest.raises(Exception, match="only raw"):
        adjust.forward_adjust(b.withColumn("price_basis", F.lit("qfq")), events(spark, [])).collect()


def test_series_of_one_symbol_are_adjusted_apart(spark):
    b = bars(spark, [10, 5, 5]).unionByName(bars(spark, [20, 10], exchange="OTHER"))
    e = events(spark, [("A", day(1), 2.0, None)])
    got = {(r["exchange"], r["trading_date"]): r["factor"] for r in adjust.forward_adjust(b, e).collect()}
    assert got == {("TEST", day(0)): 1, ("TEST", day(1)): 2, ("TEST", day(2)): 2, ("OTHER", day(0)): 1, ("OTHER", day(1)): 2}


def test_long_series_take_linear_time(spark):
    """One series of 100,000 bars, as a hot key would be."""
    import time

    n = 100_000
    b = spark.range(n).selectExpr("'A' as symbol", "'T' as exchange", "'raw' as price_basis", "date_add(date'1700-01-01', cast(id as int)) as trading_date", "10.0D as open", "10.0D as high", "10.0D as low", "10.0D as close", "1.0D as volume")
    e = b.where("dayofyear(trading_date) = 200").selectExpr("symbol", "trading_date as effective_date", "1.0D as split_ratio", "cast(null as double) as cash_per_unit")
    began = time.perf_counter()
    assert adjust.backward_adjust(b, e).where("factor = 1").count() == n and adjust.forward_adjust(b, e).where("factor = 1").count() == n
    assert time.perf_counter() - began < 60


def test_running_sums_equal_sliding_frames(spark):
    """Windows of many lengths against frames evaluated row by row: noise, jumps of a thousand, tiny prices, and stretches without any change."""
    import random

    from pyspark.sql import Window

    rng = random.Random(2)
    closes = {"noise": [], "jumps": [], "tiny": [], "flat": [5.0] * 400, "steps": []}
    for k in range(400):
        closes["noise"].append((closes["noise"] or [100.0])[-1] * (1 + rng.uniform(-0.03, 0.03)))
        closes["jumps"].append(rng.choice((0.5, 1.0, 900.0)) * rng.uniform(0.9, 1.1))
        closes["tiny"].append(1e-4 * rng.uniform(0.9, 1.1))
        closes["steps"].append(10.0 if k % 150 < 100 else 10.0 + rng.random())
    b = None
    for name, own in closes.items():
        b = bars(spark, own, name) if b is None else b.unionByName(bars(spark, own, name))
    w = Window.partitionBy("exchange", "symbol", "price_basis").orderBy("trading_date")
    r = b.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("rn", F.row_number().over(w))
    for n, v in ((200, 60), (2, 2), (350, 390)):
        want = {(x["symbol"], x["trading_date"]): x for x in r.withColumn("ma", F.when(F.col("rn") >= n, F.avg("close").over(w.rowsBetween(1 - n, 0)))).withColumn("vol", F.when(F.col("rn") > v, F.stddev_pop("r").over(w.rowsBetween(1 - v, 0)))).collect()}
        for x in features.features(b, n, (), v).collect():
            y = want[x["symbol"], x["trading_date"]]
            for c in ("ma", "vol"):
                assert (x[c] is None) == (y[c] is None) and (x[c] is None or x[c] == pytest.approx(y[c], rel=1e-11, abs=1e-12)), (x, y)
            if x["symbol"] == "flat":
                assert x["vol"] in (None, 0.0)


def test_long_windows_cost_no_more(spark):
    import time

    b = spark.range(200_000).selectExpr("'A' symbol", "'X' exchange", "'raw' price_basis", "date_add(date'1500-01-01', cast(id as int)) trading_date", "100 + id % 17 + rand(3) close").persist()
    b.count()
    took = {}
    for n in (10, 10, 5000, 10, 5000):
        began = time.perf_counter()
        features.features(b, n, (), n).write.format("noop").mode("overwrite").save()
        took[n] = min(took.get(n, 1e9), time.perf_counter() - began)
    b.unpersist()
    assert took[5000] < 2.5 * took[10], took
