"""Two-level scans against plain windows and loops."""

import math
import random

from helpers import bars, day
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import calendar, evaluate
from barloom.operators.prefix_scan import cut, running

SCHEMA = "s string, d int, k int, v double, block int, row string"


def made(spark, n=3000, seed=4):
    """One series of two thirds of the rows, one of null name, one of a single row; null values; columns that have the scan's own names."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "x", None]), rng.randrange(400), k, None if rng.random() < 0.2 else rng.uniform(0.9, 1.1), k, "r") for k in range(n)]
    return spark.createDataFrame(rows + [("one", 7, n, 1.5, 0, "r")], SCHEMA)


def agree(one, other):
    """The same rows; doubles to twelve digits, since blocks add and multiply in another order."""
    names = sorted(one.columns)
    assert names == sorted(other.columns)
    exact = [n for n, t in one.dtypes if t != "double"]
    rows = [sorted(df.collect(), key=lambda r: str([r[n] for n in sorted(exact)])) for df in (one, other)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows):
        assert all(a[n] == b[n] or (isinstance(a[n], float) and isinstance(b[n], float) and math.isclose(a[n], b[n], rel_tol=1e-12, abs_tol=1e-12)) for n in names), (a, b)


def test_running_equals_windows(spark):
    rows = made(spark)
    order = F.struct("d", "k")
    for falling in (False, True):
        w = Window.partitionBy("s").orderBy(*((F.col("d").desc(), F.col("k").desc()) if falling else ("d", "k")))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = rows.withColumns({"a": F.sum("v").over(upto), "b": F.max("v").over(upto), "c": F.min("v").over(upto), "e": F.product("v").over(upto), "f": F.last("v", ignorenulls=True).over(upto), "g": F.lag("v").over(w)})
        v = F.col("v")
        for blocks in (1, 2, 37):
            got = running(rows, ["s"], order, cut(rows, "d", blocks), {"a": ("sum", v), "b": ("max", v), "c": ("min", v), "e": ("product", v), "f": ("last", v), "g": ("lag", v)}, falling)
            agree(got, want)


def test_rows_without_order_and_empty_tables(spark):
    rows = made(spark, 300).withColumn("d", F.when(F.col("k") % 10 != 0, F.col("d")))
    order = F.when(F.col("d").isNotNull(), F.struct("d", "k"))
    got = running(rows, ["s"], order, cut(rows, "d", 8), {"v": ("sum", F.col("v"))})
    w = Window.partitionBy("s").orderBy("d", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.where("d is not null").withColumn("v", F.sum("v").over(w)).unionByName(rows.where("d is null").withColumn("v", F.lit(None).cast("double")))
    agree(got, want)
    none = rows.where("k < 0")
    assert running(none, [], order, cut(none, "d", 8), {"t": ("lag", F.col("v"))}).count() == 0
    nulls = rows.where("d is null")
    assert running(nulls, ["s"], order, cut(nulls, "d", 8), {"t": ("sum", F.col("v"))}).where("t is null").count() == nulls.count() > 0


def test_one_long_series_is_spread(spark):
    """One series: no block holds much more than its share, and no window sorts more than one."""
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("n"), F.lit(1).cast("decimal(10,0)").alias("v"))
    sizes = [r["count"] for r in rows.groupBy(cut(rows, "n", 64).alias("b")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 1.2 * 400_000 / 64
    got = running(rows, [], F.col("n"), cut(rows, "n", 64), {"t": ("sum", F.col("v"))})
    assert got.where("t <> n + 1").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # totals by block, rows by block; the totals of one series, 64 rows, are one partition
    assert plan.count("Exchange SinglePartition") == 1


def test_long_operators_equal_the_short_ones(spark):
    rng = random.Random(2)
    rows = [(c, f, day(f * 50 + i), rng.uniform(50, 150)) for c in "ab" for f in range(3) for i in range(80)]
    curves = spark.createDataFrame(rows, "curve string, fold int, trading_date date, equity double")
    agree(evaluate.chained_oos_curve_long(curves, "curve", blocks=9), evaluate.chained_oos_curve(curves, "curve"))
    agree(evaluate.drawdown_long(curves, "curve", "fold", blocks=9), evaluate.drawdown(curves, "curve", "fold"))
    b = bars(spark, [1.0] * 200).where(F.dayofyear("trading_date") % 7 != 0).unionByName(bars(spark, [1.0] * 3, "B"))
    events = spark.createDataFrame([(s, day(i), k) for s in "ABC" for i in range(-5, 230, 3) for k in range(2)] + [("A", None, 9)], "symbol string, effective_date date, k int")
    got, want = calendar.asof_forward_long(events, b, blocks=5), calendar.asof_forward(events, b)
    agree(got.where("effective_date is not null"), want.where("effective_date is not null"))
    assert got.where("effective_date is null and application_date is null").count() == 1
