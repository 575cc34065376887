"""Trailing features and target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERIES


#: Decimals of running sums: twenty places, and eighteen before the point.
SUMS = "decimal(38,20)"


def features(bars: DataFrame, average: int = 200, lags: Sequence[int] = (63, 126, 252), volatility: int = 60) -> DataFrame:
    """Bars with ``ma``, ``mom_<k>`` and ``vol``, null until each window is full. All share one sort per series.

    Sums over a window are differences of two running sums, so a row costs the same however long the window is. The sums are of decimals and so exact, whatever was
    added before: only the squares of a window's own returns are rounded. A window whose returns are all equal has a volatility of exactly zero."""
    w = Window.partitionBy(*SERIES).orderBy("trading_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def over(total: str, n: int) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, n).over(w), F.lit(0))

    rows = bars.withColumn("_c", F.col("close").cast("double")).withColumn("_rn", F.row_number().over(w)).withColumn("_r", F.col("_c") / F.lag("_c").over(w) - 1)
    # The last row whose return differs from the one before.
    rows = rows.withColumn("_new", F.when(~F.col("_r").eqNullSafe(F.lag("_r").over(w)), F.col("_rn")))
    sums = {"_sc": F.col("_c"), "_sr": F.col("_r"), "_sq": F.col("_r") * F.col("_r")}
    rows = rows.withColumns({name: F.sum(of.cast(SUMS)).over(so_far) for name, of in sums.items()} | {"_new": F.max("_new").over(so_far)})
    out = rows.withColumn("ma", F.when(F.col("_rn") >= average, over("_sc", average).cast("double") / average))
    for k in lags:
        out = out.withColumn(f"mom_{k}", F.col("_c") / F.lag("_c", k).over(w) - 1)
    mean = over("_sr", volatility).cast("double") / volatility
    spread = F.greatest(over("_sq", volatility).cast("double") / volatility - mean * mean, F.lit(0.0))
    flat = F.col("_rn") - F.col("_new") >= volatility - 1
    return out.withColumn("vol", F.when(F.col("_rn") > volatility, F.when(flat, 0.0).otherwise(F.sqrt(spread)))).drop("_c", "_rn", "_r", "_new", *sums)


def momentum_rank(rows: DataFrame, momentum: str = "mom_126", hold: int = 2) -> DataFrame:
    """The ``hold`` best eligible symbols of each date: trend, momentum and a volatility above zero; ties by symbol."""
    ok = rows.where(F.col("ma").isNotNull() & F.col(momentum).isNotNull() & (F.col("vol") > 0) & (F.col("close") >= F.col("ma")))
    w = Window.partitionBy("trading_date").orderBy(F.col(momentum).desc(), "symbol")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= hold)


def inverse_vol_weights(dates: DataFrame, ranked: DataFrame, most: float = 0.5, cash: float = 0.1) -> DataFrame:
    """``trading_date, symbol, weight`` of all ``dates``: capped inverse-volatility shares, the rest is CASH."""
    w = Window.partitionBy("trading_date")
    own = ranked.withColumn("_i", 1 / F.col("vol")).select("trading_date", "symbol", F.least(F.lit(1 - cash) * F.col("_i") / F.sum("_i").over(w), F.lit(most)).alias("weight"))
    rest = dates.select("trading_date").distinct().join(own.groupBy("trading_date").agg(F.sum("weight").alias("w")), "trading_date", "left")
    return own.unionByName(rest.select("trading_date", F.lit("CASH").alias("symbol"), (1 - F.coalesce("w", F.lit(0.0))).alias("weight")))


def monthly_targets(rows: DataFrame, momentum: str = "mom_126", hold: int = 2) -> DataFrame:
    """Weights on the last date of each month of ``rows`` (output of ``features``): ``signal_date, symbol, weight``."""
    ends = rows.groupBy(F.trunc("trading_date", "MM").alias("m")).agg(F.max("trading_date").alias("trading_date")).select("trading_date")
    at = rows.join(ends, "trading_date", "left_semi")
    return inverse_vol_weights(ends, momentum_rank(at, momentum, hold)).withColumnRenamed("trading_date", "signal_date")


def equal_weight_targets(dates: DataFrame, universe: DataFrame) -> DataFrame:
    """1/N per symbol on each date; what rounding leaves is CASH."""
    u = universe.select("symbol").distinct()
    n = u.agg(F.count("*").alias("n"))
    each = dates.select("signal_date").distinct().join(u.join(n), how="cross").select("signal_date", "symbol", (1 / F.col("n")).alias("weight"))
    return each.unionByName(each.groupBy("signal_date").agg(F.greatest(1 - F.sum("weight"), F.lit(0.0)).alias("weight")).select("signal_date", F.lit("CASH").alias("symbol"), "weight"))


def t1_signal_shift(rows: DataFrame, signal: str, *series: str, cash: float = 100000.0) -> DataFrame:
    """Long-only entry one row after the first signal, held from then on: ``entry, equity``."""
    w = Window.partitionBy(*series).orderBy("trading_date")
    moved = rows.withColumn("entry", F.coalesce(F.lag(signal).over(w), F.lit(False)))
    at = F.min(F.when(F.col("entry"), F.struct("trading_date", "close"))).over(w)
    return moved.withColumn("_at", at).withColumn("equity", F.when(F.col("_at").isNull(), F.lit(cash)).otherwise(cash * F.col("close") / F.col("_at.close"))).drop("_at")


def walk_forward_splits(dates: DataFrame, train: int, test: int) -> DataFrame:
    """Rolling splits by position: step ``test``, while a whole split fits."""
    # One row per distinct date of a calendar: numbered in one task, bounded by the days of history.
    d = dates.select("trading_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trading_date")) - 1)
    n = d.agg(F.count("*").alias("n")).where(F.col("n") >= train + test)
    k = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - (train + test)) / test).cast("long"))).alias("split"))
    ends = k.select("split", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.col("split") * test + off).alias("i")) for name, off in (("train_start", 0), ("train_end", train - 1), ("test_start", train), ("test_end", train + test - 1))))).alias("e")).select("split", "e.*")
    return ends.join(d.withColumn("i", F.col("i").cast("long")), "i").groupBy("split").agg(*(F.min(F.when(F.col("name") == c, F.col("trading_date"))).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")))


def edge_trim(rows: DataFrame, first: int, last: int, *key: str) -> DataFrame:
    """Without the first and last dates of each key."""
    up, down = Window.partitionBy(*key).orderBy("trading_date"), Window.partitionBy(*key).orderBy(F.col("trading_date").desc())
    return rows.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down)).where((F.col("_a") > first) & (F.col("_z") > last)).drop("_a", "_z")


def price_discontinuity(bars: DataFrame, jump: float = 0.2) -> DataFrame:
    """Bars whose close moves by more than ``jump``, and those right after one: ``move, jumped, near``."""
    w = Window.partitionBy(*SERIES).orderBy("trading_date")
    out = bars.withColumn("move", F.col("close") / F.lag("close").over(w) - 1).withColumn("jumped", F.coalesce(F.abs("move") > jump, F.lit(False)))
    return out.withColumn("near", F.col("jumped") | F.coalesce(F.lag("jumped").over(w), F.lit(False))).where("near")


