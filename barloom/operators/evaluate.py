"""Curve metrics, relative metrics and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import days_in
from .prefix_scan import cut, running

YEAR = 252


def _by(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("trading_date")


def daily_returns(curves: DataFrame, *keys: str) -> DataFrame:
    return curves.withColumn("ret", F.col("equity") / F.lag("equity").over(_by(keys)) - 1).where("ret is not null")


def drawdown(curves: DataFrame, *keys: str) -> DataFrame:
    top = F.max("equity").over(_by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return curves.withColumn("dd", F.col("equity") / top - 1)


def drawdown_long(curves: DataFrame, *keys: str, date: str = "trading_date", tie: str | None = None, blocks: int = 256) -> DataFrame:
    """``drawdown`` for curves too long for one task: the high so far by a two-level scan over blocks of ``date``. ``tie`` orders the rows of one date."""
    order = F.col(date) if tie is None else F.when(F.col(date).isNotNull(), F.struct(date, tie))
    out = running(curves, list(keys), order, cut(curves, date, blocks), {"dd": ("max", F.col("equity"))})
    return out.withColumn("dd", F.col("equity").cast("double") / F.col("dd").cast("double") - 1)


def drawdown_streak(curves: DataFrame, *keys: str) -> DataFrame:
    """Longest run of rows below the high so far."""
    d = drawdown(curves, *keys).withColumn("island", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(_by(keys)))
    return d.groupBy(*keys, "island").agg(F.count_if(F.col("dd") < 0).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_drawdown"))


def calendar_year_returns(curves: DataFrame, *keys: str) -> DataFrame:
    """Returns from one year end to the next; the first year drops out."""
    ends = curves.groupBy(*keys, F.year("trading_date").alias("year")).agg(F.max_by("equity", "trading_date").alias("end"))
    w = Window.partitionBy(*keys).orderBy("year")
    return ends.withColumn("year_return", F.col("end") / F.lag("end").over(w) - 1).where("year_return is not null").drop("end")


def _ratio(mean: Column, dev: Column) -> Column:
    """Annualised mean over deviation; without deviation infinite for gains, else zero."""
    none = F.coalesce(dev, F.lit(0.0)) == 0
    return F.when(~none, mean / dev * F.sqrt(F.lit(float(YEAR)))).when(mean > 0, F.lit(float("inf"))).otherwise(0.0)


def curve_metrics(curves: DataFrame, *keys: str) -> DataFrame:
    """One row per curve; risk-free rate zero, 252 days a year, population deviations. Returns, running high and runs below
    it share one sort; the rows of a run and the years are summed before they meet."""
    w = _by(keys)
    rows = curves.withColumn("ret", F.col("equity") / F.lag("equity").over(w) - 1).withColumn("dd", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("island", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(w))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min_by("equity", "trading_date").alias("first"), F.max_by("equity", "trading_date").alias("last"),
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.min("dd").alias("max_drawdown"),
    )
    runs = rows.groupBy(*keys, "island").agg(F.count_if(F.col("dd") < 0).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_drawdown"))
    y = calendar_year_returns(curves, *keys).groupBy(*keys).agg(F.max("year_return").alias("best"), F.min("year_return").alias("worst"))
    keys_ = list(keys)
    out = base.join(runs, keys_).join(y, keys_, "left")
    total = F.col("last") / F.col("first") - 1
    cagr = F.pow(F.col("last") / F.col("first"), F.lit(float(YEAR)) / (F.col("points") - 1)) - 1
    out = out.withColumn("total_return", total).withColumn("cagr", cagr).withColumn("volatility", F.col("sd") * F.sqrt(F.lit(float(YEAR))))
    out = out.withColumn("sharpe", _ratio(F.col("mean"), F.col("sd"))).withColumn("sortino", _ratio(F.col("mean"), F.col("down")))
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(F.lit(float("inf"))))
    return out.select(*keys, "points", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "longest_drawdown", F.coalesce("best", "total_return").alias("best_year"), F.coalesce("worst", "total_return").alias("worst_year"))


def execution_stats(curves: DataFrame, *keys: str) -> DataFrame:
    """Share of days invested, mean and largest cash weight of ``curves(cash_weight)``."""
    return curves.groupBy(*keys).agg(F.avg((F.col("cash_weight") < 1).cast("double")).alias("time_in_market"), F.avg("cash_weight").alias("mean_cash_weight"), F.max("cash_weight").alias("max_cash_weight"))


def trade_stats(rolled: DataFrame, *keys: str) -> DataFrame:
    day = rolled.groupBy(*keys, "execution_date").agg(F.first("turnover").alias("turnover"), F.sum("cost").alias("cost"))
    return day.groupBy(*keys).agg(F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost_total"), F.count("*").alias("rebalances"))


def unmatched_dates(curves: DataFrame, benchmark: DataFrame, keys: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """Dates that a curve has and its benchmark lacks, or the benchmark of the same ``on`` values has and the curve lacks: ``keys,
    trading_date, only_in``. Curves with such dates cannot be compared day by day."""
    own = curves.select(*keys, "trading_date").distinct().withColumn("_a", F.lit(True))
    base = benchmark.select(*on, "trading_date").distinct().join(curves.select(*keys).distinct(), list(on)).withColumn("_b", F.lit(True))
    both = own.join(base, [*keys, "trading_date"], "full_outer").where("_a is null or _b is null")
    return both.select(*keys, "trading_date", F.when(F.col("_b").isNull(), "curve").otherwise("benchmark").alias("only_in"))


def active_returns(curves: DataFrame, benchmark: DataFrame, keys: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """Daily differences on the dates that both have; ``unmatched_dates`` tells the others."""
    b = daily_returns(benchmark, *on).select(*on, "trading_date", F.col("ret").alias("bench_ret"))
    return daily_returns(curves, *keys).join(b, [*on, "trading_date"]).withColumn("active", F.col("ret") - F.col("bench_ret"))


def relative_metrics(curves: DataFrame, benchmark: DataFrame, keys: tuple[str, ...], on: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Differences of each curve's metrics to those of the benchmark with the same ``on`` values (some of ``keys``),
    and the tracking error. ``strict``: a curve whose dates are not those of its benchmark ends the job (``unmatched_dates`` lists them); else
    the tracking error is that of the dates that both have."""
    if strict:
        bad = unmatched_dates(curves, benchmark, keys, on).groupBy(*keys).agg(F.count("*").alias("_n"))
        what = F.concat_ws(" ", F.lit("a curve and its benchmark have other dates:"), *(F.col(k).cast("string") for k in keys))
        curves = curves.join(bad, list(keys), "left").where(F.when(F.col("_n").isNull(), True).otherwise(F.raise_error(what).cast("boolean"))).drop("_n")
    own = curve_metrics(curves, *keys)
    base = curve_metrics(benchmark, *on).select(*on, *(F.col(c).alias("b_" + c) for c in ("cagr", "sharpe", "max_drawdown")))
    error = active_returns(curves, benchmark, keys, on).groupBy(*keys).agg((F.stddev_pop("active") * F.sqrt(F.lit(float(YEAR)))).alias("tracking_error"))
    out = own.join(base, list(on)).join(error, list(keys))
    return out.select(*keys, (F.col("cagr") - F.col("b_cagr")).alias("excess_cagr"), (F.col("sharpe") - F.col("b_sharpe")).alias("sharpe_difference"), (F.col("max_drawdown") - F.col("b_max_drawdown")).alias("drawdown_difference"), "tracking_error")


def fold_summary(folds: DataFrame, *keys: str) -> DataFrame:
    """Of ``folds(fold, excess)``: median, share above zero, worst (first on ties) and best fold (last on ties)."""
    return folds.groupBy(*keys).agg(F.median("excess").alias("median_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("positive_share"), F.min_by("fold", F.struct("excess", "fold")).alias("worst_fold"), F.max_by("fold", F.struct("excess", "fold")).alias("best_fold"))


def gain_concentration(active: DataFrame, k: int, *keys: str) -> DataFrame:
    """Share of all positive active return that the k largest days hold; 1 where there is none."""
    w = Window.partitionBy(*keys).orderBy(F.col("active").desc(), "trading_date")
    pos = active.where("active > 0").withColumn("rn", F.row_number().over(w)).groupBy(*keys).agg((F.sum(F.when(F.col("rn") <= k, F.col("active"))) / F.sum("active")).alias("concentration"))
    return active.select(*keys).distinct().join(pos, list(keys), "left").withColumn("concentration", F.coalesce("concentration", F.lit(1.0)))


def neighborhood_rule(neighbors: DataFrame, least_median: float, least_count: int, *keys: str) -> DataFrame:
    out = neighbors.groupBy(*keys).agg(F.median("excess").alias("median_excess"), F.count_if(F.col("excess") >= 0).alias("not_negative"))
    return out.withColumn("robust", (F.col("median_excess") >= least_median) & (F.col("not_negative") >= least_count))


def outcome_classification(evidence: DataFrame, integrity: str, *tests: str) -> DataFrame:
    every = F.lit(True)
    for t in tests:
        every = every & F.coalesce(F.col(t), F.lit(False))
    return evidence.withColumn("outcome", F.when(~F.coalesce(F.col(integrity), F.lit(False)), "INVALID").when(every, "ROBUST").otherwise("NO_EVIDENCE"))


def chained_oos_curve(curves: DataFrame, *keys: str, start: float = 100000.0) -> DataFrame:
    """Fold curves in a row, compounded from ``start``; each fold's first return is zero."""
    r = curves.withColumn("ret", F.coalesce(F.col("equity") / F.lag("equity").over(Window.partitionBy(*keys, "fold").orderBy("trading_date")) - 1, F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("fold", "trading_date").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("chained", start * F.product(1 + F.col("ret")).over(w))


def chained_oos_curve_long(curves: DataFrame, *keys: str, start: float = 100000.0, blocks: int = 256) -> DataFrame:
    """``chained_oos_curve`` for curves too long for one task: returns and their product by two-level scans over blocks of dates in each fold."""
    order, block = F.when(F.col("trading_date").isNotNull(), F.struct("fold", "trading_date")), F.when(F.col("trading_date").isNotNull(), F.struct("fold", cut(curves, "trading_date", blocks).alias("b")))
    r = running(curves, list(keys), order, block, {"_before": ("lag", F.struct("fold", "equity"))})
    same = F.col("_before.fold").eqNullSafe(F.col("fold"))
    r = r.withColumn("ret", F.coalesce(F.when(same, F.col("equity") / F.col("_before.equity") - 1), F.lit(0.0))).drop("_before")
    return running(r, list(keys), order, block, {"chained": ("product", 1 + F.col("ret"))}).withColumn("chained", start * F.col("chained"))


def fold_assignment(curves: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows within each fold's test interval."""
    return days_in(curves, folds.select("fold", "test_start", "test_end"), "trading_date", "test_start", "test_end")


def fold_bounds(assigned: DataFrame, *keys: str) -> DataFrame:
    """Whether a fold's first and last rows are its declared bounds."""
    return assigned.groupBy(*keys, "fold").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.first("test_start").alias("s"), F.first("test_end").alias("e")).withColumn("compatible", (F.col("first_date") == F.col("s")) & (F.col("last_date") == F.col("e"))).drop("s", "e")
