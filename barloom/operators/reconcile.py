"""Reconciliation of independent providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, PRICES, SERIES
from .calendar import shared_series


def volume_multiplier(src: Column, dst: Column) -> Column:
    """Factor from one unit to another, null where a unit is unspecified."""
    return F.when(src == dst, F.when(src != "unspecified", 1.0)).when((src == "shares") & (dst == "lots"), 0.01).when((src == "lots") & (dst == "shares"), 100.0)


def volume_tolerance(src: Column, dst: Column, lots_provider: Column) -> Column:
    """Rounding allowed between two units; wider where the lots side is the provider known to round coarsely."""
    coarse = lots_provider == "eastmoney"
    return F.when(src == dst, 0.0).when(dst == "lots", F.when(coarse, 2.0).otherwise(0.5)).when(src == "lots", F.when(coarse, 200.0).otherwise(50.0))


def price_difference(a: str = "", b: str = "_b") -> tuple[Column, Column]:
    """Largest absolute difference of the four prices, and relative to the least positive of all eight; null on an exact match."""
    pairs = [(F.col(p + a), F.col(p + b)) for p in PRICES]
    top = F.greatest(*(F.abs(x - y) for x, y in pairs))
    least = F.least(*(F.when(c > 0, c) for p in pairs for c in p))
    return F.when(top != 0, top), F.when(top != 0, top / least)


def reconcile_overlap(source: DataFrame, check: DataFrame, events: DataFrame, src_unit: str = "shares", check_unit: str = "lots", lots_provider: str = "other") -> DataFrame:
    """Dates that both providers have, with price and volume agreement and whether an event applies there."""
    units = (F.lit(src_unit), F.lit(check_unit))
    b = check.select(*KEY, *(F.col(c).alias(c + "_b") for c in (*PRICES, "volume")))
    by = shared_series(events, source)
    edge = events.select(*by, F.col("application_date").alias("trading_date"), F.lit(True).alias("_edge")).distinct()
    d_abs, d_rel = price_difference()
    off = F.abs(F.col("volume") * volume_multiplier(*units) - F.col("volume_b"))
    out = source.join(b, KEY).join(edge, [*by, "trading_date"], "left")
    return out.withColumn("abs_diff", d_abs).withColumn("rel_diff", d_rel).withColumn("price_match", F.col("abs_diff").isNull()).withColumn("volume_match", F.coalesce(off <= volume_tolerance(*units, F.lit(lots_provider)), F.lit(False))).withColumn("boundary", F.coalesce("_edge", F.lit(False))).drop("_edge")


def adjudicate(overlap: DataFrame, third: DataFrame) -> DataFrame:
    """Mismatches with a verdict: the third provider settles price differences only."""
    c = third.select(*KEY, *(F.col(p).alias(p + "_c") for p in PRICES))
    rows = overlap.where("not price_match or not volume_match").join(c, KEY, "left")
    as_source, as_check = F.lit(True), F.lit(True)
    for p in PRICES:
        as_source = as_source & (F.col(p) == F.col(p + "_c"))
        as_check = as_check & (F.col(p + "_b") == F.col(p + "_c"))
    verdict = F.when(F.col("price_match"), "unexplained").when(F.coalesce(as_source & ~as_check & F.col("volume_match"), F.lit(False)), "adjudicated").when(F.coalesce(as_check & ~as_source, F.lit(False)), "source_rejected").otherwise("unexplained")
    return rows.withColumn("verdict", verdict)


def reconciliation_report(overlap: DataFrame, judged: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """Per series: counts, largest differences, mismatch dates, the status and why it is blocked. Series of ``instruments`` whose
    providers share no session are blocked with ``no_overlap``."""
    base = overlap.groupBy(*SERIES).agg(F.count("*").alias("overlap"), F.count_if(F.col("boundary")).alias("boundary_dates"), F.max("abs_diff").alias("max_abs_diff"), F.max("rel_diff").alias("max_rel_diff"))
    bad = judged.groupBy(*SERIES).agg(F.count("*").alias("mismatched"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("adjudicated", "source_rejected", "unexplained")), F.array_join(F.transform(F.array_sort(F.collect_list("trading_date")), lambda d: d.cast("string")), ",").alias("mismatch_dates"))
    if instruments is not None:
        base = instruments.select(*SERIES).distinct().join(base, SERIES, "left")
    out = base.join(bad, SERIES, "left")
    counts = ("mismatched", "adjudicated", "source_rejected", "unexplained")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select(*SERIES, zero("overlap"), zero("boundary_dates"), "max_abs_diff", "max_rel_diff", *map(zero, counts), F.coalesce("mismatch_dates", F.lit("")).alias("mismatch_dates"))
    reason = F.when(F.col("overlap") == 0, "no_overlap").when(F.col("source_rejected") > 0, "source_rejected").when(F.col("unexplained") > 0, "unexplained")
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("blocked"))


def provider_independence(roles: DataFrame) -> DataFrame:
    """``(exchange, symbol, price_basis, role, provider)``: providers that fill more than one role of an instrument."""
    out = roles.groupBy("exchange", "symbol", "price_basis", "provider").agg(F.count_distinct("role").alias("roles"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("names"))
    return out.where("roles > 1")


def date_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dates that only one of two series tables has, per series."""
    keys = [*shared_series(a, b), "trading_date"]
    x = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return x.join(y, keys, "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))


def scale_equal(reported: Column, official: Column) -> Column:
    """Whether the reported value, rounded half-even to the decimal places of the official text, equals it."""
    places = F.length(F.coalesce(F.split_part(official, F.lit("."), F.lit(2)), F.lit("")))
    p = F.pow(F.lit(10), places).cast("decimal(12,0)")
    return F.bround(reported.cast("decimal(20,8)") * p) == (official.cast("decimal(20,8)") * p)
