"""Joins of dates and intervals by hierarchical bins, as equi-joins.

Days are numbered; bin ``i`` of level ``k`` holds the days from ``i * 2^k`` on, 2^k of them. An interval is the disjoint union of at most two bins a level; a
day lies in one bin of each. So a day lies in an interval if, and only once if, one of its bins is one of the interval's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of bins: days up to the year 9999, from the year 1 on.
LEVELS = 22
_FIRST = "0001-01-01"


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(_FIRST).cast("date"))


def bins_of_interval(start: Column, end: Column) -> Column:
    """The bins ``(level, bin)`` whose disjoint union is the days from ``start`` to ``end``; none if it is empty. A null end is open."""
    a, z = day_number(start), F.coalesce(day_number(end), F.lit((1 << LEVELS) - 2)) + 1
    bins = []
    for k in range(LEVELS):
        low, high = F.shiftright(a + ((1 << k) - 1), k), F.shiftright(z, k)
        odd = low.bitwiseAND(1)
        bins.append(F.when((odd == 1) & (low < high), F.struct(F.lit(k).alias("level"), low.alias("bin"))))
        bins.append(F.when((high.bitwiseAND(1) == 1) & (low + odd < high), F.struct(F.lit(k).alias("level"), (high - 1).alias("bin"))))
    return F.array_compact(F.array(*bins))


def bins_of_day(day: Column) -> Column:
    """The bins ``(level, bin)`` that hold a day, one a level."""
    n = day_number(day)
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(n, k).alias("bin")) for k in range(LEVELS)))


def days_in(days: DataFrame, intervals: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """``days`` joined with the ``intervals`` that hold their ``day`` (both ends included). Only distinct days meet the bins, so rows pass an equi-join on the day
    alone; null days, and intervals that end before they start, have no match."""
    bins = intervals.withColumn("_b", F.explode(bins_of_interval(F.col(start), F.col(end)))).select("*", "_b.level", "_b.bin").drop("_b")
    own = days.select(day).where(F.col(day).isNotNull()).distinct().withColumn("_b", F.explode(bins_of_day(F.col(day)))).select(day, "_b.level", "_b.bin")
    return days.join(own.join(bins, ["level", "bin"]).drop("level", "bin"), day)


def latest_covering(requests: DataFrame, intervals: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """``request_id, value``: for each ``requests(by, request_id, start, end)`` the ``value`` of the last interval by ``(order, value)`` among ``intervals(by, start, end)`` that
    contain it; requests that none contains are left out.

    The intervals that start no later are those in the bins of the days up to the request's start: each interval stands in one bin a level, and a request looks in
    one a level at most. In a bin, intervals and requests are put in falling order of their ends, and a running maximum tells the last one that
    ends no earlier. Both sides are multiplied by the levels, never by each other, however many intervals overlap."""
    best = F.struct(F.col(order).alias("order"), F.col(value).alias("value"))
    none = F.lit(None).cast(intervals.select(best.alias("b")).schema["b"].dataType)
    have = intervals.where("start is not null and end is not null").select(*by, F.explode(bins_of_day(F.col("start"))).alias("_b"), "end", F.lit(0).alias("_asks"), best.alias("_best"), F.lit(None).cast(dict(requests.dtypes)["request_id"]).alias("request_id"))
    asks = requests.where("end >= start").select(*by, F.explode(bins_of_interval(F.lit(_FIRST).cast("date"), F.col("start"))).alias("_b"), "end", F.lit(1).alias("_asks"), none.alias("_best"), "request_id")
    falling = Window.partitionBy(*by, "_b").orderBy(F.col("end").desc(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = have.unionByName(asks).withColumn("_best", F.max("_best").over(falling)).where("_asks = 1 and _best is not null")
    return found.groupBy("request_id").agg(F.max("_best").alias("_best")).select("request_id", F.col("_best.value").alias(value))
