"""Running values over series of any length: two-level prefix scans.

A window without blocks puts a whole series in one task. Here the order of a series is cut into blocks: the total of each block is taken (map-side), the totals of a series, one row a
block, are run through in order, and what lies before a block enters it as a row ahead of its own, so that one window by series and block gives the running value. A series may hold
all rows of a table; what a task sorts is one block of it. The rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNNING = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product, "last": lambda c: F.last(c, ignorenulls=True)}


def cut(rows: DataFrame, order: str, blocks: int = 256) -> Column:
    """Block of each row by the quantiles of ``order`` (a number, date or timestamp) over all rows: whatever the series, no block of one holds much more than
    ``1 / blocks`` of the table, unless one value of ``order`` does. The ``blocks - 1`` bounds are read once and stay in the expression, so every scan of the rows cuts them alike."""
    asked = [k / blocks for k in range(1, blocks)]
    bounds = rows.select(F.percentile_approx(order, asked, max(10000, 50 * blocks))).first()[0] if asked else None
    bounds = sorted(set(bounds or []))
    x = F.col(order)

    def block(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        m = (a + z) // 2
        return F.when(x <= F.lit(bounds[m]), block(a, m)).otherwise(block(m + 1, z))

    return F.when(x.isNotNull(), block(0, len(bounds)))


def running(rows: DataFrame, by: list[str], order: Column, block: Column, values: dict[str, tuple[str, Column]], falling: bool = False) -> DataFrame:
    """``rows`` with a column for each of ``values``, ``name: (how, value)``, in ``order`` within each series ``by`` (none: one series), in falling order with ``falling``.
    ``how`` is ``sum``, ``max``, ``min``, ``product`` or ``last`` (the last that is not null), of all rows up to and with this one, or ``lag``, the value of the row before.

    ``block`` must not fall while ``order`` rises, and be null only where it is. Null values count for nothing, as in a window; a null in ``by`` is a value like others. Rows
    without order come back with nulls and count for nothing. Rows of one series and order are taken in any sequence. A name that ``rows`` has is replaced.
    """
    by_ = [f"by{i}" for i in range(len(by))]
    v_ = [f"v{i}" for i in range(len(values))]
    how = [h for h, _ in values.values()]
    has = order.isNotNull()
    whole = rows.select(F.struct("*").alias("row"), *(F.col(c).alias(n) for c, n in zip(by, by_)), order.alias("at"), block.alias("block"), *(F.when(has, c).alias(n) for n, (_, c) in zip(v_, values.values())))
    end = F.min_by if falling else F.max_by
    step = (lambda c: F.col(c).desc()) if falling else (lambda c: F.col(c).asc())

    def total(h: str, v: str) -> Column:
        if h == "lag":
            return end(v, "at")
        return end(v, F.when(F.col(v).isNotNull(), F.col("at"))) if h == "last" else RUNNING[h](F.col(v))

    def over(h: str, v: str, w, last: int) -> Column:
        return F.lag(v).over(w) if h == "lag" else RUNNING[h](F.col(v)).over(w.rowsBetween(Window.unboundedPreceding, last))

    totals = whole.where("at is not null").groupBy(*by_, "block").agg(*(total(h, v).alias(v) for h, v in zip(how, v_)))
    series = Window.partitionBy(*by_).orderBy(step("block"))
    carry = totals.select(*by_, "block", *(over(h, v, series, -1).alias(v) for h, v in zip(how, v_)), F.lit(0).alias("own"))
    inside = Window.partitionBy(*by_, "block").orderBy("own", step("at"))
    both = whole.withColumn("own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    out = both.select("row", "own", "at", *(over(h, v, inside, 0).alias(f"r{v}") for h, v in zip(how, v_))).where("own = 1")
    return out.select(*(F.col("row")[c].alias(c) for c in rows.columns if c not in values), *(F.when(F.col("at").isNotNull(), F.col(f"r{v}")).alias(n) for n, v in zip(values, v_)))
