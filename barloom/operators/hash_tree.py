"""Merkle trees of series over buckets of dates: two builds of a series are compared, and the dates where they differ are found, by reading few hashes.

A leaf holds the points of 32 days, a node above it eight nodes, up to a root; all are hashed with what they hold. No series is gathered whole, and a leaf is bounded by
its days. Equal roots are equal series; below a node whose hashes agree nothing is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of a leaf and nodes of a node, as powers of two, and levels above the leaves: 2^(5 + 3 * 6) days.
LEAF, FAN, TOP = 5, 3, 6
_FIRST = "0001-01-01"


def series_tree(rows: DataFrame, value: str, *keys: str, scale: int = 6) -> DataFrame:
    """``keys, level, node, hash, points`` of every series, level 0 the leaves and TOP the root; values are first cast to a fixed scale. A null value counts as a
    point without one."""
    day = F.datediff("trading_date", F.lit(_FIRST).cast("date"))
    point = F.concat(F.col("trading_date").cast("string"), F.lit(":"), F.coalesce(F.col(value).cast(f"decimal(28,{scale})").cast("string"), F.lit("")))
    level = rows.select(*keys, F.shiftright(day, LEAF).alias("node"), point.alias("p")).groupBy(*keys, "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "|"), 256).alias("hash"), F.count("*").alias("points"))
    levels = [level.withColumn("level", F.lit(0))]
    for k in range(1, TOP + 1):
        child = F.concat_ws(":", "node", "hash")
        level = level.groupBy(*keys, F.shiftright("node", FAN).alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("node", child.alias("h"))))["h"], "|"), 256).alias("hash"), F.sum("points").alias("points"))
        levels.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, levels).select(*keys, "level", "node", "hash", "points")


def differing_leaves(one: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """``keys, first_date, last_date, only_in`` of the leaves whose hashes differ between two trees (stored, or they are built again at each level), ``only_in`` ``left``
    or ``right`` where the other has none. Descends from the roots: of a level only the children of nodes that differ are joined."""
    tree = lambda t, k, name: t.where(F.col("level") == k).select(*keys, "node", F.col("hash").alias(name))
    found = None
    for k in range(TOP, -1, -1):
        a, b = tree(one, k, "_a"), tree(other, k, "_b")
        if found is not None:
            up = found.select(*keys, F.col("node").alias("_up"))
            a, b = (t.withColumn("_up", F.shiftright("node", FAN)).join(up, [*keys, "_up"], "left_semi").drop("_up") for t in (a, b))
        found = a.join(b, [*keys, "node"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    start = F.date_add(F.lit(_FIRST).cast("date"), F.shiftleft("node", LEAF).cast("int"))
    only = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right")
    return found.select(*keys, start.alias("first_date"), F.date_add(start, (1 << LEAF) - 1).alias("last_date"), only.alias("only_in"))
