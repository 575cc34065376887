"""Backfill of missing sessions, idempotent: only what the stored bars lack is taken, and only the partitions that gain a bar are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import coverage_missing, missing_session_ranges
from ..operators.intervals import days_in
from ..schema import BAR, KEY, SERIES
from .publish import _files, load_whole
from .workdir import stored

#: A partition is a year of a series.
PARTITION = [*SERIES, "year"]


def scan_years(spark: SparkSession, root: str) -> DataFrame:
    """The bars stored under ``root``, with the year of their partition; no bars where nothing is stored yet."""
    files, at = _files(spark.range(0), root)
    schema = T.StructType([*BAR.fields, T.StructField("year", T.IntegerType())])
    if not files.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(root)


def ranges_to_ask(spark: SparkSession, root: str, sessions: DataFrame, universe: DataFrame, documented: DataFrame, basis: str, start: str, as_of: str, latest: str) -> DataFrame:
    """``exchange, symbol, range_start, range_end, n``: runs of expected sessions without a stored bar of ``basis`` and without a documented absence, cut at the ends of calendar years, as
    providers are asked by year."""
    have = scan_years(spark, root).where(F.col("price_basis") == basis)
    gaps = coverage_missing(have, sessions, universe, documented, start, as_of, latest)
    whole = missing_session_ranges(gaps, sessions)
    years = F.sequence(F.year("range_start"), F.year("range_end"))
    cut = whole.withColumn("year", F.explode(years)).withColumn("a", F.greatest("range_start", F.make_date("year", F.lit(1), F.lit(1)))).withColumn("z", F.least("range_end", F.make_date("year", F.lit(12), F.lit(31))))
    inside = days_in(sessions.select(F.col("exchange").alias("_exchange"), "session_date").distinct(), cut.drop("range_start", "range_end", "n"), "session_date", "a", "z").where("_exchange = exchange")
    return inside.groupBy("exchange", "symbol", "a", "z").agg(F.min("session_date").alias("range_start"), F.max("session_date").alias("range_end"), F.count("*").alias("n")).drop("a", "z")


def backfill(spark: SparkSession, root: str, fetched: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds the bars of ``fetched`` that lie in ``ranges`` (of ``ranges_to_ask``) and are not stored, and returns the partitions that were written with the number of bars
    they gained: ``PARTITION, gained``.

    ``fetched`` is loaded whole or not at all. Of the partitions that gain a bar, the old and new bars together are first written aside, then replace them, partition
    by partition, by Spark's dynamic overwrite, which moves finished files into place; all others are not touched. Running it again finds nothing missing and writes nothing. A run
    that breaks off before the last step leaves the table as it was; one that breaks off within it leaves partitions each of the old or the new version, or for the moment of its
    move a gap, and the next run fills in what is lacking."""
    loaded = load_whole(fetched.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in BAR.fields)))
    wanted = days_in(loaded, ranges.select(F.col("exchange").alias("_exchange"), F.col("symbol").alias("_symbol"), "range_start", "range_end"), "trading_date", "range_start", "range_end").where("_exchange = exchange and _symbol = symbol")
    have = scan_years(spark, root)
    fresh = wanted.select(*BAR.names).withColumn("year", F.year("trading_date")).join(have.select(*KEY), KEY, "left_anti")
    fresh = stored(fresh, "backfill-fresh")
    gained = stored(fresh.groupBy(*PARTITION).agg(F.count("*").alias("gained")), "backfill-gained")
    if not gained.isEmpty():
        merged = stored(have.join(gained.select(*PARTITION), PARTITION, "left_semi").select(*fresh.columns).unionByName(fresh), "backfill-merged")
        merged.repartition(*PARTITION).sortWithinPartitions(*PARTITION, "trading_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PARTITION).parquet(root)
    return gained
