"""Daily bars and their companions derived from the star-schema tables.

Prices are those of lineitem rows; a day's first and last row are told by a total order of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"


def weekday(c: Column | str) -> Column:
    return F.weekday(c) < 5


def _bars(rows: DataFrame, symbol: Column) -> DataFrame:
    px = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000 + 0.5) / 10000
    rows = rows.select(symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("trading_date"), px.alias("px"), F.struct(*ORDER).alias("k"), "l_quantity").where(weekday("trading_date"))
    day = rows.groupBy("symbol", "trading_date").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"))
    return day.select("symbol", F.when(F.col("symbol") < "M", "SSE").otherwise("SZSE").alias("exchange"), F.lit("raw").alias("price_basis"), "trading_date", "open", "high", "low", "close", "volume")


def bars_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per part type."""
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    return _bars(line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"), F.col("p_type"))


def bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier."""
    return _bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_suppkey").cast("string"))


def closures(spark: SparkSession) -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(date'{FIRST_DAY}', date'{LAST_DAY}')) AS session_date")
    return days.where(weekday("session_date") & (F.dayofmonth("session_date") == 1) & F.month("session_date").isin(1, 5, 10))


def universe(bars: DataFrame) -> DataFrame:
    """Effective from the first bar on; the last symbol ends at 2000-12-29."""
    w = Window.orderBy(F.col("symbol").desc())
    u = bars.groupBy("exchange", "symbol").agg(F.min("trading_date").alias("effective_from"))  # a row per instrument
    return u.withColumn("effective_to", F.when(F.row_number().over(w) == 1, F.to_date(F.lit("2000-12-29")))).withColumn("currency", F.lit("CNY"))


def bars_b(bars: DataFrame) -> DataFrame:
    """A cross-checking provider in lots, with dates left out and closes that differ."""
    doy, off = F.dayofyear("trading_date"), F.dayofyear("trading_date") % 97 == 0
    close = F.when(off, F.floor((F.col("close") + 0.01) * 10000 + 0.5) / 10000).otherwise(F.col("close"))
    out = bars.where(doy % 53 != 0).withColumn("c", close)
    return out.withColumn("high", F.greatest("high", "c")).withColumn("close", F.col("c")).withColumn("volume", F.floor(F.col("volume") * 0.01 + 0.5)).drop("c")


def bars_c(bars: DataFrame) -> DataFrame:
    """An adjudicating provider: as the source, but as ``bars_b`` on day 291."""
    b = bars_b(bars)
    return bars.where(F.dayofyear("trading_date") != 291).unionByName(b.where(F.dayofyear("trading_date") == 291).withColumn("volume", F.col("volume") * 100))


def ledger(bars: DataFrame) -> DataFrame:
    """Every 250th bar of a symbol: splits of 2 and cash of about one percent in turn; every fifth event a candidate."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    rows = bars.select("symbol", "exchange", "trading_date", F.row_number().over(w).alias("rn"), F.lag("close").over(w).alias("prev")).where("rn % 250 = 0").withColumn("k", (F.col("rn") / 250).cast("int"))
    split = F.col("k") % 2 == 1
    return rows.select(
        F.concat("symbol", F.lit("_v1")).alias("ledger_id"), "symbol", "exchange", F.concat_ws("-", "symbol", "k").alias("event_id"), F.col("trading_date").alias("effective_date"),
        F.when(split, "split").otherwise("cash").alias("kind"), F.when(~split, F.floor(F.col("prev") * 100 + 0.5) / 10000).alias("cash_per_unit"), F.when(split, F.lit(2.0)).alias("split_ratio"),
        F.date_sub("trading_date", 1).alias("record_date"), F.date_add("trading_date", 5).alias("payment_date"), F.date_sub("trading_date", 20).alias("announced_on"), F.when(F.col("k") % 5 == 0, "candidate").otherwise("verified").alias("status"), "k",
    )


def candidates(bars: DataFrame) -> DataFrame:
    """What a provider reports of the ledger: each fourth missing, each third a bar later, one event too many."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    nxt = bars.select("symbol", F.col("trading_date").alias("effective_date"), F.lead("trading_date").over(w).alias("next_date"))
    own = ledger(bars).where("k % 4 <> 0").join(nxt, ["symbol", "effective_date"], "left")
    day = F.when(F.col("k") % 3 == 0, F.coalesce("next_date", "effective_date")).otherwise(F.col("effective_date"))
    own = own.select("symbol", F.concat(F.lit("c-"), F.col("event_id")).alias("candidate_id"), day.alias("candidate_date"), "kind", F.coalesce("split_ratio", "cash_per_unit").alias("value"))
    more = bars.groupBy("symbol").agg(F.date_add(F.max("trading_date"), -3).alias("candidate_date")).select("symbol", F.concat(F.lit("c-"), F.col("symbol"), F.lit("-extra")).alias("candidate_id"), "candidate_date", F.lit("split").alias("kind"), F.lit(3.0).alias("value"))
    return own.unionByName(more)


def crowded_ledger(bars: DataFrame) -> DataFrame:
    """Three events on neighbouring bars of every twenty, of one kind and value, so that they want the same candidates: ``event_id, effective_date,
    application_date, kind, official_value``."""
    return crowded(bars).where("place between 5 and 7").select("exchange", "symbol", F.concat_ws("-", "symbol", "rn").alias("event_id"), F.col("trading_date").alias("effective_date"), F.col("trading_date").alias("application_date"), "kind", F.when(F.col("kind") == "cash", "0.25").otherwise("2.0").alias("official_value"))


def crowded(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("exchange", "symbol").orderBy("trading_date")
    rows = bars.select("exchange", "symbol", "trading_date", F.row_number().over(w).alias("rn"))
    rows = rows.withColumn("place", F.col("rn") % 20).withColumn("block", F.floor(F.col("rn") / 20))
    return rows.withColumn("kind", F.when(F.col("block") % 5 == 4, "cash").otherwise("split"))


def crowded_candidates(bars: DataFrame) -> DataFrame:
    """Candidates on some of the bars of ``crowded_ledger`` and the one after, each choice of the four in turn; in every seventh block two on one bar."""
    rows = crowded(bars).where("place between 5 and 8 and (shiftright(cast(block % 16 as int), cast(place - 5 as int)) & 1) = 1")
    own = rows.withColumn("copy", F.explode(F.when((F.col("block") % 7 == 3) & (F.col("place") == 6), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    return own.select("exchange", "symbol", F.concat_ws("-", F.lit("c"), "symbol", "rn", "copy").alias("candidate_id"), F.col("trading_date").alias("candidate_date"), "kind", F.when(F.col("kind") == "cash", 0.25).otherwise(2.0).alias("value"))


def folds(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT y - 1997 AS fold, make_date(y - 3, 1, 1) AS train_start, make_date(y - 1, 12, 31) AS train_end, make_date(y, 1, 1) AS test_start, make_date(y, 12, 31) AS test_end FROM (SELECT explode(sequence(1998, 2001)) AS y)")


def scenarios(spark: SparkSession) -> DataFrame:
    """Base, doubled cost, delay 2, the neighbours of the parameter grid, and the two trims."""
    return spark.sql("""
        SELECT * FROM VALUES
          ('base', 126, 2, 1, 1.0D, 0, 0), ('double_cost', 126, 2, 1, 2.0D, 0, 0), ('delay_2', 126, 2, 2, 1.0D, 0, 0),
          ('m63_n1', 63, 1, 1, 1.0D, 0, 0), ('m63_n2', 63, 2, 1, 1.0D, 0, 0), ('m126_n1', 126, 1, 1, 1.0D, 0, 0), ('m252_n1', 252, 1, 1, 1.0D, 0, 0), ('m252_n2', 252, 2, 1, 1.0D, 0, 0),
          ('trim_start', 126, 2, 1, 1.0D, 21, 0), ('trim_end', 126, 2, 1, 1.0D, 0, 21)
        AS s(scenario, momentum, hold, delay, cost_multiplier, trim_start, trim_end)""")
