"""Queries of sources, rules, calendars, reconciliation, inventories and provenance."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import calendar as C
from ..operators import hash_tree as H
from ..operators import inventory as I
from ..operators import provenance as P
from ..operators import reconcile as R
from ..operators import validate as V
from ..schema import KEY, PRICES
from ..sources import backfill as K
from ..sources import fixtures as X
from ..sources import scans
from ..sources.workdir import new_dir, stored
from .registry import query
from .sql import with_parts

LATEST, START, AS_OF = "2001-06-29", "1995-01-01", "2001-07-02"
VALUES = [*PRICES, "volume"]
BAR_SQL = "symbol, exchange, price_basis, trading_date, open, high, low, close, volume"


def sessions(spark: SparkSession, bars: DataFrame) -> DataFrame:
    years = bars.select("exchange").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    return C.calendar_sessions(years, X.closures(spark))


def documented(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """Every fifth missing session of a symbol, and two documents that are wrong: on a bar's date, and on a Saturday."""
    from pyspark.sql import Window

    absent = C.expected(sessions(spark, bars), X.universe(bars)).join(bars.select("exchange", "symbol", F.col("trading_date").alias("session_date")), ["exchange", "symbol", "session_date"], "left_anti")
    fifth = absent.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("session_date"))).where("k % 5 = 0").select("exchange", "symbol", "session_date")
    on_bar = bars.groupBy("exchange", "symbol").agg(F.max("trading_date").alias("session_date"))
    off = bars.select("exchange", "symbol", F.lit("1998-01-03").cast("date").alias("session_date")).distinct()
    return fifth.unionByName(on_bar).unionByName(off).withColumn("reason", F.lit("suspended"))


def as_double(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("double").alias(c) if c in VALUES else F.col(c) for c in df.columns))


def dirty(bars: DataFrame) -> DataFrame:
    """Bars with planted faults by day of year."""
    d = F.dayofyear("trading_date")
    return bars.withColumn("low", F.when(d % 53 == 0, F.col("high") + 1).otherwise(F.col("low"))).withColumn("volume", F.when(d % 59 == 0, -F.col("volume")).otherwise(F.col("volume"))).withColumn("close", F.when(d % 61 == 0, -F.col("close")).otherwise(F.col("close")))


DIRTY = """,
    dirty AS (
        SELECT symbol, trading_date, open, high, CASE WHEN dayofyear(trading_date) % 53 = 0 THEN high + 1 ELSE low END AS low,
               CASE WHEN dayofyear(trading_date) % 61 = 0 THEN -close ELSE close END AS close, CASE WHEN dayofyear(trading_date) % 59 = 0 THEN -volume ELSE volume END AS volume FROM bars)
"""


# --- Sources and sinks: files are made from the bars, then read back ----------------------------------


@query(with_parts("bars") + f"SELECT {BAR_SQL} FROM bars")
def scan_bars_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "csv")
    X.bars_dense(spark, sf_dir).write.option("header", True).csv(path)
    return as_double(scans.scan_bars_csv(spark, path))


@query(with_parts("bars") + DIRTY + """
    SELECT symbol, trading_date, CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' WHEN volume < 0 THEN 'volume_negative'
        WHEN low > least(open, close) THEN 'low_above_body' WHEN high < greatest(open, close) THEN 'high_below_body' WHEN low > high THEN 'low_above_high' ELSE 'duplicate' END AS reason
    FROM dirty, (VALUES (1), (2)) v(copy)
    WHERE (copy = 1 OR day(trading_date) = 13) AND (day(trading_date) = 13 OR least(open, high, low, close) <= 0 OR volume < 0 OR low > least(open, close) OR high < greatest(open, close))""")
def bars_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty rows of a file with invalid bars and with each thirteenth day twice."""
    path = new_dir(spark, "csv")
    b = dirty(X.bars_dense(spark, sf_dir))
    b.unionByName(b.where(F.dayofmonth("trading_date") == 13)).write.option("header", True).csv(path)
    return scans.bars_csv_rejects(spark, path).select("symbol", "trading_date", "reason")


def export_files(spark: SparkSession, bars: DataFrame) -> str:
    """An export per symbol, in a folder named by it."""
    path = new_dir(spark, "export")
    bars.select("symbol", *(F.col(c).alias(n) for c, n in scans.EXPORT_COLUMNS.items())).repartition("symbol").write.partitionBy("symbol").option("header", True).csv(path)
    return path


@query(with_parts("bars") + "SELECT symbol, 'SZSE' AS exchange, 'raw' AS price_basis, trading_date, open, high, low, close, volume FROM bars")
def scan_provider_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(scans.scan_provider_export(spark, export_files(spark, X.bars_dense(spark, sf_dir)), None, "SZSE", "raw"))


@query(with_parts("bars") + """
    SELECT symbol, CASE WHEN dayofyear(trading_date) % 41 = 0 THEN NULL ELSE trading_date END AS trading_date,
           CASE WHEN dayofyear(trading_date) % 41 = 0 THEN 'unreadable_date' WHEN trading_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'out_of_range' ELSE 'missing' END AS reason
    FROM bars WHERE dayofyear(trading_date) % 41 = 0 OR trading_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' OR dayofyear(trading_date) % 43 = 0""")
def provider_export_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty rows of exports with unreadable dates and numbers, for a range that leaves out the ends."""
    b, d = X.bars_dense(spark, sf_dir), F.dayofyear("trading_date")
    text = b.withColumn("close", F.when(d % 43 == 0, F.lit("--")).otherwise(F.col("close").cast("string"))).withColumn("trading_date", F.when(d % 41 == 0, F.lit("n/a")).otherwise(F.col("trading_date").cast("string")))
    return scans.provider_export_rejects(spark, export_files(spark, text), None, "SZSE", "raw", "1996-01-01", "2000-12-31").select("symbol", "trading_date", "reason")


def _text(df: DataFrame, path: str) -> None:
    df.repartition(F.col("part")).write.partitionBy("part").text(path)


@query(with_parts("bars") + f"SELECT symbol, 'SZSE' AS exchange, 'raw' AS price_basis, trading_date, open, high, low, close, volume FROM bars")
def scan_kline_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "kline")
    row = F.array("trading_date", *(F.col(c).cast("string") for c in ("open", "close", "low", "high")), F.lit("0"), F.lit("0"), F.col("volume").cast("string"), F.lit("0"))
    doc = X.bars_dense(spark, sf_dir).withColumn("trading_date", F.col("trading_date").cast("string")).groupBy("symbol").agg(F.collect_list(row).alias("rows"))
    _text(doc.select(F.to_json(F.struct(F.lit("0").alias("code"), F.struct(F.col("symbol").alias("code"), F.col("rows").alias("picupdata")).alias("data"))).alias("value"), F.col("symbol").alias("part")), path)
    return as_double(scans.scan_kline_positional(spark, path + "/*", "SZSE"))


@query(with_parts("bars") + """
    SELECT symbol, CASE WHEN symbol = 'LARGE' THEN 'answer_refused' ELSE 'short_row' END AS reason, count(*) AS n FROM bars
    WHERE symbol = 'LARGE' OR dayofyear(trading_date) % 37 = 0 GROUP BY ALL""")
def kline_positional_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer has another code than 0, and some rows of the others end early."""
    path = new_dir(spark, "kline")
    whole = F.array(F.col("trading_date").cast("string"), *(F.col(c).cast("string") for c in ("open", "close", "low", "high")), F.lit("0"), F.lit("0"), F.col("volume").cast("string"), F.lit("0"))
    row = F.when(F.dayofyear("trading_date") % 37 == 0, F.slice(whole, 1, 5)).otherwise(whole)
    doc = X.bars_dense(spark, sf_dir).select("symbol", row.alias("row")).groupBy("symbol").agg(F.collect_list("row").alias("rows"))
    code = F.when(F.col("symbol") == "LARGE", "1").otherwise("0")
    _text(doc.select(F.to_json(F.struct(code.alias("code"), F.struct(F.col("symbol").alias("code"), F.col("rows").alias("picupdata")).alias("data"))).alias("value"), F.col("symbol").alias("part")), path)
    return scans.kline_positional_rejects(spark, path + "/*")


def counted_files(spark: SparkSession, bars: DataFrame, wrong: str | None = None) -> str:
    """A counted file per symbol; that of ``wrong`` states one row more than it has."""
    path = new_dir(spark, "kline")
    row = F.array(F.date_format("trading_date", "yyyyMMdd"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")))
    doc = bars.groupBy("symbol").agg(F.collect_list(row).alias("kline"))
    total = F.size("kline") + F.when(F.col("symbol") == wrong, 1).otherwise(0) if wrong else F.size("kline")
    _text(doc.select(F.to_json(F.struct(F.col("symbol").alias("code"), total.alias("total"), "kline")).alias("value"), F.col("symbol").alias("part")), path)
    return path + "/*"


@query(with_parts("bars") + "SELECT symbol, 'SSE' AS exchange, 'raw' AS price_basis, trading_date, open, high, low, close, volume FROM bars")
def scan_kline_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(scans.scan_kline_counted(spark, counted_files(spark, X.bars_dense(spark, sf_dir)), "SSE"))


@query(with_parts("bars") + "SELECT symbol, count(*) + 1 AS total, count(*) AS found FROM bars WHERE symbol = 'LARGE' GROUP BY symbol")
def kline_counted_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file states a wrong count."""
    return scans.kline_counted_rejects(spark, counted_files(spark, X.bars_dense(spark, sf_dir), "LARGE"))


FAULTS = with_parts("bars") + DIRTY + """,
    twice AS (SELECT * FROM dirty, (VALUES (1), (2)) v(copy) WHERE copy = 1 OR day(trading_date) = 13),
    ruled AS (
        SELECT symbol, trading_date, CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' WHEN volume < 0 THEN 'volume_negative' WHEN low > least(open, close) THEN 'low_above_body'
            WHEN high < greatest(open, close) THEN 'high_below_body' WHEN low > high THEN 'low_above_high' WHEN day(trading_date) = 13 THEN 'duplicate' END AS reason
        FROM twice WHERE trading_date <= DATE '1999-12-31')
"""


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with every kind of fault, and each thirteenth day twice."""
    b = dirty(X.bars_dense(spark, sf_dir))
    return b.unionByName(b.where(F.dayofmonth("trading_date") == 13))


@query(FAULTS + "SELECT symbol, trading_date, CASE WHEN symbol = 'LARGE' THEN 'wrong_count' ELSE reason END AS reason FROM ruled WHERE reason IS NOT NULL AND symbol <> 'LARGE' UNION ALL SELECT symbol, trading_date, 'wrong_count' FROM twice WHERE symbol = 'LARGE'")
def kline_counted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with counted files up to a date; of the file with a wrong count, every row."""
    return scans.kline_counted_faults(spark, counted_files(spark, faulty_bars(spark, sf_dir), "LARGE"), "SSE", as_of="1999-12-31")


@query(FAULTS + "SELECT symbol, trading_date, reason FROM ruled WHERE reason IS NOT NULL")
def kline_positional_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "kline")
    row = F.array(F.col("trading_date").cast("string"), *(F.col(c).cast("string") for c in ("open", "close", "low", "high")), F.lit("0"), F.lit("0"), F.col("volume").cast("string"), F.lit("0"))
    doc = faulty_bars(spark, sf_dir).groupBy("symbol").agg(F.collect_list(row).alias("rows"))
    _text(doc.select(F.to_json(F.struct(F.lit("0").alias("code"), F.struct(F.col("symbol").alias("code"), F.col("rows").alias("picupdata")).alias("data"))).alias("value"), F.col("symbol").alias("part")), path)
    return scans.kline_positional_faults(spark, path + "/*", "SZSE", as_of="1999-12-31")


def decoded_files(spark: SparkSession, bars: DataFrame) -> str:
    path = new_dir(spark, "decoded")
    bars.select("symbol", F.concat(F.col("trading_date").cast("string"), F.when(F.dayofmonth("trading_date") % 2 == 0, F.lit("T00:00:00.000Z")).otherwise(F.lit(""))).alias("date"), *(F.col(c).cast("string").alias(c) for c in VALUES)).write.json(path)
    return path


@query(with_parts("bars") + f"SELECT symbol, 'SSE' AS exchange, 'raw' AS price_basis, trading_date, open, high, low, close, volume FROM bars WHERE trading_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def scan_decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(scans.scan_decoded_rows(spark, decoded_files(spark, X.bars_dense(spark, sf_dir)), "SSE", start="1997-01-01", as_of="1999-12-31"))


@query(FAULTS + "SELECT symbol, trading_date, reason FROM ruled WHERE reason IS NOT NULL")
def decoded_rows_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.decoded_rows_faults(spark, decoded_files(spark, faulty_bars(spark, sf_dir)), "SSE", as_of="1999-12-31")


ANNOUNCED = """,
    announced AS (
        SELECT symbol, CASE WHEN kind = 'split' THEN '关于份额拆分的公告' WHEN k % 3 = 0 THEN '分红公告' ELSE '收益分配公告' END AS title, kind,
               '/notice/' || event_id AS path, effective_date - CAST(CASE WHEN k % 6 = 0 THEN 30 ELSE 10 END AS INTEGER) AS day
        FROM ledger
        UNION ALL SELECT symbol, '基金经理变更', NULL, 'https://other.example/x', max(trading_date) FROM bars GROUP BY symbol)
"""


def announcement_files(spark: SparkSession, sf_dir: str) -> str:
    """Announcement pages, one per symbol, of the ledger's events and one that is of no matter."""
    path = new_dir(spark, "announcements")
    bars = X.bars_dense(spark, sf_dir)
    led = X.ledger(bars)
    title = F.when(F.col("kind") == "split", "关于份额拆分的公告").when(F.col("k") % 3 == 0, "分红公告").otherwise("收益分配公告")
    day = F.date_sub("effective_date", F.when(F.col("k") % 6 == 0, 30).otherwise(10))
    rows = led.select("symbol", title.alias("t"), F.concat(F.lit("/notice/"), "event_id").alias("u"), day.cast("string").alias("d"))
    rows = rows.unionByName(bars.groupBy("symbol").agg(F.max("trading_date").cast("string").alias("d")).select("symbol", F.lit("基金经理变更").alias("t"), F.lit("https://other.example/x").alias("u"), "d"))
    doc = rows.groupBy("symbol").agg(F.collect_list(F.struct(F.col("symbol").alias("SECURITY_CODE"), F.col("t").alias("TITLE"), F.col("u").alias("URL"), F.col("d").alias("SSEDATE"))).alias("result"))
    _text(doc.select(F.to_json(F.struct("symbol", "result", F.struct(F.size("result").alias("total")).alias("pageHelp"))).alias("value"), F.col("symbol").alias("part")), path)
    return path + "/*"


@query(with_parts("ledger") + ANNOUNCED + "SELECT symbol, title, path AS url, day, true AS complete FROM announced")
def scan_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_announcements(spark, announcement_files(spark, sf_dir))


@query(with_parts("ledger") + ANNOUNCED + "SELECT symbol, title, 'https://exchange.example' || path AS url, day, kind FROM announced WHERE kind IS NOT NULL")
def announcement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.announcement_filter(scans.scan_announcements(spark, announcement_files(spark, sf_dir)), "https://exchange.example").drop("complete")


@query(with_parts("ledger") + ANNOUNCED + """
    SELECT l.symbol, 'event' AS side, l.effective_date AS day, l.kind FROM ledger l
    WHERE NOT EXISTS (SELECT 1 FROM announced a WHERE a.symbol = l.symbol AND a.kind = l.kind AND abs(a.day - l.effective_date) <= 14)
    UNION ALL SELECT a.symbol, 'announcement', a.day, a.kind FROM announced a WHERE a.kind IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ledger l WHERE a.symbol = l.symbol AND a.kind = l.kind AND abs(a.day - l.effective_date) <= 14)""")
def announcement_ledger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.announcement_filter(scans.scan_announcements(spark, announcement_files(spark, sf_dir)), "https://exchange.example")
    return I.announcement_ledger_match(stored(a, "announcements"), stored(X.ledger(X.bars_dense(spark, sf_dir)), "ledger"))


FACTORS = """,
    cumulative AS (
        SELECT symbol, effective_date AS day, exp(sum(ln(coalesce(split_ratio, 1))) OVER w) AS split, sum(coalesce(cash_per_unit, 0)) OVER w AS cash
        FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY effective_date ROWS UNBOUNDED PRECEDING))
"""


def factor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor scripts of the ledger, with sentinel and trailing text, read back."""
    from pyspark.sql import Window

    path = new_dir(spark, "factors")
    w = Window.partitionBy("symbol").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, 0)
    led = X.ledger(X.bars_dense(spark, sf_dir)).select("symbol", "effective_date", F.product(F.coalesce("split_ratio", F.lit(1.0))).over(w).alias("s"), F.sum(F.coalesce("cash_per_unit", F.lit(0.0))).over(w).alias("u"))
    doc = led.groupBy("symbol").agg(F.collect_list(F.struct(F.col("effective_date").cast("string").alias("d"), F.col("s").cast("string").alias("s"), F.col("u").cast("string").alias("u"))).alias("data"))
    doc = doc.withColumn("data", F.concat(F.array(F.struct(F.lit("1900-01-01").alias("d"), F.lit("1").alias("s"), F.lit("0").alias("u"))), F.col("data")))
    _text(doc.select(F.concat(F.lit("var factors="), F.to_json(F.struct("symbol", "data")), F.lit("\n/* served by a cache */")).alias("value"), F.col("symbol").alias("part")), path)
    return scans.scan_factor_changes(spark, path + "/*")


@query(with_parts("ledger") + FACTORS + "SELECT symbol, day, round(split, 6) AS split, round(cash, 6) AS cash FROM cumulative")
def scan_factor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_series(spark, sf_dir).select("symbol", "day", F.round("split", 6).alias("split"), F.round("cash", 6).alias("cash"))


@query(with_parts("ledger") + "SELECT symbol, effective_date AS day, round(split_ratio, 6) AS split_ratio, round(cash_per_unit, 6) AS cash_per_unit FROM ledger")
def factor_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.adjust import factor_change_points as changes

    return changes(factor_series(spark, sf_dir)).select("symbol", "day", F.round("split_ratio", 6).alias("split_ratio"), F.round("cash_per_unit", 6).alias("cash_per_unit"))


@query(with_parts("bars") + "SELECT symbol, exchange, price_basis, trading_date, close FROM bars WHERE exchange = 'SSE'")
def scan_bars_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange of the stored bars, one value column: folders and columns are pruned."""
    path = new_dir(spark, "bars")
    scans.sink_bars_parquet(X.bars_dense(spark, sf_dir), path)
    return as_double(scans.scan_bars_parquet(spark, path, exchange="SSE").select(*["symbol", "exchange", "price_basis", "trading_date", "close"]))


@query(with_parts("bars") + "SELECT exchange, symbol, count(*) AS bars, round(sum(close), 4) AS closes FROM bars GROUP BY ALL")
def sink_bars_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "bars")
    scans.sink_bars_parquet(X.bars_dense(spark, sf_dir), path)
    return scans.scan_bars_parquet(spark, path).groupBy("exchange", "symbol").agg(F.count("*").alias("bars"), F.round(F.sum("close").cast("double"), 4).alias("closes"))


def manifests(bars: DataFrame) -> DataFrame:
    """A manifest per symbol and provider of the bars; some are wrong in one way each."""
    base = bars.groupBy("exchange", "symbol", "price_basis").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("*").alias("row_count"))
    p = base.withColumn("provider", F.explode(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))))
    k = F.when(F.col("provider") == "alpha", 0).when(F.col("provider") == "beta", 1).otherwise(2)
    sha = F.sha2(F.concat_ws("|", "symbol", "provider"), 256)
    miss = F.when(k == 1, F.array(F.struct(F.col("first_date").alias("date"), F.lit("expected_session_missing").alias("kind")))).otherwise(F.array().cast("array<struct<date:date,kind:string>>"))
    return p.select(
        F.concat_ws("-", "provider", "symbol").alias("manifest_id"), "provider", "exchange", "symbol", "price_basis", F.date_add("first_date", F.when((k == 2) & (F.col("symbol") < "L"), 3).otherwise(0)).alias("start_date"), "last_date",
        F.col("last_date").alias("as_of_date"), "first_date", F.when((k == 2) & (F.col("symbol") > "Q"), 0).otherwise(F.col("row_count")).alias("row_count"), F.lit("shares").alias("volume_unit"), F.when((k == 0) & (F.col("symbol") == "SMALL"), F.lit("xyz")).otherwise(sha).alias("sha256"),
        F.concat(F.lit("data/"), F.col("symbol")).alias("path"), F.lit(True).alias("complete"), miss.alias("coverage_missing"), F.timestamp_seconds(F.lit(1700000000) + k * 86400 + F.length("symbol") * 3600).alias("captured_at"),
    )


MANIFESTS = """,
    manifests AS (
        SELECT provider || '-' || symbol AS manifest_id, provider, exchange, symbol, price_basis,
               f + CAST(CASE WHEN k = 2 AND symbol < 'L' THEN 3 ELSE 0 END AS INTEGER) AS start_date, l AS as_of_date, f AS first_date, l AS last_date,
               CASE WHEN k = 2 AND symbol > 'Q' THEN 0 ELSE n END AS row_count, CASE WHEN k = 0 AND symbol = 'SMALL' THEN 'xyz' ELSE sha256(symbol || '|' || provider) END AS sha256,
               k = 1 AS has_missing, k * 86400 + length(symbol) * 3600 AS captured
        FROM (SELECT exchange, symbol, price_basis, min(trading_date) AS f, max(trading_date) AS l, count(*) AS n FROM bars GROUP BY ALL),
             (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) p(provider, k))
"""


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "manifests")
    m = manifests(X.bars_dense(spark, sf_dir))
    _text(m.select(F.to_json(F.struct(*m.columns)).alias("value"), F.col("manifest_id").alias("part")), path)  # a file each
    return scans.scan_manifests(spark, path + "/*")


@query(with_parts("bars") + MANIFESTS + "SELECT manifest_id, provider, symbol, start_date, as_of_date, row_count, sha256 FROM manifests")
def scan_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_files(spark, sf_dir).select("manifest_id", "provider", "symbol", "start_date", "as_of_date", "row_count", "sha256")


@query(with_parts("bars") + MANIFESTS + """
    SELECT manifest_id, concat_ws(',', CASE WHEN first_date < start_date THEN 'outside_request' END, CASE WHEN row_count <= 0 THEN 'no_rows' END,
           CASE WHEN sha256 = 'xyz' THEN 'bad_hash' END, CASE WHEN has_missing THEN 'complete_with_missing' END) AS reasons
    FROM manifests WHERE first_date < start_date OR row_count <= 0 OR sha256 = 'xyz' OR has_missing""")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.manifest_rules(manifest_files(spark, sf_dir)).select("manifest_id", F.array_join("reasons", ",").alias("reasons"))


@query(with_parts("bars") + "SELECT symbol, length(s) AS length, sha256(s) AS sha256 FROM (SELECT symbol, symbol || ':' || count(*) || chr(10) AS s FROM bars GROUP BY symbol)")
def scan_files_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "files")
    _text(X.bars_dense(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).select(F.concat_ws(":", "symbol", "n").alias("value"), F.col("symbol").alias("part")), path)
    return scans.scan_files_binary(spark, path).where(F.col("path").rlike("part=[^/]+/part-")).select(F.regexp_extract("path", "part=([^/]+)/", 1).alias("symbol"), "length", "sha256")


@query(with_parts("bars") + MANIFESTS + """
    SELECT manifest_id, CASE WHEN provider = 'alpha' AND symbol <> 'SMALL' THEN 'ok' WHEN provider = 'alpha' THEN 'mismatch' WHEN symbol < 'L' THEN 'path_mismatch' ELSE 'missing' END AS status FROM manifests WHERE provider <> 'gamma'
    UNION ALL SELECT manifest_id, CASE WHEN symbol < 'M' THEN 'ambiguous' ELSE 'path_mismatch' END FROM manifests WHERE provider = 'gamma'""")
def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests against a file table: alpha's files are in place, beta's partly elsewhere, and gamma's manifests claim one hash, that some files have."""
    m = manifests(X.bars_dense(spark, sf_dir)).withColumn("path", F.concat_ws("/", "provider", "symbol")).withColumn("sha256", F.when(F.col("provider") == "gamma", F.lit("0" * 64)).otherwise(F.col("sha256")))
    files = m.where("provider = 'alpha'").select("path", F.lit(1).alias("length"), F.sha2(F.concat_ws("|", "symbol", "provider"), 256).alias("sha256"))
    other = m.where("provider = 'beta' and symbol < 'L'").select(F.concat(F.lit("else/"), "path").alias("path"), F.lit(1).alias("length"), "sha256")
    shared = m.where("provider = 'gamma' and symbol < 'M'").select("path", F.lit(1).alias("length"), "sha256")
    return P.artifact_verify(m, files.unionByName(other).unionByName(shared)).select("manifest_id", "status")


def files_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the bars of each exchange, made under a context of its own: ``symbol`` and what ``scan_file_contexts`` tells."""
    path, b = new_dir(spark, "contexts"), X.bars_dense(spark, sf_dir)
    for exchange in ("SSE", "SZSE"):
        scans.sink_bars_parquet(b.where(F.col("exchange") == exchange), f"{path}/{exchange}", hashlib.sha256(f"ctx|{exchange}".encode()).hexdigest())
    found, sums = scans.scan_file_contexts(spark, path), scans.scan_files_binary(spark, path).select("path", "sha256")
    return found.join(sums, "path").withColumn("symbol", F.regexp_extract("path", "symbol=([^/]+)/", 1))


@query(with_parts("bars") + "SELECT symbol, sha256('ctx|' || exchange) AS context, count(*) AS rows, 'decimal(28,10)' AS price_type FROM bars GROUP BY symbol, exchange")
def scan_file_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_by_context(spark, sf_dir).select("symbol", "context", "rows", "price_type")


@query(with_parts("bars") + "SELECT symbol, CASE WHEN symbol IN ('LARGE', 'SMALL') THEN 'mismatch' ELSE 'ok' END AS status FROM bars GROUP BY symbol")
def artifact_verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests against stored files: one states another size, one another context, and one, of old, no context."""
    files = stored(files_by_context(spark, sf_dir), "files")
    context = F.when(F.col("symbol") == "SMALL", F.lit("0" * 64)).when(F.col("symbol") != "PROMO", F.col("context"))
    m = files.select(F.col("symbol").alias("manifest_id"), "path", "sha256", (F.col("length") + (F.col("symbol") == "LARGE").cast("int")).alias("size_bytes"), context.alias("context"))
    return P.artifact_verify(m, files.select("path", "length", "sha256", "context")).select(F.col("manifest_id").alias("symbol"), "status")


@query(with_parts("ledger") + "SELECT kind, count(*) AS records, count(*) AS ids FROM ledger GROUP BY kind")
def sink_reports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "reports")
    scans.sink_reports_json(X.ledger(X.bars_dense(spark, sf_dir)).select("event_id", "kind", "effective_date"), path)
    back = spark.read.schema("event_id string, kind string, effective_date date, report_id string").json(path)
    return back.groupBy("kind").agg(F.count("*").alias("records"), F.count_distinct("report_id").alias("ids"))


# --- Rules --------------------------------------------------------------------------------------------


@query(with_parts("bars") + DIRTY + """
    SELECT * FROM (SELECT symbol, trading_date, CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' WHEN volume < 0 THEN 'volume_negative'
        WHEN low > least(open, close) THEN 'low_above_body' WHEN high < greatest(open, close) THEN 'high_below_body' WHEN low > high THEN 'low_above_high' END AS reason FROM dirty) WHERE reason IS NOT NULL""")
def ohlc_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ohlc_validity(dirty(X.bars_dense(spark, sf_dir))).select("symbol", "trading_date", "reason")


@query(with_parts("bars") + "SELECT exchange, symbol, price_basis, trading_date, 2::BIGINT AS n FROM bars WHERE dayofmonth(trading_date) = 13")
def duplicate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return V.duplicate_bars(b.unionByName(b.where(F.dayofmonth("trading_date") == 13)))


@query(with_parts("bars") + "SELECT symbol, trading_date, close FROM bars WHERE trading_date BETWEEN DATE '1998-03-02' AND DATE '1999-03-01'")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.range_filter(X.bars_dense(spark, sf_dir), "1998-03-02", "1999-03-01").select("symbol", "trading_date", "close")


@query(with_parts("bars") + "SELECT symbol, count(*) AS n FROM bars WHERE trading_date NOT BETWEEN DATE '1998-03-02' AND DATE '1999-03-01' GROUP BY symbol")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.range_violations(X.bars_dense(spark, sf_dir), "1998-03-02", "1999-03-01").groupBy("symbol").agg(F.count("*").alias("n"))


@query(with_parts("universe") + "SELECT b.symbol, b.trading_date FROM bars b JOIN universe u USING (exchange, symbol) WHERE b.trading_date >= u.effective_from AND b.trading_date <= coalesce(u.effective_to, DATE '9999-01-01')")
def effective_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return V.effective_membership(b, X.universe(b)).select("symbol", "trading_date")


@query(with_parts("universe") + "SELECT symbol, effective_from FROM universe WHERE effective_to IS NULL OR effective_to >= DATE '2000-01-03'")
def membership_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.universe(X.bars_dense(spark, sf_dir))
    again = u.withColumn("effective_from", F.lit("2001-12-31").cast("date")).withColumn("effective_to", F.lit(None).cast("date"))
    again = again.withColumn("effective_from", F.when(F.col("symbol") < "M", F.lit("2000-01-03").cast("date")).otherwise(F.lit("2000-12-29").cast("date")))
    return V.membership_overlaps(u.unionByName(again)).select("symbol", "effective_from")


@query(with_parts("bars") + """
    SELECT series, count(DISTINCT symbol) AS symbols, count(DISTINCT exchange) AS exchanges, count(DISTINCT price_basis) AS bases, count(*) - count(DISTINCT trading_date) AS repeated_dates
    FROM (SELECT *, CASE WHEN symbol IN ('LARGE', 'PROMO') THEN 'mixed' ELSE symbol END AS series FROM bars) GROUP BY series HAVING count(DISTINCT symbol) > 1""")
def identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir).withColumn("series", F.when(F.col("symbol").isin("LARGE", "PROMO"), "mixed").otherwise(F.col("symbol")))
    return V.identity_guard(b, "series")


@query(with_parts("ledger") + """
    SELECT event_id, concat_ws(',', CASE WHEN kind = 'split' AND k % 3 = 0 THEN 'split_needs_ratio_only' END, CASE WHEN k % 7 = 0 THEN 'payment_before_effective' END, CASE WHEN status = 'candidate' THEN 'candidate_in_complete_ledger' END) AS reasons
    FROM ledger WHERE (kind = 'split' AND k % 3 = 0) OR k % 7 = 0 OR status = 'candidate'""")
def action_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = X.ledger(X.bars_dense(spark, sf_dir))
    bad = led.withColumn("cash_per_unit", F.when((F.col("kind") == "split") & (F.col("k") % 3 == 0), 0.1).otherwise(F.col("cash_per_unit"))).withColumn("payment_date", F.when(F.col("k") % 7 == 0, F.date_sub("effective_date", 1)).otherwise(F.col("payment_date")))
    return V.action_rules(bad).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(with_parts("bars") + """
    SELECT rows, grid, 0::BIGINT AS repeated, grid - rows AS missing, 0::BIGINT AS bad_cells, rows > 0 AND grid = rows AS ok
    FROM (SELECT count(*) AS rows, count(DISTINCT trading_date) * count(DISTINCT symbol) AS grid FROM bars)""")
def panel_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.panel_guard(X.bars_dense(spark, sf_dir), "close")


@query(with_parts("bars") + "SELECT trading_date, symbol, close FROM bars WHERE trading_date IN (SELECT trading_date FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))")
def aligned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.aligned(X.bars_dense(spark, sf_dir)).select("trading_date", "symbol", "close")


@query(with_parts("bars") + "SELECT symbol, trading_date, CASE WHEN month(trading_date) = 3 THEN 'left' ELSE 'right' END AS only_in FROM bars WHERE day(trading_date) = 9 AND month(trading_date) IN (3, 4)")
def date_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    d, m = F.dayofmonth("trading_date"), F.month("trading_date")
    return R.date_set_difference(b.where(~((d == 9) & (m == 4))), b.where(~((d == 9) & (m == 3)))).select("symbol", "trading_date", "only_in")


# --- Calendar -----------------------------------------------------------------------------------------


@query(with_parts("sessions") + "SELECT * FROM sessions")
def calendar_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, X.bars_dense(spark, sf_dir)).select("exchange", "session_date", F.col("ordinal").cast("long").alias("ordinal"))


def missing(spark: SparkSession, bars: DataFrame) -> DataFrame:
    return C.coverage_missing(bars, sessions(spark, bars), X.universe(bars), documented(spark, bars), START, AS_OF, LATEST)


@query(with_parts("missing") + "SELECT * FROM missing")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing(spark, X.bars_dense(spark, sf_dir))


@query(with_parts("missing", wide=True) + "SELECT * FROM missing")
def coverage_missing_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing(spark, stored(X.bars_wide(spark, sf_dir), "bars"))


@query(with_parts("documented") + "SELECT a.symbol, a.session_date, d.reason FROM absent a JOIN documented d USING (exchange, symbol, session_date)")
def documented_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return C.documented_absence(b, sessions(spark, b), X.universe(b), documented(spark, b)).select("symbol", "session_date", "reason")


@query(with_parts("documented") + """
    SELECT symbol, session_date, 'not_a_session' AS conflict FROM documented d ANTI JOIN sessions s USING (exchange, session_date)
    UNION ALL SELECT symbol, session_date, 'has_bar' FROM documented d SEMI JOIN bars b ON b.symbol = d.symbol AND b.exchange = d.exchange AND b.trading_date = d.session_date""")
def documented_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return C.documented_conflict(b, sessions(spark, b), documented(spark, b)).select("symbol", "session_date", "conflict")


@query(with_parts("missing") + """
    SELECT coalesce(h.symbol, g.symbol) AS symbol, h.present, g.missing, d.documented, g.first_missing, g.missing = 0 AS complete FROM
    (SELECT symbol, count(DISTINCT trading_date) AS present FROM bars GROUP BY 1) h
    JOIN (SELECT symbol, count(*) FILTER (kind = 'expected_session_missing') AS missing, min(missing_date) FILTER (kind = 'expected_session_missing') AS first_missing FROM missing GROUP BY 1) g USING (symbol)
    JOIN (SELECT symbol, count(*) AS documented FROM documented GROUP BY 1) d USING (symbol)""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return C.coverage_summary(b, missing(spark, b), documented(spark, b)).select("symbol", "present", "missing", "documented", "first_missing", "complete")


@query(with_parts("missing") + """
    SELECT symbol, min(session_date) AS range_start, max(session_date) AS range_end, count(*) AS n FROM (
        SELECT m.symbol, s.session_date, s.ordinal - row_number() OVER (PARTITION BY m.symbol ORDER BY s.ordinal) AS island
        FROM missing m JOIN sessions s ON s.exchange = m.exchange AND s.session_date = m.missing_date WHERE m.kind = 'expected_session_missing') GROUP BY symbol, island""")
def missing_session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return C.missing_session_ranges(missing(spark, b), sessions(spark, b)).drop("exchange")


@query(with_parts("bars", "sessions") + """,
    lacked AS (SELECT * FROM bars WHERE dayofyear(trading_date) % 40 BETWEEN 10 AND 19),
    filled AS (SELECT l.* FROM lacked l JOIN sessions s ON s.exchange = l.exchange AND s.session_date = l.trading_date WHERE trading_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-29')
    SELECT symbol, CAST(year(trading_date) AS BIGINT) AS year, count(*) AS gained FROM filled GROUP BY ALL""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored with gaps, and what a backfill of the sessions from 1996 on adds by year; a second one adds nothing."""
    b, path = stored(X.bars_dense(spark, sf_dir), "bars"), new_dir(spark, "years")
    gap = F.dayofyear("trading_date") % 40
    s, none = stored(sessions(spark, b), "sessions"), documented(spark, b).limit(0)
    universe = X.universe(b).withColumn("effective_to", F.lit(None).cast("date"))
    K.backfill(spark, path, b.where(~gap.between(10, 19)), b.select("exchange", "symbol", F.lit("1900-01-01").cast("date").alias("range_start"), F.lit("2100-01-01").cast("date").alias("range_end")).distinct())
    gained = None
    for _ in range(2):
        whole = K.ranges_to_ask(spark, path, s, universe, none, "raw", "1996-01-01", AS_OF, LATEST)
        out = K.backfill(spark, path, b, stored(whole, "ranges"))
        gained = out if gained is None else gained.unionByName(out)
    return gained.select("symbol", F.col("year").cast("long").alias("year"), "gained")


@query(with_parts("sessions") + "SELECT exchange, min(session_date) AS first_session, max(session_date) AS last_session, count(*) AS sessions FROM sessions WHERE session_date BETWEEN DATE '1997-12-20' AND DATE '1999-02-10' AND session_date NOT IN (SELECT trading_date FROM bars WHERE month(trading_date) = 2) GROUP BY 1")
def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    s = sessions(spark, b)
    feb = b.where(F.month("trading_date") == 2).select(F.col("trading_date").alias("session_date")).distinct()
    return C.request_bounds(s, s.select("exchange").distinct().join(feb, how="cross"), "1997-12-20", "1999-02-10")


@query(with_parts("sessions") + "SELECT exchange, year(session_date) AS year, min(session_date) AS first_session, max(session_date) AS last_session FROM sessions WHERE session_date BETWEEN DATE '1997-12-20' AND DATE '2000-02-10' GROUP BY ALL")
def split_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_by_year(sessions(spark, X.bars_dense(spark, sf_dir)), "1997-12-20", "2000-02-10").withColumn("year", F.col("year").cast("long"))


@query(with_parts("bars") + "SELECT max(trading_date) AS signal_date FROM bars GROUP BY date_trunc('month', trading_date)")
def month_end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.month_end_sessions(X.bars_dense(spark, sf_dir))


@query(with_parts("universe", "sessions") + """
    SELECT o.symbol, o.day, CASE WHEN o.day < u.effective_from OR o.day > u.effective_to THEN 'pre_effective_range' WHEN s.session_date IS NULL THEN 'non_session'
           WHEN o.day > DATE '2001-06-29' THEN 'incomplete_current_session' ELSE 'expected_session_missing' END AS kind
    FROM (SELECT DISTINCT u.exchange, u.symbol, CAST(o_orderdate AS DATE) AS day FROM orders, universe u) o JOIN universe u USING (exchange, symbol) LEFT JOIN sessions s ON s.exchange = o.exchange AND s.session_date = o.day""")
def classify_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    u = X.universe(b)
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return C.classify_date(days.join(u.select("exchange", "symbol"), how="cross"), u, sessions(spark, b), LATEST).drop("exchange")


@query(with_parts("sessions") + """
    , t AS (SELECT DISTINCT o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS now FROM orders)
    SELECT now, (SELECT max(session_date) FROM sessions WHERE session_date <= CASE WHEN strftime(now + INTERVAL 8 HOUR, '%H:%M') >= '16:00' THEN CAST(now + INTERVAL 8 HOUR AS DATE) ELSE CAST(now + INTERVAL 8 HOUR AS DATE) - 1 END) AS latest FROM t""")
def latest_completed_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600).alias("now")).distinct()
    return C.latest_completed_session(t, sessions(spark, X.bars_dense(spark, sf_dir)))


@query(with_parts("sessions") + """
    SELECT e.exchange, d.day, (SELECT max(session_date) FROM sessions s WHERE s.exchange = e.exchange AND s.session_date < d.day) AS previous_session,
           (SELECT min(session_date) FROM sessions s WHERE s.exchange = e.exchange AND s.session_date > d.day) AS next_session
    FROM (SELECT DISTINCT exchange FROM bars) e, (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d""")
def session_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return C.session_neighbors(b.select("exchange").distinct().join(days, how="cross"), sessions(spark, b))


@query(with_parts("sessions") + """
    , s AS (SELECT exchange, session_date, lead(session_date, 2) OVER (PARTITION BY exchange ORDER BY session_date) AS execution_date FROM sessions)
    SELECT b.exchange, b.signal_date, s.execution_date, CASE WHEN s.session_date IS NULL THEN 'unknown_signal' WHEN s.execution_date IS NULL THEN 'rejected' ELSE 'scheduled' END AS status
    FROM (SELECT DISTINCT exchange, trading_date AS signal_date FROM bars UNION SELECT DISTINCT exchange, DATE '2001-12-31' FROM bars) b LEFT JOIN s ON s.exchange = b.exchange AND s.session_date = b.signal_date""")
def execution_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    signals = b.select("exchange", F.col("trading_date").alias("signal_date")).unionByName(b.select("exchange", F.lit("2001-12-31").cast("date").alias("signal_date"))).distinct()
    return C.execution_schedule(signals, sessions(spark, b), 2).select("exchange", "signal_date", "execution_date", "status")


@query(with_parts("applied") + "SELECT symbol, event_id, effective_date, application_date FROM applied")
def asof_forward_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return C.asof_forward(X.ledger(b), b).select("symbol", "event_id", "effective_date", "application_date")


@query("""
    SELECT e.event_id, e.event_type, r.ts AS next_error FROM events e ASOF LEFT JOIN (SELECT DISTINCT ts FROM events WHERE event_type = 'error') r ON e.ts <= r.ts""")
def asof_forward_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series: the time of the first error at or after each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return C.asof_forward_long(e, e.where("event_type = 'error'").select(F.col("ts").alias("trading_date")), "ts").select("event_id", "event_type", F.col("application_date").alias("next_error"))


@query(with_parts("applied") + """
    , e AS (SELECT symbol, event_id, effective_date FROM ledger UNION ALL SELECT symbol, event_id || '+', effective_date FROM ledger WHERE k = 2
            UNION ALL SELECT symbol, symbol || '-early', min(trading_date) - 9 FROM bars GROUP BY symbol UNION ALL SELECT symbol, symbol || '-late', max(trading_date) + 1 FROM bars GROUP BY symbol),
    f AS (SELECT e.*, (SELECT min(b.trading_date) FROM bars b WHERE b.symbol = e.symbol AND b.trading_date >= e.effective_date) AS a FROM e)
    SELECT symbol, event_id, CASE WHEN a IS NULL THEN 'no_session_follows' WHEN n > 1 THEN 'session_shared' ELSE 'first_bar' END AS error
    FROM (SELECT *, count(*) OVER (PARTITION BY symbol, a) AS n, (SELECT min(trading_date) FROM bars b WHERE b.symbol = f.symbol) AS m FROM f) WHERE a IS NULL OR n > 1 OR a = m""")
def application_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    led = X.ledger(b)
    e = led.select("symbol", "event_id", "effective_date").unionByName(led.where("k = 2").select("symbol", F.concat("event_id", F.lit("+")).alias("event_id"), "effective_date"))
    ends = b.groupBy("symbol").agg(F.date_sub(F.min("trading_date"), 9).alias("a"), F.date_add(F.max("trading_date"), 1).alias("z"))
    e = e.unionByName(ends.select("symbol", F.concat("symbol", F.lit("-early")).alias("event_id"), F.col("a").alias("effective_date"))).unionByName(ends.select("symbol", F.concat("symbol", F.lit("-late")).alias("event_id"), F.col("z").alias("effective_date")))
    return C.application_errors(C.asof_forward(e, b), b).select("symbol", "event_id", "error")


# --- Reconciliation -------------------------------------------------------------------------------------

OVERLAP = """,
    overlap AS (
        SELECT a.symbol, a.trading_date, greatest(abs(a.open - b.open), abs(a.high - b.high), abs(a.low - b.low), abs(a.close - b.close)) AS d,
               least(a.open, a.high, a.low, a.close, b.open, b.high, b.low, b.close) AS m, abs(a.volume * 0.01 - b.volume) <= 0.5 AS volume_match,
               p.application_date IS NOT NULL AS boundary, a.open AS ao, a.high AS ah, a.low AS al, a.close AS ac, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc
        FROM bars a JOIN bars_b b USING (symbol, exchange, price_basis, trading_date)
        LEFT JOIN (SELECT DISTINCT symbol, application_date FROM applied) p ON p.symbol = a.symbol AND p.application_date = a.trading_date),
    judged AS (
        SELECT o.*, CASE WHEN o.d = 0 THEN 'unexplained'
            WHEN (ao, ah, al, ac) = (c.open, c.high, c.low, c.close) AND volume_match THEN 'adjudicated'
            WHEN (bo, bh, bl, bc) = (c.open, c.high, c.low, c.close) AND (ao, ah, al, ac) <> (c.open, c.high, c.low, c.close) THEN 'source_rejected' ELSE 'unexplained' END AS verdict
        FROM overlap o LEFT JOIN bars_c c ON c.symbol = o.symbol AND c.trading_date = o.trading_date WHERE o.d <> 0 OR NOT volume_match)
"""


def overlap(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    b = stored(bars, "bars")
    events = C.asof_forward(X.ledger(b), b)
    return b, R.reconcile_overlap(b, X.bars_b(b), events)


@query(with_parts("bars_c", "applied") + OVERLAP + "SELECT symbol, trading_date, round(CASE WHEN d <> 0 THEN d END, 6) AS abs_diff, round(CASE WHEN d <> 0 THEN d / m END, 6) AS rel_diff, d = 0 AS price_match, volume_match, boundary FROM overlap")
def reconcile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(X.bars_dense(spark, sf_dir))[1].select("symbol", "trading_date", F.round("abs_diff", 6).alias("abs_diff"), F.round("rel_diff", 6).alias("rel_diff"), "price_match", "volume_match", "boundary")


@query(with_parts("bars_c", "applied") + OVERLAP + "SELECT symbol, trading_date, verdict FROM judged")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, o = overlap(X.bars_dense(spark, sf_dir))
    return R.adjudicate(o, X.bars_c(b)).select("symbol", "trading_date", "verdict")


REPORT = OVERLAP + """
    SELECT o.*, coalesce(j.mismatched, 0) AS mismatched, coalesce(j.adjudicated, 0) AS adjudicated, coalesce(j.source_rejected, 0) AS source_rejected, coalesce(j.unexplained, 0) AS unexplained, coalesce(j.dates, '') AS mismatch_dates,
           CASE WHEN coalesce(j.source_rejected, 0) = 0 AND coalesce(j.unexplained, 0) = 0 THEN 'pass' ELSE 'blocked' END AS status
    FROM (SELECT symbol, count(*) AS overlap, count(*) FILTER (boundary) AS boundary_dates, round(max(d) FILTER (d <> 0), 6) AS max_abs_diff, round(max(d / m) FILTER (d <> 0), 6) AS max_rel_diff FROM overlap GROUP BY symbol) o
    LEFT JOIN (SELECT symbol, count(*) AS mismatched, count(*) FILTER (verdict = 'adjudicated') AS adjudicated, count(*) FILTER (verdict = 'source_rejected') AS source_rejected,
        count(*) FILTER (verdict = 'unexplained') AS unexplained, string_agg(CAST(trading_date AS VARCHAR), ',' ORDER BY trading_date) AS dates FROM judged GROUP BY symbol) j USING (symbol)"""


def report(bars: DataFrame) -> DataFrame:
    b, o = overlap(bars)
    o = stored(o, "overlap")
    out = R.reconciliation_report(o, R.adjudicate(o, X.bars_c(b)), b).drop("exchange", "price_basis", "reason")
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 6)).withColumn("max_rel_diff", F.round("max_rel_diff", 6))


@query(with_parts("bars_c", "applied") + REPORT)
def reconciliation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(X.bars_dense(spark, sf_dir))


@query(with_parts("bars_c", "applied", wide=True) + REPORT)
def reconciliation_report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(X.bars_wide(spark, sf_dir))


@query(with_parts("bars") + "SELECT symbol, CASE WHEN symbol < 'N' THEN 0 ELSE count(*) FILTER (dayofyear(trading_date) % 53 <> 0) END AS overlap, CASE WHEN symbol < 'N' THEN 'no_overlap' END AS reason, CASE WHEN symbol < 'N' THEN 'blocked' ELSE 'pass' END AS status FROM bars GROUP BY symbol")
def reconciliation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instrument of the source has a report, also those whose providers share no session."""
    b = stored(X.bars_dense(spark, sf_dir), "bars")
    check = b.where("symbol >= 'N'").where(F.dayofyear("trading_date") % 53 != 0).withColumn("volume", F.col("volume") * 0.01)
    o = stored(R.reconcile_overlap(b, check, C.asof_forward(X.ledger(b), b)), "overlap")
    return R.reconciliation_report(o, R.adjudicate(o, b), b).select("symbol", "overlap", "reason", "status")


@query(with_parts("bars") + "SELECT DISTINCT exchange, symbol, price_basis, 'alpha' AS provider, 2::BIGINT AS roles, 'adjudicator,canonical' AS names FROM bars WHERE symbol < 'M'")
def provider_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(X.bars_dense(spark, sf_dir))
    role = F.when(F.col("provider") == "alpha", "canonical").when(F.col("provider") == "beta", "cross_check").otherwise("adjudicator")
    same = F.when((role == "adjudicator") & (F.col("symbol") < "M"), "alpha").otherwise(F.col("provider"))
    return R.provider_independence(m.select("exchange", "symbol", "price_basis", role.alias("role"), same.alias("provider")))


@query("""
    SELECT l_orderkey AS k, sum(CASE u WHEN 0 THEN l_quantity * 0.01 WHEN 1 THEN l_quantity * 100 ELSE l_quantity END)::DOUBLE AS volume, max(CASE u WHEN 0 THEN 0.5 WHEN 1 THEN 200.0 ELSE 0.0 END)::DOUBLE AS tolerance
    FROM (SELECT *, l_linenumber % 3 AS u FROM lineitem) GROUP BY ALL""")
def volume_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("l_linenumber") % 3
    src, dst = F.when(u == 1, "lots").otherwise("shares"), F.when(u == 0, "lots").otherwise("shares")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") * R.volume_multiplier(src, dst)).alias("v"), R.volume_tolerance(src, dst, F.when(u == 1, "eastmoney").otherwise("other")).alias("t"))
    return rows.groupBy("k").agg(F.sum("v").alias("volume"), F.max("t").alias("tolerance"))


@query(with_parts("bars_b") + "SELECT symbol, trading_date, round(CASE WHEN d <> 0 THEN d END, 6) AS abs_diff FROM (SELECT a.symbol, a.trading_date, greatest(abs(a.open - b.open), abs(a.high - b.high), abs(a.low - b.low), abs(a.close - b.close)) AS d FROM bars a JOIN bars_b b USING (symbol, trading_date))")
def price_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    other = X.bars_b(b).select(*KEY, *(F.col(c).alias(c + "_b") for c in PRICES))
    return b.join(other, KEY).select("symbol", "trading_date", F.round(R.price_difference()[0], 6).alias("abs_diff"))


# --- Inventory and qualification ------------------------------------------------------------------------


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b = stored(X.bars_dense(spark, sf_dir), "bars")
    led = stored(C.asof_forward(X.ledger(b), b).withColumn("official_value", F.coalesce(F.col("split_ratio"), F.col("cash_per_unit")).cast("decimal(20,4)").cast("string")), "ledger")
    cand = stored(X.candidates(b), "candidates")
    return b, led, cand, stored(I.candidate_event_match(led, cand, b), "matches")


@query(with_parts("matches") + "SELECT symbol, event_id, candidate_id, candidate_date FROM matches")
def candidate_event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[3]


@query(with_parts("crowded", wide=True) + "SELECT symbol, event_id, candidate_id, candidate_date FROM crowded_matches")
def candidate_event_match_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a series per supplier that compete for candidates on neighbouring sessions."""
    b = stored(X.bars_wide(spark, sf_dir), "bars")
    return I.candidate_event_match(X.crowded_ledger(b), X.crowded_candidates(b), b).select("symbol", "event_id", "candidate_id", "candidate_date")


@query(with_parts("inventory") + "SELECT * FROM inventory")
def event_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, led, cand, m = matched(spark, sf_dir)
    return I.event_inventory(led, cand, m)


COUNTS = """,
    counts AS (
        SELECT symbol, count(*) FILTER (classification = 'DIVIDEND') AS dividends, count(*) FILTER (classification = 'SPLIT') AS splits, count(*) FILTER (classification = 'UNEXPLAINED') AS unexplained,
               count(*) AS total, count(*) FILTER (classification <> 'UNEXPLAINED' AND NOT verified) AS still_candidate,
               symbol < 'S' AND count(*) FILTER (classification = 'UNEXPLAINED') = 0 AS complete FROM inventory GROUP BY symbol)
"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, led, cand, m = matched(spark, sf_dir)
    attested = b.select("symbol", (F.col("symbol") < "S").alias("attested")).distinct()
    return I.event_inventory_counts(I.event_inventory(led, cand, m), attested)


@query(with_parts("inventory") + COUNTS + "SELECT * FROM counts")
def event_inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


GATES = with_parts("inventory", "missing") + COUNTS + """,
    gated AS (
        SELECT c.symbol, concat_ws(',', CASE WHEN m.n > 0 THEN 'coverage_incomplete' END, CASE WHEN c.still_candidate > 0 THEN 'candidate_events' END, CASE WHEN c.unexplained > 1 THEN 'unexplained_events' END, CASE WHEN c.symbol >= 'S' THEN 'not_attested' END) AS reasons
        FROM counts c LEFT JOIN (SELECT symbol, count(*) FILTER (kind = 'expected_session_missing') AS n FROM missing GROUP BY 1) m USING (symbol))
"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    gaps = missing(spark, b).groupBy("symbol").agg(F.count_if(F.col("kind") == "expected_session_missing").alias("n_missing"))
    gates = [("coverage_incomplete", F.col("n_missing") > 0), ("candidate_events", F.col("still_candidate") > 0), ("unexplained_events", F.col("unexplained") > 1), ("not_attested", F.col("symbol") >= "S")]
    return I.qualification_gates(b.select("symbol").distinct(), gaps, counts(spark, sf_dir), gates=gates)


@query(GATES + "SELECT symbol, reasons, CASE WHEN reasons = '' THEN 'QUALIFIED' ELSE 'BLOCKED' END AS verdict FROM gated")
def qualification_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


@query(GATES + "SELECT count(*) AS assets, count(*) FILTER (reasons = '') AS qualified, count(*) > 0 AND count(*) = count(*) FILTER (reasons = '') AS all_qualified FROM gated")
def universe_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.universe_verdict(gated(spark, sf_dir))


# --- Provenance -----------------------------------------------------------------------------------------


@query(with_parts("bars") + "SELECT symbol, sha256(string_agg(strftime(trading_date, '%Y-%m-%d') || ':' || CAST(CAST(close AS DECIMAL(28,6)) AS VARCHAR), '|' ORDER BY trading_date)) AS fingerprint, count(*) AS points FROM bars GROUP BY symbol")
def series_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.series_fingerprint(X.bars_dense(spark, sf_dir), "close", "symbol")


@query(with_parts("bars_b", wide=True) + """,
    sides AS (
        SELECT symbol, trading_date, close, 'left' AS side FROM bars UNION ALL SELECT symbol, trading_date, close, 'right' FROM bars_b WHERE symbol NOT LIKE '%3'),
    leaves AS (
        SELECT symbol, date_diff('day', DATE '0001-01-01', trading_date) // 32 AS leaf, string_agg(strftime(trading_date, '%Y-%m-%d') || ':' || CAST(CAST(close AS DECIMAL(28,6)) AS VARCHAR), '|' ORDER BY trading_date) FILTER (side = 'left') AS l,
               string_agg(strftime(trading_date, '%Y-%m-%d') || ':' || CAST(CAST(close AS DECIMAL(28,6)) AS VARCHAR), '|' ORDER BY trading_date) FILTER (side = 'right') AS r
        FROM sides GROUP BY ALL)
    SELECT symbol, DATE '0001-01-01' + CAST(leaf * 32 AS INTEGER) AS first_date, DATE '0001-01-01' + CAST(leaf * 32 + 31 AS INTEGER) AS last_date, CASE WHEN r IS NULL THEN 'left' WHEN l IS NULL THEN 'right' END AS only_in
    FROM leaves WHERE l IS DISTINCT FROM r""")
def differing_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two builds of a series per supplier differ, by their hash trees; of some series one side has nothing."""
    b = X.bars_wide(spark, sf_dir)
    one = stored(H.series_tree(b, "close", "symbol"), "tree")
    other = stored(H.series_tree(X.bars_b(b).where("symbol not like '%3'"), "close", "symbol"), "tree")
    return H.differing_leaves(one, other, "symbol")


@query(with_parts("bars") + "SELECT symbol, count(*) AS points, count(DISTINCT date_diff('day', DATE '0001-01-01', trading_date) // 32) AS leaves FROM bars GROUP BY symbol")
def series_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.series_tree(X.bars_dense(spark, sf_dir), "close", "symbol")
    return t.groupBy("symbol").agg(F.max(F.when(F.col("level") == H.TOP, F.col("points"))).alias("points"), F.count_if(F.col("level") == 0).alias("leaves"))


@query(with_parts("ledger") + """
    SELECT DISTINCT sha256('{"event_id":"' || event_id || '","kind":"' || kind || '"}') AS record_id, event_id, kind FROM ledger""")
def content_address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = X.ledger(X.bars_dense(spark, sf_dir)).select("kind", "event_id")
    return S.addressed(led.unionByName(led))


@query(with_parts("ledger") + "SELECT sha256(kind || k) AS sha256, count(*) AS citations, k % 2 = 0 AS archived FROM ledger GROUP BY kind, k")
def evidence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = X.ledger(X.bars_dense(spark, sf_dir)).select("k", F.sha2(F.concat("kind", "k"), 256).alias("sha256"))
    return P.evidence_verify(led, led.where("k % 2 = 0"))


@query(with_parts("ledger") + "SELECT DISTINCT sha256(kind || k) AS sha256 FROM ledger")
def distinct_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ledger(X.bars_dense(spark, sf_dir)).select(F.sha2(F.concat("kind", "k"), 256).alias("sha256")).dropDuplicates(["sha256"])


@query(with_parts("universe") + "SELECT exchange, symbol, CASE WHEN symbol < 'F' THEN 0 WHEN symbol > 'S' THEN 2 ELSE 1 END::BIGINT AS series, CASE WHEN symbol < 'F' THEN 'missing' WHEN symbol > 'S' THEN 'duplicate' ELSE 'ready' END AS status FROM universe")
def universe_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.universe(X.bars_dense(spark, sf_dir))
    verified = u.where("symbol > 'F'").select("exchange", "symbol")
    return P.universe_preflight(u, verified.unionByName(verified.where("symbol > 'S'")))


@query(with_parts("universe") + "SELECT symbol, CASE WHEN symbol < 'F' THEN 'left' ELSE 'right' END AS only_in FROM universe WHERE symbol < 'F' OR symbol > 'S'")
def registry_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.universe(X.bars_dense(spark, sf_dir))
    return P.set_difference(u.where("symbol < 'S'"), u.where("symbol > 'F'"), "symbol")


@query(with_parts("bars") + MANIFESTS + """
    SELECT manifest_id, CASE WHEN provider = 'beta' THEN 'removed' WHEN provider = 'gamma' THEN 'added' ELSE 'changed' END AS status, CASE WHEN provider = 'alpha' THEN 'row_count' ELSE 'row_count,sha256' END AS drift FROM manifests WHERE provider <> 'alpha' OR symbol < 'M'""")
def frozen_input_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(X.bars_dense(spark, sf_dir))
    now = m.where("provider <> 'beta'").withColumn("row_count", F.when((F.col("provider") == "alpha") & (F.col("symbol") < "M"), F.col("row_count") + 1).otherwise(F.col("row_count")))
    return P.frozen_input_drift(m.where("provider <> 'gamma'"), now, "manifest_id", "row_count", "sha256")


@query(with_parts("bars") + MANIFESTS + """
    SELECT r.symbol || '-' || n AS request_id, (SELECT arg_max(m.manifest_id, (m.captured, m.manifest_id)) FROM manifests m WHERE m.symbol = r.symbol AND m.start_date <= r.f + CAST(n AS INTEGER) AND m.as_of_date >= r.l) AS manifest_id
    FROM (SELECT symbol, min(trading_date) AS f, max(trading_date) AS l FROM bars GROUP BY 1) r, (VALUES (-1), (0), (5)) v(n)""")
def covering_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    r = b.groupBy("exchange", "symbol", "price_basis").agg(F.min("trading_date").alias("f"), F.max("trading_date").alias("as_of_date")).withColumn("n", F.explode(F.array(*map(F.lit, (-1, 0, 5)))))
    return P.covering_request(r.select(F.concat_ws("-", "symbol", "n").alias("request_id"), "exchange", "symbol", "price_basis", F.date_add("f", F.col("n")).alias("start_date"), "as_of_date"), manifests(b))


@query("""
    WITH m AS (SELECT o_orderpriority AS symbol, o_orderkey AS manifest_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS e, o_custkey AS captured FROM orders WHERE o_orderkey % 7 = 0),
    r AS (SELECT o_orderpriority AS symbol, o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INTEGER) AS e FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT request_id, CAST(arg_max(manifest_id, (captured, manifest_id)) AS VARCHAR) AS manifest_id FROM r LEFT JOIN m ON m.symbol = r.symbol AND m.s <= r.s AND m.e >= r.e GROUP BY request_id""")
def covering_request_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series with many overlapping manifests each: of every seventh order, for the others as requests."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    series = [F.lit("SSE").alias("exchange"), F.col("o_orderpriority").alias("symbol"), F.lit("raw").alias("price_basis")]
    m = o.where("o_orderkey % 7 = 0").select(*series, F.col("o_orderkey").alias("manifest_id"), day.alias("start_date"), F.date_add(day, (F.col("o_orderkey") % 900).cast("int")).alias("as_of_date"), F.col("o_custkey").alias("captured_at"))
    r = o.where("o_orderkey % 7 <> 0").select(*series, F.col("o_orderkey").alias("request_id"), day.alias("start_date"), F.date_add(day, (F.col("o_custkey") % 60).cast("int")).alias("as_of_date"))
    return P.covering_request(r, m).withColumn("manifest_id", F.col("manifest_id").cast("string"))


@query(with_parts("bars") + MANIFESTS + "SELECT symbol, arg_max(manifest_id, (captured, manifest_id)) AS manifest_id FROM manifests GROUP BY symbol")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_per_key(manifests(X.bars_dense(spark, sf_dir)), "manifest_id", "captured_at", "symbol")


@query(with_parts("bars_c", "applied") + OVERLAP + """
    SELECT u.symbol, CASE WHEN coalesce(j.bad, 0) = 0 THEN 'r-' || u.symbol END AS report_id FROM (SELECT DISTINCT symbol FROM bars) u
    LEFT JOIN (SELECT symbol, count(*) FILTER (verdict <> 'adjudicated') AS bad FROM judged WHERE year(trading_date) = 1996 GROUP BY 1) j USING (symbol)""")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, o = overlap(X.bars_dense(spark, sf_dir))
    o = stored(o, "overlap")
    report = R.reconciliation_report(o, R.adjudicate(o, X.bars_c(b)).where(F.year("trading_date") == 1996)).withColumn("report_id", F.concat(F.lit("r-"), "symbol"))
    return P.report_lookup(b.select("symbol").distinct(), report, F.col("status") == "pass", ["symbol"])


# --- Scalars --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE round(o_totalprice, 4) END AS price FROM orders")
def parse_decimal_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.when(k % 4 == 0, d.cast("string")).when(k % 4 == 1, F.date_format(d, "yyyyMMdd")).when(k % 4 == 2, F.concat(d.cast("string"), F.lit("T00:00:00"))).otherwise(F.lit("n/a"))
    price = F.when(k % 5 == 4, F.lit("--")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(20,4)").cast("string")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), S.parse_date(text).alias("day"), S.parse_decimal(price).cast("double").alias("price"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 2 THEN NULL ELSE CASE c_custkey % 3 WHEN 0 THEN 'sh' ELSE 'sz' END || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS market_symbol FROM customer")
def market_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 7 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.lpad(k.cast("string"), 6, "0"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), C.market_symbol(F.when(k % 3 == 0, "SSE").when(k % 3 == 1, "SZSE").otherwise("TEST"), code).alias("market_symbol"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN date_trunc('second', ts) - INTERVAL 8 HOUR ELSE date_trunc('second', ts) END AS instant FROM events")
def utc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 3 == 0, F.concat(t, F.lit("Z"))).when(k % 3 == 1, F.concat(t, F.lit("+08:00"))).otherwise(t)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.utc_instant(text).alias("instant"))


@query("""SELECT c_custkey AS k, sha256('{"balance":"' || CAST(CAST(c_acctbal AS DECIMAL(20,2)) AS VARCHAR) || '","name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS hash FROM customer""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").cast("decimal(20,2)").cast("string").alias("balance"))
    return c.select("k", S.content_hash("segment", "name", "balance").alias("hash"))


@query("SELECT o_orderkey AS k, v = round(v, 2) OR o_orderkey % 3 <> 2 AS same FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) + CASE WHEN o_orderkey % 3 = 0 THEN 0.001 WHEN o_orderkey % 3 = 1 THEN 0.0049 ELSE 0.0051 END AS v FROM orders)")
def scale_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values reported with more places than the official one of two places."""
    k = F.col("o_orderkey")
    official = F.col("o_totalprice").cast("decimal(20,2)")
    reported = official.cast("decimal(20,4)") + F.when(k % 3 == 0, 0.001).when(k % 3 == 1, 0.0049).otherwise(0.0051).cast("decimal(6,4)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), R.scale_equal(reported, official.cast("string")).alias("same"))


@query("""
    WITH o AS (SELECT o_orderkey AS k, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('barloom/order/momentum|' || o_orderkey || '|buy|' || CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d'))) AS h FROM orders)
    SELECT k, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS order_id FROM o""")
def deterministic_order_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), S.order_id(F.lit("momentum"), F.col("o_orderkey").cast("string"), F.lit("buy"), F.col("o_custkey"), F.col("o_orderdate").cast("date")).alias("order_id"))


@query("SELECT c_custkey AS k, round(sqrt(abs(c_acctbal)), 6) AS root, round(pow(abs(c_acctbal) / 10000, 2), 6) AS square, least(c_acctbal, 100.0) AS low, greatest(c_acctbal, 100.0) AS high, c_acctbal < 0 AS unbounded FROM customer")
def numeric_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    ratio = F.when(b < 0, F.lit(float("inf"))).otherwise(b)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.pow(F.abs(b) / 10000, F.lit(2.0)), 6).alias("square"), F.least(b, F.lit(100.0)).alias("low"), F.greatest(b, F.lit(100.0)).alias("high"), (ratio == F.lit(float("inf"))).alias("unbounded"))


@query(with_parts("bars") + "SELECT DISTINCT trading_date FROM bars WHERE symbol = 'PROMO' INTERSECT SELECT trading_date FROM bars WHERE symbol = 'SMALL'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return b.where("symbol = 'PROMO'").select("trading_date").intersect(b.where("symbol = 'SMALL'").select("trading_date"))


@query(with_parts("sessions") + "SELECT session_date FROM sessions WHERE exchange = 'SZSE' EXCEPT SELECT trading_date FROM bars WHERE symbol = 'PROMO'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return sessions(spark, b).where("exchange = 'SZSE'").select("session_date").subtract(b.where("symbol = 'PROMO'").select(F.col("trading_date").alias("session_date")))


@query(with_parts("bars_b") + "SELECT symbol, 'alpha' AS provider, count(*) AS n FROM bars GROUP BY 1 UNION ALL SELECT symbol, 'beta', count(*) FROM bars_b GROUP BY 1")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return b.withColumn("provider", F.lit("alpha")).unionByName(X.bars_b(b).withColumn("provider", F.lit("beta"))).groupBy("symbol", "provider").agg(F.count("*").alias("n"))


@query(with_parts("bars") + "SELECT symbol, trading_date, close FROM bars ORDER BY symbol, trading_date")
def sort_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bars_dense(spark, sf_dir).select("symbol", "trading_date", "close").orderBy("symbol", "trading_date")
