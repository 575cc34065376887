"""Schemas of the daily-bar tables and the key of a bar."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE, VOLUME = T.DecimalType(28, 10), T.DecimalType(28, 6)
#: exchange, symbol and basis name a series; with the date they name a bar.
SERIES = ["exchange", "symbol", "price_basis"]
KEY = [*SERIES, "trading_date"]
PRICES = ["open", "high", "low", "close"]
BAR = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("symbol", "exchange", "price_basis")]
    + [T.StructField("trading_date", T.DateType(), False)]
    + [T.StructField(c, PRICE, False) for c in PRICES]
    + [T.StructField("volume", VOLUME, False)]
)
EVIDENCE = T.StructType([T.StructField("url", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("published_on", T.DateType())])
ACTION = T.StructType(
    [T.StructField("ledger_id", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("effective_date", T.DateType()), T.StructField("kind", T.StringType())]
    + [T.StructField("cash_per_unit", PRICE), T.StructField("split_ratio", PRICE), T.StructField("record_date", T.DateType()), T.StructField("payment_date", T.DateType()), T.StructField("announced_on", T.DateType())]
    + [T.StructField("status", T.StringType()), T.StructField("evidence", EVIDENCE), T.StructField("availability_evidence", EVIDENCE), T.StructField("value_evidence", EVIDENCE)]
)
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("manifest_id", "provider", "exchange", "symbol", "price_basis")]
    + [T.StructField(c, T.DateType()) for c in ("start_date", "as_of_date", "first_date", "last_date")]
    + [T.StructField("row_count", T.LongType()), T.StructField("volume_unit", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("path", T.StringType()), T.StructField("complete", T.BooleanType())]
    + [T.StructField("coverage_missing", T.ArrayType(T.StructType([T.StructField("date", T.DateType()), T.StructField("kind", T.StringType())]))), T.StructField("captured_at", T.TimestampType())]
)
