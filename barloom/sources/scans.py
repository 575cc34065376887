"""Readers of provider files and of stored tables, and the sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import content_hash, parse_date, parse_decimal
from ..operators.validate import load_faults
from ..schema import BAR, MANIFEST, PRICES
from .publish import load_whole

#: Column names of tabular exports, by bar column.
EXPORT_COLUMNS = {"trading_date": "日期", "open": "开盘", "close": "收盘", "high": "最高", "low": "最低", "volume": "成交量"}


def _bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_bars_csv(spark: SparkSession, path: str, to: str | None = None) -> DataFrame:
    """Daily bars from CSV with a header, published at ``to``. A malformed or invalid row, or a repeated key, fails the whole load."""
    return load_whole(_bars_csv(spark, path), to=to)


def bars_csv_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rows that fail such a load, with their reasons."""
    return load_faults(_bars_csv(spark, path)).where("reason is not null")


def _export(spark: SparkSession, path: str, symbol: str | None, exchange: str, basis: str, start: str | None, as_of: str | None) -> tuple[DataFrame, list]:
    df = spark.read.option("header", True).csv(path)
    lacking = [c for c in EXPORT_COLUMNS.values() if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    if df.isEmpty():
        raise ValueError(f"no rows: {path}")
    named = F.lit(symbol) if symbol is not None else F.regexp_extract(F.col("_metadata.file_path"), "symbol=([^/]+)/", 1)
    value = lambda c: parse_decimal(F.col(EXPORT_COLUMNS[c])).alias(c)
    rows = df.select(named.alias("symbol"), F.lit(exchange).alias("exchange"), F.lit(basis).alias("price_basis"), parse_date(F.col(EXPORT_COLUMNS["trading_date"])).alias("trading_date"), *(value(c) for c in (*PRICES, "volume")))
    day = F.col("trading_date")
    return rows, [("unreadable_date", day.isNull()), ("out_of_range", (day < F.lit(start).cast("date")) | (day > F.lit(as_of).cast("date")))]


def scan_provider_export(spark: SparkSession, path: str, symbol: str | None, exchange: str, basis: str, start: str | None = None, as_of: str | None = None, to: str | None = None) -> DataFrame:
    """A tabular export: its columns and at least one row must be there; rows as bars. Without ``symbol``, that of a row is named by its file's folder
    (``symbol=...``). A value that is no date or number, a date outside ``start`` to ``as_of``, an invalid bar or a repeated key fails the whole load."""
    rows, rules = _export(spark, path, symbol, exchange, basis, start, as_of)
    return load_whole(rows, *rules, to=to)


def provider_export_rejects(spark: SparkSession, path: str, symbol: str | None, exchange: str, basis: str, start: str | None = None, as_of: str | None = None) -> DataFrame:
    """The rows that fail such a load, with their reasons; unreadable numbers are ``missing``."""
    rows, rules = _export(spark, path, symbol, exchange, basis, start, as_of)
    return load_faults(rows, *rules).where("reason is not null")


def _bar(symbol, exchange: str, basis: str, day, items: dict) -> list:
    return [symbol.alias("symbol"), F.lit(exchange).alias("exchange"), F.lit(basis).alias("price_basis"), day.alias("trading_date"), *(parse_decimal(items[c]).alias(c) for c in (*PRICES, "volume"))]


#: What is wrong with an answer as a whole or the shape of one of its rows, and a row's date.
SHAPES = ("answer_refused", "wrong_symbol", "wrong_count", "short_row", "unreadable_date")


def _ranged(rows: DataFrame, start: str | None, as_of: str | None) -> tuple[DataFrame, list]:
    """Rows with their fault in ``_fault``, without those whose date is read and outside ``start`` to ``as_of``, and the rules of their faults."""
    day = F.col("trading_date")
    rows = rows.withColumn("_fault", F.coalesce("_fault", F.when(day.isNull(), "unreadable_date")))
    inside = F.coalesce(day >= F.lit(start).cast("date"), F.lit(True)) & F.coalesce(day <= F.lit(as_of).cast("date"), F.lit(True))
    return rows.where(F.col("_fault").isNotNull() | inside), [(name, F.coalesce(F.col("_fault") == name, F.lit(False))) for name in SHAPES]


def _faulty(rows: DataFrame, rules: list) -> DataFrame:
    return load_faults(rows, *rules).where("reason is not null").select("symbol", "trading_date", "reason")


def _positional(spark: SparkSession, path: str, exchange: str, basis: str) -> DataFrame:
    """Rows of positional K-line files, with what makes one unfit in ``_fault``; an answer without rows is one such row."""
    doc = F.from_json("value", "code string, data struct<code:string,picupdata:array<array<string>>>")
    rows = spark.read.text(path, wholetext=True).select(doc.alias("d")).select(F.col("d.data.code").alias("symbol"), F.coalesce(F.col("d.code") == "0", F.lit(False)).alias("good"), F.explode_outer("d.data.picupdata").alias("r"))
    fault = F.when(~F.col("good") | F.col("r").isNull() & F.col("symbol").isNull(), "answer_refused").when(F.col("r").isNull() | (F.size("r") < 9), "short_row")
    at = lambda k: F.get("r", F.lit(k))
    return rows.select(*_bar(F.col("symbol"), exchange, basis, parse_date(at(0)), {"open": at(1), "close": at(2), "low": at(3), "high": at(4), "volume": at(7)}), fault.alias("_fault"))


def scan_kline_positional(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None, to: str | None = None) -> DataFrame:
    """Positional K-line files ``{code, data: {code, picupdata: [[date, open, close, low, high, _, _, volume, ...]]}}``, published at ``to``. Rows outside ``start`` to
    ``as_of`` are left out. An answer with a code other than 0 or without rows, a row of fewer than nine items, an unreadable date or number, an invalid bar, a repeated key, or no row at
    all fails the whole load."""
    rows, rules = _ranged(_positional(spark, path, exchange, basis), start, as_of)
    return load_whole(rows, *rules, to=to, least=1)


def kline_positional_faults(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None) -> DataFrame:
    """``symbol, trading_date, reason`` of the rows that fail such a load."""
    return _faulty(*_ranged(_positional(spark, path, exchange, basis), start, as_of))


def kline_positional_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Refused answers and rows of a wrong shape, counted by symbol."""
    return _positional(spark, path, "", "raw").where("_fault is not null").groupBy("symbol", F.col("_fault").alias("reason")).agg(F.count("*").alias("n"))


def _counted(spark: SparkSession, path: str) -> DataFrame:
    doc = F.from_json("value", "code string, total int, kline array<array<string>>")
    return spark.read.text(path, wholetext=True).select(doc.alias("d")).select(F.col("d.code").alias("symbol"), "d.total", "d.kline")


def _counted_rows(spark: SparkSession, path: str, exchange: str, basis: str, symbol: str | None) -> DataFrame:
    fits = F.coalesce(F.size("kline") == F.col("total"), F.lit(False))
    other = F.lit(False) if symbol is None else ~F.coalesce(F.col("symbol") == symbol, F.lit(False))
    rows = _counted(spark, path).withColumn("of", F.when(other, "wrong_symbol").when(~fits, "wrong_count")).select("symbol", "of", F.explode_outer("kline").alias("r")).where("r is not null or of is not null")
    at = lambda k: F.get("r", F.lit(k))
    fault = F.coalesce("of", F.when(F.coalesce(F.size("r") != 6, F.lit(True)), "short_row"))
    return rows.select(*_bar(F.col("symbol"), exchange, basis, parse_date(at(0)), {"open": at(1), "high": at(2), "low": at(3), "close": at(4), "volume": at(5)}), fault.alias("_fault"))


def scan_kline_counted(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None, symbol: str | None = None, to: str | None = None) -> DataFrame:
    """Counted K-line files ``{code, total, kline: [[yyyymmdd, open, high, low, close, volume]]}``, published at ``to``. Rows outside ``start`` to ``as_of`` are left out. A code other than
    ``symbol`` (if given), a wrong count or row width, an unreadable date or number, an invalid bar, a repeated key, or no row at all fails the whole load."""
    rows, rules = _ranged(_counted_rows(spark, path, exchange, basis, symbol), start, as_of)
    return load_whole(rows, *rules, to=to, least=1)


def kline_counted_faults(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None, symbol: str | None = None) -> DataFrame:
    """``symbol, trading_date, reason`` of the rows that fail such a load."""
    return _faulty(*_ranged(_counted_rows(spark, path, exchange, basis, symbol), start, as_of))


def kline_counted_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Files whose count is wrong, with the one stated and the one found."""
    found = F.coalesce(F.size("kline"), F.lit(-1))
    return _counted(spark, path).select("symbol", "total", found.alias("found")).where("not coalesce(found = total, false)")


def _decoded(spark: SparkSession, path: str, exchange: str, basis: str) -> DataFrame:
    df = spark.read.schema("symbol string, date string, open string, high string, low string, close string, volume string").json(path)
    return df.select(*_bar(F.col("symbol"), exchange, basis, parse_date(F.col("date")), {c: F.col(c) for c in (*PRICES, "volume")}), F.lit(None).cast("string").alias("_fault"))


def scan_decoded_rows(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None, to: str | None = None) -> DataFrame:
    """Decoded rows as JSON lines of text values, published at ``to``; dates may carry a time. Rows outside ``start`` to ``as_of`` are left out. An unreadable date or number, an invalid
    bar, a repeated key, or no row at all fails the whole load."""
    rows, rules = _ranged(_decoded(spark, path, exchange, basis), start, as_of)
    return load_whole(rows, *rules, to=to, least=1)


def decoded_rows_faults(spark: SparkSession, path: str, exchange: str, basis: str = "raw", start: str | None = None, as_of: str | None = None) -> DataFrame:
    """``symbol, trading_date, reason`` of the rows that fail such a load."""
    return _faulty(*_ranged(_decoded(spark, path, exchange, basis), start, as_of))


def scan_announcements(spark: SparkSession, path: str) -> DataFrame:
    """Announcement pages; ``complete``: the page holds its stated total, and all its rows have its symbol."""
    doc = F.from_json("value", "symbol string, result array<struct<SECURITY_CODE:string,TITLE:string,URL:string,SSEDATE:string>>, pageHelp struct<total:int>")
    d = spark.read.text(path, wholetext=True).select(doc.alias("d")).select("d.*")
    d = d.withColumn("complete", (F.size("result") == F.col("pageHelp.total")) & F.forall("result", lambda r: r["SECURITY_CODE"] == F.col("symbol")))
    return d.select("symbol", "complete", F.explode("result").alias("r")).select(F.col("r.SECURITY_CODE").alias("symbol"), F.col("r.TITLE").alias("title"), F.col("r.URL").alias("url"), parse_date(F.col("r.SSEDATE")).alias("day"), "complete")


def scan_factor_changes(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative factors from scripts ``var x={"symbol": .., "data": [{d, s, u}]}``, text after the object ignored, without the
    year-1900 sentinel: ``symbol, day, split, cash``."""
    doc = F.from_json(F.regexp_extract("value", r"(?s)=\s*(\{.*\})", 1), "symbol string, data array<struct<d:string,s:string,u:string>>")
    d = spark.read.text(path, wholetext=True).select(doc.alias("j")).select("j.symbol", F.explode("j.data").alias("r"))
    d = d.select("symbol", parse_date(F.col("r.d")).alias("day"), F.col("r.s").cast("double").alias("split"), F.col("r.u").cast("double").alias("cash"))
    return d.where(F.year("day") != 1900)


#: Types of canonical values, where they differ from those of BAR: room for products of prices and factors.
CANONICAL = {c: T.DecimalType(38, 28) for c in PRICES} | {"volume": T.DecimalType(38, 6)}


def scan_bars_parquet(spark: SparkSession, root: str, canonical: bool = False, **parts: str) -> DataFrame:
    """Stored bars; exchange, symbol and basis are partition columns, so naming them prunes folders. ``canonical`` as they were written."""
    schema = T.StructType([T.StructField(f.name, CANONICAL.get(f.name, f.dataType), False) for f in BAR.fields]) if canonical else BAR
    df = spark.read.schema(schema).parquet(root)
    for name, value in parts.items():
        df = df.where(F.col(name) == value)
    return df


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def scan_files_binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


#: The name of the context hash in the metadata of a column, which Spark keeps in the footer of each file.
CONTEXT = "context_sha256"


def sink_bars_parquet(bars: DataFrame, path: str, context: str | None = None, canonical: bool = False) -> None:
    """Bars as zstd Parquet in folders by series. ``context``: a hash of what they were made by, stored in the footer of each file. ``canonical``: prices as decimals
    of 28 places, for adjusted ones, instead of ten; a price of ten digits or more before the point is an error then."""
    typed = [F.col(f.name).cast(CANONICAL.get(f.name, f.dataType) if canonical else f.dataType) for f in BAR.fields]
    named = [c.alias(f.name, metadata={CONTEXT: context}) if context and f.name == "trading_date" else c.alias(f.name) for c, f in zip(typed, BAR.fields)]
    bars.select(*named).repartition("exchange", "symbol", "price_basis").write.partitionBy("exchange", "symbol", "price_basis").option("compression", "zstd").mode("errorifexists").parquet(path)


def scan_file_contexts(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, context, rows, price_type`` of every Parquet file under ``path``, from its size and its footer: no data page is read. ``context`` is null where a file
    holds none. A file that is no Parquet file is an error."""

    def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for f in frames:
            out = []
            for name in f["path"]:
                store, at = fs.FileSystem.from_uri("file://" + name.removeprefix("file:") if name.startswith("file:/") and not name.startswith("file://") else name)
                with store.open_input_file(at) as file:
                    meta = pq.read_metadata(file)
                spec = json.loads((meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"{}"))
                fields = {c["name"]: c for c in spec.get("fields", [])}
                held = [c["metadata"][CONTEXT] for c in fields.values() if CONTEXT in c["metadata"]]
                out.append((held[0] if held else None, meta.num_rows, str(fields.get("close", {}).get("type", ""))))
            yield pd.DataFrame({"path": f["path"], "length": f["length"], "context": [x[0] for x in out], "rows": [x[1] for x in out], "price_type": [x[2] for x in out]})

    # The content column is not asked for, so files are listed and not read.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return files.repartition("path").mapInPandas(footers, "path string, length long, context string, rows long, price_type string")


def sink_reports_json(records: DataFrame, path: str) -> None:
    """Records as JSON with the hash of their content (``report_id``), in folders by its first two digits: as many as there are records at
    most, and 256 however many there are."""
    named = records.withColumn("report_id", content_hash(*records.columns)).withColumn("part", F.substring("report_id", 1, 2))
    named.repartition("part").write.partitionBy("part").mode("errorifexists").json(path)
