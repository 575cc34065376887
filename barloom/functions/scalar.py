"""Column functions: parsing, units, ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def parse_decimal(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(28,10)")


def parse_date(c: Column) -> Column:
    """ISO, yyyyMMdd, and ISO with a time after T; anything else is null."""
    t = F.split_part(F.trim(c), F.lit("T"), F.lit(1))
    t = F.when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return t.try_cast("date")


def utc_instant(c: Column) -> Column:
    """Text with an offset or Z as an instant; without a zone it is null."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c.try_cast("timestamp"))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.substring(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), -1, 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def plain_decimal(c: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(28,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def order_id(strategy: Column, symbol: Column, side: Column, quantity: Column, day: Column, prefix: str = "barloom/order/") -> Column:
    return name_uuid(F.concat(F.lit(prefix), F.concat_ws("|", strategy, symbol, side, plain_decimal(quantity), day.cast("string"))))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns: names in order, no spaces, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def addressed(records: DataFrame, name: str = "record_id") -> DataFrame:
    """Records with the hash of their content; identical records collapse."""
    return records.withColumn(name, content_hash(*records.columns)).dropDuplicates([name])
