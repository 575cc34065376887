"""Fingerprints, evidence and artifact checks, and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import latest_covering


def series_fingerprint(rows: DataFrame, value: str, *keys: str, scale: int = 6) -> DataFrame:
    """SHA-256 of each series in date order, its values first cast to a fixed scale."""
    point = F.concat_ws(":", F.col("trading_date").cast("string"), F.col(value).cast(f"decimal(28,{scale})").cast("string"))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(point)), "|"), 256).alias("fingerprint"), F.count("*").alias("points"))


def artifact_verify(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Status of each manifest against ``files(path, length, sha256)``. The file is looked for first: ``missing``, or ``path_mismatch`` where another path has its hash.
    Then its hash (``mismatch``, or ``path_mismatch``), that no other manifest claims it (``ambiguous``), and where manifests have ``size_bytes`` or ``context`` (and
    files ``context``, see ``scan_file_contexts``), its size and what its footer says (``mismatch``); else ``ok``. A manifest with a null size or context is
    not held to it."""
    claims = manifests.groupBy("sha256").agg(F.count("*").alias("_claims"))
    own = [c for c in ("length", "context") if c in files.columns]
    at = files.select("path", F.col("sha256").alias("_found"), *(F.col(c).alias(f"_{c}") for c in own))
    elsewhere = files.select("sha256").distinct().withColumn("_elsewhere", F.lit(True))
    out = manifests.join(claims, "sha256").join(at, "path", "left").join(elsewhere, "sha256", "left")
    other = F.lit(False)
    for wanted, found in (("size_bytes", "_length"), ("context", "_context")):
        if wanted in manifests.columns and found in out.columns:
            other = other | F.col(wanted).isNotNull() & ~F.col(wanted).eqNullSafe(F.col(found))
    moved = F.col("_elsewhere").isNotNull()
    status = F.when(F.col("_found").isNull(), F.when(moved, "path_mismatch").otherwise("missing")).when(F.col("_found") != F.col("sha256"), F.when(moved, "path_mismatch").otherwise("mismatch"))
    return out.select("manifest_id", "path", status.when(F.col("_claims") > 1, "ambiguous").when(other, "mismatch").otherwise("ok").alias("status"))


def evidence_verify(cited: DataFrame, archive: DataFrame) -> DataFrame:
    """Each distinct hash cited, and whether the archive has it."""
    c = cited.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("citations"))
    return c.join(archive.select("sha256").distinct().withColumn("archived", F.lit(True)), "sha256", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def universe_preflight(universe: DataFrame, verified: DataFrame) -> DataFrame:
    """Per instrument: the number of verified series, and its status (ready, missing, duplicate)."""
    n = verified.groupBy("exchange", "symbol").agg(F.count("*").alias("series"))
    out = universe.select("exchange", "symbol").join(n, ["exchange", "symbol"], "left").withColumn("series", F.coalesce("series", F.lit(0)))
    return out.withColumn("status", F.when(F.col("series") == 0, "missing").when(F.col("series") > 1, "duplicate").otherwise("ready"))


def set_difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, and which."""
    x, y = (d.select(*keys).distinct().withColumn(c, F.lit(True)) for d, c in ((a, "_a"), (b, "_b")))
    return x.join(y, list(keys), "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))


def frozen_input_drift(frozen: DataFrame, current: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of either side whose columns differ, with the names of those that do."""
    f = frozen.select(key, *(F.col(c).alias(f"_f_{c}") for c in columns), F.lit(True).alias("_f"))
    c = current.select(key, *columns, F.lit(True).alias("_c"))
    out = f.join(c, key, "full_outer")
    drift = F.array_compact(F.array(*(F.when(~F.col(f"_f_{x}").eqNullSafe(F.col(x)), F.lit(x)) for x in columns)))
    status = F.when(F.col("_f").isNull(), "added").when(F.col("_c").isNull(), "removed").otherwise("changed")
    return out.withColumn("drift", F.array_join(drift, ",")).withColumn("status", status).where((F.col("drift") != "") | F.col("_f").isNull() | F.col("_c").isNull()).select(key, "status", "drift")


def covering_request(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each request the latest captured manifest of its series whose interval contains it; null where none does. Request ids are distinct."""
    m = manifests.select("exchange", "symbol", "price_basis", F.col("start_date").alias("start"), F.col("as_of_date").alias("end"), "manifest_id", "captured_at")
    r = requests.select("exchange", "symbol", "price_basis", "request_id", F.col("start_date").alias("start"), F.col("as_of_date").alias("end"))
    best = latest_covering(r, m, ["exchange", "symbol", "price_basis"], "manifest_id", "captured_at")
    return requests.select("request_id").join(best, "request_id", "left")


def latest_per_key(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value))


def report_lookup(wanted: DataFrame, reports: DataFrame, passes: Column, on: list[str]) -> DataFrame:
    """First report (by id) of each wanted key that passes; null where none does."""
    ok = reports.where(passes).groupBy(*on).agg(F.min("report_id").alias("report_id"))
    return wanted.join(ok, on, "left")
