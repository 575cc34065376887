"""Row rules and guards. Each returns the offending rows with a reason; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is broken (its condition is true), else null."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all broken rules."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def ohlc_row_rules() -> list[tuple[str, Column]]:
    return [
        ("missing", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull()),
        ("price_not_positive", F.least("open", "high", "low", "close") <= 0),
        ("volume_negative", F.col("volume") < 0),
        ("low_above_body", F.col("low") > F.least("open", "close")),
        ("high_below_body", F.col("high") < F.greatest("open", "close")),
        ("low_above_high", F.col("low") > F.col("high")),
    ]


def ohlc_validity(bars: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first one they break."""
    return bars.withColumn("reason", first_reason(ohlc_row_rules())).where("reason is not null")


def load_faults(bars: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Every row with ``reason``: the first of ``rules`` or of the row rules that it breaks, or ``duplicate`` where another row has its key;
    null for a good row."""
    n = F.count("*").over(Window.partitionBy(*KEY))
    keyed = ("missing", F.coalesce(*(F.when(F.col(c).isNull(), True) for c in KEY), F.lit(False)))
    return bars.withColumn("_n", n).withColumn("reason", first_reason([*rules, keyed, *ohlc_row_rules(), ("duplicate", F.col("_n") > 1)])).drop("_n")


def duplicate_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def range_filter(bars: DataFrame, start: str, as_of: str) -> DataFrame:
    return bars.where(F.col("trading_date").between(F.lit(start).cast("date"), F.lit(as_of).cast("date")))


def range_violations(bars: DataFrame, start: str, as_of: str) -> DataFrame:
    return bars.where(~F.coalesce(F.col("trading_date").between(F.lit(start).cast("date"), F.lit(as_of).cast("date")), F.lit(False)))


def effective_membership(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars within their instrument's effective interval."""
    u = universe.select("exchange", "symbol", "effective_from", "effective_to")
    on = bars.join(u, ["exchange", "symbol"])
    return on.where((F.col("trading_date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("trading_date") <= F.col("effective_to")))).drop("effective_from", "effective_to")


def membership_overlaps(universe: DataFrame) -> DataFrame:
    """Intervals of one instrument that reach into its next interval."""
    w = Window.partitionBy("exchange", "symbol").orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    nxt = F.lead("effective_from").over(w)
    return universe.withColumn("next_from", nxt).where("next_from is not null and (effective_to is null or next_from <= effective_to)")


def identity_guard(bars: DataFrame, series: str) -> DataFrame:
    """Series that mix identities or repeat dates."""
    out = bars.groupBy(series).agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("exchange").alias("exchanges"), F.count_distinct("price_basis").alias("bases"), (F.count("*") - F.count_distinct("trading_date")).alias("repeated_dates"))
    return out.where("symbols > 1 or exchanges > 1 or bases > 1 or repeated_dates > 0")


def action_row_rules() -> list[tuple[str, Column]]:
    return [
        ("cash_needs_cash_only", (F.col("kind") == "cash") & (F.coalesce(F.col("cash_per_unit"), F.lit(0)) <= 0) | (F.col("kind") == "cash") & F.col("split_ratio").isNotNull()),
        ("split_needs_ratio_only", (F.col("kind") == "split") & (F.coalesce(F.col("split_ratio"), F.lit(0)) <= 0) | (F.col("kind") == "split") & F.col("cash_per_unit").isNotNull()),
        ("record_after_effective", F.col("record_date") > F.col("effective_date")),
        ("payment_before_effective", F.col("payment_date") < F.col("effective_date")),
    ]


def action_rules(events: DataFrame, complete: bool = True) -> DataFrame:
    """Events with their broken rules; of a complete ledger also candidates and dates that do not rise."""
    w = Window.partitionBy("ledger_id").orderBy("effective_date", "event_id")
    rules = list(action_row_rules())
    if complete:
        rules += [("candidate_in_complete_ledger", F.col("status") == "candidate"), ("date_repeated", F.coalesce(F.lag("effective_date").over(w) >= F.col("effective_date"), F.lit(False)))]
    return events.withColumn("reasons", reasons(rules)).where(F.size("reasons") > 0)


def manifest_row_rules() -> list[tuple[str, Column]]:
    return [
        ("first_after_last", F.col("first_date") > F.col("last_date")),
        ("outside_request", (F.col("first_date") < F.col("start_date")) | (F.col("last_date") > F.col("as_of_date"))),
        ("no_rows", F.col("row_count") <= 0),
        ("bad_hash", ~F.col("sha256").rlike("^[0-9a-f]{64}$")),
        ("complete_with_missing", F.col("complete") & F.exists(F.coalesce(F.col("coverage_missing"), F.array()), lambda x: x["kind"] == "expected_session_missing")),
    ]


def manifest_rules(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("reasons", reasons(manifest_row_rules())).where(F.size("reasons") > 0)


#: Words of titles that announce distributions, and those that announce splits.
CASH_TITLES, SPLIT_TITLES = ("收益分配", "分红公告"), ("份额折算", "份额拆分")


def announcement_filter(rows: DataFrame, base_url: str) -> DataFrame:
    """Announcements of distributions and splits, with their kind and an absolute address."""
    title = F.col("title")
    kind = F.when(title.rlike("|".join(SPLIT_TITLES)), "split").when(title.rlike("|".join(CASH_TITLES)), "cash")
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit(base_url), F.col("url"))).otherwise(F.col("url"))
    return rows.withColumn("kind", kind).withColumn("url", url).where("kind is not null")


def t1_guard(fills: DataFrame, signal: str = "signal_date", fill: str = "fill_date") -> DataFrame:
    """Fills that are not strictly after their signal."""
    return fills.where(F.col(fill).isNull() | (F.col(fill) <= F.col(signal)))


def panel_guard(panel: DataFrame, value: str) -> DataFrame:
    """One row: size of the panel, cells of its full grid, repeated, missing and non-positive cells, and the verdict."""
    cells = panel.groupBy("trading_date", "symbol").agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull() | (F.col(value) <= 0)).alias("bad"))
    out = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.count_distinct("trading_date") * F.count_distinct("symbol")).alias("grid"), F.count("*").alias("cells"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_cells"))
    return out.select("rows", "grid", (F.col("rows") - F.col("cells")).alias("repeated"), (F.col("grid") - F.col("cells")).alias("missing"), "bad_cells").withColumn("ok", (F.col("rows") > 0) & (F.col("repeated") == 0) & (F.col("missing") == 0) & (F.col("bad_cells") == 0))


def target_guard(targets: DataFrame, universe: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Dates whose weights name an unknown symbol, are negative, or do not add up to one."""
    known = universe.select("symbol").distinct().withColumn("known", F.lit(True))
    rows = targets.join(known, "symbol", "left")
    out = rows.groupBy("signal_date").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.count_if(F.col("known").isNull() & (F.col("symbol") != "CASH")).alias("unknown"))
    return out.where((F.abs(F.col("total") - 1) >= tolerance) | (F.col("least") < 0) | (F.col("unknown") > 0))


def equity_guard(curves: DataFrame, *curve: str) -> DataFrame:
    """Curves with fewer than two points, repeated dates, or points that are null or not positive."""
    out = curves.groupBy(*curve).agg(F.count("*").alias("points"), (F.count("*") - F.count_distinct("trading_date")).alias("repeated"), F.count_if(F.col("equity").isNull() | (F.col("equity") <= 0)).alias("bad"))
    return out.where("points < 2 or repeated > 0 or bad > 0")


def aligned(bars: DataFrame) -> DataFrame:
    """Bars of the dates that every symbol has (counted once, joined by date)."""
    symbols = bars.select("symbol").distinct()
    whole = bars.groupBy("trading_date").agg(F.count_distinct("symbol").alias("n")).join(symbols.agg(F.count("*").alias("n")), "n").select("trading_date")
    return bars.join(whole, "trading_date", "left_semi")


