"""Corporate-action adjustment, backward and point in time."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PRICES, SERIES
from .calendar import asof_forward, shared_series


def rising():
    return Window.partitionBy(*SERIES).orderBy("trading_date")


def fault(message: str, type_: str) -> Column:
    """Ends the job with the message and the symbol of the row."""
    return F.raise_error(F.concat(F.lit(message + ": "), F.col("symbol"))).cast(type_)


def _with_events(bars: DataFrame, events: DataFrame, exact: bool = False, lenient: bool = False) -> DataFrame:
    """Bars with the previous close and, on application sessions, their event, as doubles or as they are stored (``exact``). An event of an instrument applies to each
    of its series; one that no session follows is an error, or left out where ``lenient`` (``application_errors`` lists such events)."""
    own = lambda c: F.col(c) if exact else F.col(c).cast("double")
    e = events.select(*shared_series(events, bars), "effective_date", "split_ratio", "cash_per_unit").join(bars.select(*SERIES).distinct(), shared_series(events, bars))
    at = asof_forward(e, bars)
    at = at.where("application_date is not null") if lenient else at.withColumn("application_date", F.coalesce("application_date", fault("no session follows an event", "date")))
    at = at.groupBy(*SERIES, F.col("application_date").alias("trading_date")).agg(F.count("*").alias("_events"), F.max(own("split_ratio")).alias("split_ratio"), F.max(own("cash_per_unit")).alias("cash_per_unit"))
    return bars.withColumn("_prev", F.lag(own("close")).over(rising())).join(at, [*SERIES, "trading_date"], "left")


def _factor(split: Column, cash: Column) -> Column:
    """The factor of a bar's event, or one. Errors: a basis other than raw, two events on one session, an event on the first bar, and a
    distribution that reaches the previous close."""
    own = F.when(F.col("price_basis") != "raw", fault("only raw prices can be adjusted", "double"))
    own = own.when(F.col("_events") > 1, fault("two events on one session", "double"))
    own = own.when(F.col("_events").isNotNull() & F.col("_prev").isNull(), fault("an event on the first bar", "double"))
    own = own.when(F.col("cash_per_unit") >= F.col("_prev"), fault("a distribution reaches the previous close", "double"))
    return own.when(F.col("split_ratio").isNotNull(), split).when(F.col("cash_per_unit").isNotNull(), cash).otherwise(1.0)


def _scaled(bars: DataFrame, basis: str) -> DataFrame:
    rows = bars.drop("split_ratio", "cash_per_unit")
    return rows.select(*[(F.col(c).cast("double") * F.col("factor")).alias(c) if c in PRICES else F.col(c) for c in rows.columns if not c.startswith("_")]).withColumn("price_basis", F.lit(basis))


def backward_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Front-adjusted prices: bars before an event are scaled so that the last bar keeps its price."""
    prev, cash = F.col("_prev"), F.col("cash_per_unit")
    rows = _with_events(bars, events).withColumn("_f", _factor(1 / F.col("split_ratio"), (prev - cash) / prev))
    # The product over all later bars, as a running one in falling order.
    later = Window.partitionBy(*SERIES).orderBy(F.col("trading_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return _scaled(rows.withColumn("factor", F.coalesce(F.product("_f").over(later), F.lit(1.0))), "qfq")


def forward_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Causal prices: bars from an event on are scaled; earlier rows never change."""
    prev, cash = F.col("_prev"), F.col("cash_per_unit")
    rows = _with_events(bars, events).withColumn("_f", _factor(F.col("split_ratio"), prev / (prev - cash)))
    return _scaled(rows.withColumn("factor", F.product("_f").over(rising().rowsBetween(Window.unboundedPreceding, 0))), "causal_adjusted")


# --- Exact prices ---------------------------------------------------------------------------------------

#: Fixed value: significant digits of exact factors and prices.
DIGITS = 28


def require_complete(events: DataFrame, ledgers: DataFrame) -> DataFrame:
    """``events`` of ledgers that are complete; one of a ledger of ``ledgers(ledger_id, completeness)`` that is not, or of none of them, ends the job."""
    known = events.join(ledgers.select("ledger_id", F.col("completeness").alias("_whole")), "ledger_id", "left")
    whole = F.coalesce(F.col("_whole") == "complete", F.lit(False))
    return known.where(F.when(whole, True).otherwise(fault("its ledger is not complete", "boolean"))).drop("_whole")


def exact_factors(bars: DataFrame, events: DataFrame, backward: bool = False) -> DataFrame:
    """``SERIES, trading_date, factor`` of each application session, as text: the product of the factors up to it, or, ``backward``, of those from it on, which
    scales the bars before it. Each quotient and product is rounded half-even to DIGITS significant digits in the order of events. Spark has no product
    of decimals and none of its types holds one of two such numbers, so the events of a series, which are few, are folded in one group; the bars never
    are. Errors as in ``forward_adjust``."""
    rows = _with_events(bars, events, exact=True).where("_events is not null")
    rows = rows.select(*SERIES, "trading_date", F.col("_prev").cast("string").alias("prev"), F.col("split_ratio").cast("string").alias("ratio"), F.col("cash_per_unit").cast("string").alias("cash"), _factor(F.lit(1.0), F.lit(1.0)).alias("checked"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        near = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN)
        f = f.sort_values("trading_date", ascending=not backward)
        now, out = Decimal(1), []
        for prev, ratio, cash in zip(f["prev"], f["ratio"], f["cash"]):
            if ratio is not None:
                now = near.divide(now, Decimal(ratio)) if backward else near.multiply(now, Decimal(ratio))
            elif cash is not None:
                less = near.subtract(Decimal(prev), Decimal(cash))
                now = near.multiply(now, near.divide(less, Decimal(prev)) if backward else near.divide(Decimal(prev), less))
            out.append(format(now, "f"))
        return f[[*SERIES, "trading_date"]].assign(factor=out)

    return rows.groupBy(*SERIES).applyInPandas(fold, ", ".join(f"{c} string" for c in SERIES) + ", trading_date date, factor string")


def _exactly(bars: DataFrame, factors: DataFrame, factor: Column, basis: str) -> DataFrame:
    """Prices times ``factor``, rounded to DIGITS significant digits and then, where that leaves more, to 28 places, as canonical decimals; a price of ten
    digits or more before the point is an error."""
    rows = bars.join(factors, [*SERIES, "trading_date"], "left").withColumn("factor", F.coalesce(factor, F.lit("1")))
    rows = rows.withColumns({c: F.col(c).cast("string") for c in PRICES})
    schema = ", ".join(f"{c} {'decimal(38,28)' if c in PRICES else t}" for c, t in rows.dtypes)

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, place = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN), Decimal(1).scaleb(-28)
        wide = Context(prec=60, rounding=ROUND_HALF_EVEN)
        for f in frames:
            by = {x: Decimal(x) for x in f["factor"].unique()}
            for c in PRICES:
                f[c] = [None if v is None else wide.quantize(near.multiply(Decimal(v), by[x]), place) for v, x in zip(f[c], f["factor"])]
            yield f

    return rows.mapInPandas(scale, schema).withColumn("price_basis", F.lit(basis))


def exact_forward_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """As ``forward_adjust``, in decimals of DIGITS significant digits: prices as ``decimal(38,28)``, and ``factor`` as text."""
    last = F.last("factor", ignorenulls=True).over(rising().rowsBetween(Window.unboundedPreceding, 0))
    return _exactly(bars, exact_factors(bars, events), last, "causal_adjusted")


def exact_backward_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """As ``backward_adjust``, in decimals of DIGITS significant digits: prices as ``decimal(38,28)``, and ``factor`` as text."""
    falling = Window.partitionBy(*SERIES).orderBy(F.col("trading_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return _exactly(bars, exact_factors(bars, events, True), F.last("factor", ignorenulls=True).over(falling), "qfq")


def cash_errors(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Distributions that reach the previous close. Events that no session follows are no matter here."""
    return _with_events(bars, events, lenient=True).where("cash_per_unit >= _prev").select("symbol", "trading_date", "cash_per_unit")


def changed_rows(before: DataFrame, after: DataFrame, *values: str) -> DataFrame:
    """Rows of ``before`` whose values differ in ``after``; must be none for causal outputs."""
    keys = ["symbol", "trading_date"]
    b = after.select(*keys, *(F.col(v).alias(f"{v}_after") for v in values))
    differs = None
    for v in values:
        d = ~F.col(v).eqNullSafe(F.col(f"{v}_after"))
        differs = d if differs is None else differs | d
    return before.select(*keys, *values).join(b, keys).where(differs)


def factor_change_points(series: DataFrame) -> DataFrame:
    """Cumulative ``(symbol, day, split, cash)`` to its discrete changes: ``split_ratio``, ``cash_per_unit``."""
    w = Window.partitionBy("symbol").orderBy("day")
    s, u = F.col("split") / F.lag("split", 1, 1.0).over(w), F.col("cash") - F.lag("cash", 1, 0.0).over(w)
    out = series.withColumn("_s", s).withColumn("_u", u)
    return out.select("symbol", "day", F.when(F.col("_s") != 1, F.col("_s")).alias("split_ratio"), F.when(F.abs("_u") > 1e-9, F.col("_u")).alias("cash_per_unit")).where("split_ratio is not null or cash_per_unit is not null")
