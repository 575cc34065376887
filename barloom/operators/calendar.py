"""Trading calendars, coverage and as-of session mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERIES
from .prefix_scan import cut, running
from .rank_calendar import CALENDAR, is_session, next_session, on_calendar, previous_session, rank, session_at


def calendar_sessions(years: DataFrame, closures: DataFrame) -> DataFrame:
    """Sessions of ``years(exchange, year)``: weekdays that are no closure, numbered per exchange."""
    days = years.select("exchange", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("session_date")).where(F.weekday("session_date") < 5)
    open_ = days.join(closures.select("session_date").distinct(), "session_date", "left_anti")
    return open_.select("exchange", "session_date", F.row_number().over(Window.partitionBy("exchange").orderBy("session_date")).alias("ordinal"))


def expected(sessions: DataFrame, universe: DataFrame) -> DataFrame:
    """Sessions of each instrument within its effective interval."""
    on = universe.select("exchange", "symbol", "effective_from", "effective_to").join(sessions, "exchange")
    return on.where((F.col("session_date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("session_date") <= F.col("effective_to")))).select("exchange", "symbol", "session_date", "ordinal")


def coverage_missing(bars: DataFrame, sessions: DataFrame, universe: DataFrame, documented: DataFrame, start: str, as_of: str, latest: str) -> DataFrame:
    """``exchange, symbol, missing_date, kind``: expected sessions up to the latest completed one without bar or
    documented absence; a row where the request starts before the instrument, and one where it ends after the
    latest completed session."""
    present = bars.select("exchange", "symbol", F.col("trading_date").alias("session_date"))
    day = lambda s: F.lit(s).cast("date")
    want = expected(sessions, universe).where(F.col("session_date").between(day(start), F.least(day(as_of), day(latest))))
    keys = ["exchange", "symbol", "session_date"]
    gaps = want.join(present, keys, "left_anti").join(documented.select(*keys), keys, "left_anti").select("exchange", "symbol", F.col("session_date").alias("missing_date"), F.lit("expected_session_missing").alias("kind"))
    early = universe.where(day(start) < F.col("effective_from")).select("exchange", "symbol", day(start).alias("missing_date"), F.lit("pre_effective_range").alias("kind"))
    late = universe.where(day(as_of) > day(latest)).select("exchange", "symbol", day(as_of).alias("missing_date"), F.lit("incomplete_current_session").alias("kind"))
    return gaps.unionByName(early).unionByName(late)


def documented_absence(bars: DataFrame, sessions: DataFrame, universe: DataFrame, documented: DataFrame) -> DataFrame:
    keys = ["exchange", "symbol", "session_date"]
    present = bars.select("exchange", "symbol", F.col("trading_date").alias("session_date"))
    return expected(sessions, universe).join(present, keys, "left_anti").join(documented, keys)


def documented_conflict(bars: DataFrame, sessions: DataFrame, documented: DataFrame) -> DataFrame:
    """Documented dates that are no session, or that have a bar."""
    present = bars.select("exchange", "symbol", F.col("trading_date").alias("session_date"))
    off = documented.join(sessions, ["exchange", "session_date"], "left_anti").withColumn("conflict", F.lit("not_a_session"))
    on = documented.join(present, ["exchange", "symbol", "session_date"], "left_semi").withColumn("conflict", F.lit("has_bar"))
    return off.unionByName(on)


def shared_series(*tables: DataFrame) -> list[str]:
    """The columns that name a series, as far as all tables have them."""
    return [c for c in SERIES if all(c in t.columns for t in tables)]


def asof_forward(events: DataFrame, bars: DataFrame, date: str = "effective_date") -> DataFrame:
    """Adds ``application_date``, the first bar date of the series on or after the event's, series told by the columns that both
    tables have; one shuffle: events and bars in one falling order, events after the bars of their day, so that the last bar so far is the
    one sought and each row is looked at once."""
    by = shared_series(events, bars)
    cols = [c for c in events.columns if c not in by]
    e = events.select(*by, F.col(date).alias("_d"), F.lit(0).alias("_bar"), F.struct(*cols).alias("_e"))
    b = bars.select(*by, F.col("trading_date").alias("_d"), F.lit(1).alias("_bar"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    w = Window.partitionBy(*by).orderBy(F.col("_d").desc(), F.col("_bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("_bar") == 1, F.col("_d")), ignorenulls=True).over(w)
    return e.unionByName(b).withColumn("application_date", nxt).where("_bar = 0").select(*by, "_e.*", "application_date")


def asof_forward_long(events: DataFrame, bars: DataFrame, date: str = "effective_date", blocks: int = 256) -> DataFrame:
    """``asof_forward`` for series too long for one task: the bar so far, in falling order, by a two-level scan over blocks of dates (or of timestamps). Events
    without a date have no application date."""
    by = shared_series(events, bars)
    e = events.select(*by, F.col(date).alias("_d"), F.lit(0).alias("_bar"), F.struct(*(c for c in events.columns if c not in by)).alias("_e"))
    b = bars.select(*by, F.col("trading_date").alias("_d"), F.lit(1).alias("_bar"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    rows = e.unionByName(b)
    order = F.when(F.col("_d").isNotNull(), F.struct("_d", "_bar"))
    out = running(rows, by, order, cut(rows, "_d", blocks), {"application_date": ("last", F.when(F.col("_bar") == 1, F.col("_d")))}, falling=True)
    return out.where("_bar = 0").select(*by, "_e.*", "application_date")


def application_errors(applied: DataFrame, bars: DataFrame) -> DataFrame:
    """Events that no bar follows, that share a session with another, or that land on the first bar."""
    by = shared_series(applied, bars)
    first = bars.groupBy(*by).agg(F.min("trading_date").alias("first_bar"))
    n = F.count("*").over(Window.partitionBy(*by, "application_date"))
    out = applied.withColumn("n", n).join(first, by, "left")
    why = F.when(F.col("application_date").isNull(), "no_session_follows").when(F.col("n") > 1, "session_shared").when(F.col("application_date") == F.col("first_bar"), "first_bar")
    return out.withColumn("error", why).where("error is not null").drop("n", "first_bar")


def session_neighbors(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """``exchange, day, previous_session, next_session`` of any dates ``(exchange, day)``; ``sessions`` as they are or packed (``rank_calendar.pack``)."""
    day = F.col("day")
    return on_calendar(dates.select("exchange", "day"), sessions, "exchange").select("exchange", "day", previous_session(day).alias("previous_session"), next_session(day).alias("next_session"))


def execution_schedule(signals: DataFrame, sessions: DataFrame, delay: int = 1) -> DataFrame:
    """``signals`` with ``execution_date, status``: the session ``delay`` places on; past the end: rejected; unknown dates: error. ``sessions`` as they are or
    packed."""
    out = on_calendar(signals, sessions, "exchange").withColumn("known", is_session(F.col("signal_date")))
    out = out.withColumn("execution_date", F.when(F.col("known"), next_session(F.col("signal_date"), delay))).drop(CALENDAR)
    return out.withColumn("status", F.when(~F.col("known"), "unknown_signal").when(F.col("execution_date").isNull(), "rejected").otherwise("scheduled")).drop("known")


def missing_session_ranges(missing: DataFrame, sessions: DataFrame) -> DataFrame:
    """Runs of missing sessions that are neighbours in the calendar: ``exchange, symbol, range_start, range_end, n``."""
    rows = missing.where("kind = 'expected_session_missing'").select("exchange", "symbol", F.col("missing_date").alias("session_date")).join(sessions, ["exchange", "session_date"])
    w = Window.partitionBy("exchange", "symbol").orderBy("ordinal")
    return rows.withColumn("island", F.col("ordinal") - F.row_number().over(w)).groupBy("exchange", "symbol", "island").agg(F.min("session_date").alias("range_start"), F.max("session_date").alias("range_end"), F.count("*").alias("n")).drop("island")


def coverage_summary(bars: DataFrame, missing: DataFrame, documented: DataFrame) -> DataFrame:
    """Per instrument: bars present, whether no expected session is missing, and how many are missing or documented."""
    keys = ["exchange", "symbol"]
    have = bars.groupBy(*keys).agg(F.count_distinct("trading_date").alias("present"))
    gaps = missing.groupBy(*keys).agg(F.count_if(F.col("kind") == "expected_session_missing").alias("missing"), F.min(F.when(F.col("kind") == "expected_session_missing", F.col("missing_date"))).alias("first_missing"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    docs = documented.groupBy(*keys).agg(F.count("*").alias("documented"))
    out = have.join(gaps, keys, "full_outer").join(docs, keys, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, zero("present").alias("present"), zero("missing").alias("missing"), zero("documented").alias("documented"), "first_missing", "kinds", (zero("missing") == 0).alias("complete"))


def request_bounds(sessions: DataFrame, exclude: DataFrame, start: str, end: str) -> DataFrame:
    """First and last requestable session of each exchange after exclusions."""
    s = sessions.where(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return s.join(exclude, ["exchange", "session_date"], "left_anti").groupBy("exchange").agg(F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"), F.count("*").alias("sessions"))


def split_by_year(sessions: DataFrame, start: str, end: str) -> DataFrame:
    s = sessions.where(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return s.groupBy("exchange", F.year("session_date").alias("year")).agg(F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"))


def month_end_sessions(dates: DataFrame, date: str = "trading_date") -> DataFrame:
    return dates.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max(date).alias("signal_date")).select("signal_date")


def classify_date(rows: DataFrame, universe: DataFrame, sessions: DataFrame, latest: str) -> DataFrame:
    """Kind of each ``(exchange, symbol, day)``: the first of outside the effective range, no session, not yet
    complete, expected."""
    on = rows.join(universe.select("exchange", "symbol", "effective_from", "effective_to"), ["exchange", "symbol"])
    on = on.join(sessions.select("exchange", F.col("session_date").alias("day"), F.lit(True).alias("is_session")), ["exchange", "day"], "left")
    out = (F.col("day") < F.col("effective_from")) | F.coalesce(F.col("day") > F.col("effective_to"), F.lit(False))
    kind = F.when(out, "pre_effective_range").when(F.col("is_session").isNull(), "non_session").when(F.col("day") > F.lit(latest).cast("date"), "incomplete_current_session").otherwise("expected_session_missing")
    return on.select("exchange", "symbol", "day", kind.alias("kind"))


def latest_completed_session(instants: DataFrame, sessions: DataFrame, zone: str = "Asia/Shanghai", close: str = "16:00") -> DataFrame:
    """``now, latest``: today's session from its close on (local time), else the one before."""
    local = F.from_utc_timestamp("now", zone)
    rows = instants.select("now", F.when(F.date_format(local, "HH:mm") >= close, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1)).alias("d"))
    # One calendar for all.
    one = sessions.select(F.lit(1).alias("_all"), "session_date").distinct()
    return on_calendar(rows.withColumn("_all", F.lit(1)), one, "_all").select("now", session_at(rank(F.col("d"))).alias("latest"))


def market_symbol(exchange: Column, symbol: Column) -> Column:
    """Six-digit codes with their market's prefix, else null."""
    prefix = F.when(exchange == "SSE", "sh").when(exchange == "SZSE", "sz")
    return F.when(symbol.rlike("^[0-9]{6}$"), F.concat(prefix, symbol))
