"""Calendars as bitmaps with prefix counts: ranks of days and sessions by number, as column expressions.

A calendar is one row per exchange: a bit a day in words of 64, the number of sessions before each word, and the sessions in order. The rank of a day, the
sessions up to it, is the prefix count of its word and the bits up to it; the session of a rank is an element. So neighbours, ordinals and steps of k sessions
need no window, no range join and no shuffle of the rows: the few calendar rows are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR = "_calendar"
_EPOCH = "1970-01-01"


def _number(day: Column) -> Column:
    return F.datediff(day, F.lit(_EPOCH).cast("date"))


def pack(sessions: DataFrame, *by: str, date: str = "session_date") -> DataFrame:
    """``by`` and the calendar of its sessions; what is gathered is bounded by the days of a calendar."""
    n = _number(F.col(date))
    days = sessions.select(*by, F.col(date).alias("day"), F.shiftright(n, 6).alias("word"), F.lit(1).cast("long").alias("one"), n.bitwiseAND(63).alias("bit")).distinct()
    words = days.groupBy(*by, "word").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits"), F.array_sort(F.collect_list("day")).alias("days"))
    whole = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", "bits", "days"))).alias("w"))
    first, last = F.col("w")[0]["word"], F.element_at("w", -1)["word"]
    at = F.map_from_entries(F.transform("w", lambda w: F.struct(w["word"], w["bits"])))
    # Words without a session are zero.
    bits = F.transform(F.sequence(first, last), lambda k: F.coalesce(F.try_element_at(F.col("at"), k), F.lit(0).cast("long")))
    whole = whole.select(*by, first.alias("first"), at.alias("at"), F.flatten(F.transform("w", lambda w: w["days"])).alias("sessions"), "w").select(*by, "first", "sessions", bits.alias("bits"))
    before = F.aggregate("bits", F.array(F.lit(0)), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + F.bit_count(b))))
    return whole.select(*by, F.struct("first", "bits", before.alias("before"), "sessions").alias(CALENDAR))


def on_calendar(rows: DataFrame, sessions: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the calendar of their ``by``, null where there is none. ``sessions`` may be packed already."""
    return rows.join(F.broadcast(sessions if CALENDAR in sessions.columns else pack(sessions, *by)), list(by), "left")


def _of(name: str) -> Column:
    return F.col(f"{CALENDAR}.{name}")


def rank(day: Column) -> Column:
    """Sessions up to and with ``day``."""
    n = _number(day)
    w = F.shiftright(n, 6) - _of("first")
    # All bits up to the day's: of the last day of a word, all ones.
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - n.bitwiseAND(63))
    inside = F.get(_of("before"), w) + F.bit_count(F.get(_of("bits"), w).bitwiseAND(upto))
    return F.when(w < 0, 0).when(w >= F.size(_of("bits")), F.size(_of("sessions"))).otherwise(inside)


def is_session(day: Column) -> Column:
    n = _number(day)
    w = F.shiftright(n, 6) - _of("first")
    word = F.when((w >= 0) & (w < F.size(_of("bits"))), F.get(_of("bits"), w))
    return F.coalesce(F.call_function("shiftrightunsigned", word, n.bitwiseAND(63)).bitwiseAND(1) == 1, F.lit(False))


def session_at(k: Column) -> Column:
    """The ``k``-th session, from 1; null outside the calendar."""
    return F.when(k >= 1, F.get(_of("sessions"), k - 1))


def next_session(day: Column, k: int = 1) -> Column:
    """The ``k``-th session after ``day``."""
    return session_at(rank(day) + k)


def previous_session(day: Column) -> Column:
    return session_at(rank(day) - is_session(day).cast("int"))
