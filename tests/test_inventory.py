"""Matching of ledger events and provider candidates against a loop that visits the ledger in order."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from helpers import day

from barloom.operators import inventory

EVENT = "exchange string, symbol string, event_id string, effective_date date, application_date date, kind string, official_value string"
CANDIDATE = "exchange string, symbol string, candidate_id string, kind string, candidate_date date, value double"
BAR = "exchange string, symbol string, price_basis string, trading_date date, close double"


def visited(events, candidates, days):
    """Matches of one ledger by a plain loop."""
    unused, out = list(candidates), []
    for e in sorted(events, key=lambda e: (e[3], e[2])):
        at = days.index(e[4])
        near = days[at : at + 2]
        fit = [c for c in unused if c[3] == e[5] and c[4] in near and Decimal(repr(c[5])).quantize(Decimal(e[6]), ROUND_HALF_EVEN) == Decimal(e[6])]
        if len(fit) == 1:
            unused.remove(fit[0])
            out.append((e[0], e[1], e[2], fit[0][2]))
    return out


def ledger(rng, k):
    """Sessions with gaps, events on many of them, and candidates that fit none, one or several."""
    symbol, exchange = f"S{k // 2}", ("SSE", "SZSE")[k % 2]  # a symbol stands on two exchanges
    days = sorted(rng.sample([day(i) for i in range(40)], 25))
    events, candidates = [], []
    for n, d in enumerate(sorted(rng.sample(days, rng.randrange(1, 14)))):
        events.append((exchange, symbol, f"e{n}", d, d, rng.choice(("split", "cash")), rng.choice(("2.0", "2.0", "0.25"))))
    for n in range(rng.randrange(0, 20)):
        e = rng.choice(events)
        near = days[days.index(e[4]) :][:3]
        candidates.append((exchange, symbol, f"c{n}", e[5], rng.choice(near), rng.choice((float(e[6]), float(e[6]) + 0.003, 7.0))))
    return events, candidates, [(exchange, symbol, "raw", d, 1.0) for d in days], days


def test_random_ledgers_equal_a_loop(spark):
    rng = random.Random(4)
    events, candidates, bars, want = [], [], [], []
    for k in range(1000):
        e, c, b, days = ledger(rng, k)
        events, candidates, bars = events + e, candidates + c, bars + b
        want += visited(e, c, days)
    got = inventory.candidate_event_match(spark.createDataFrame(events, EVENT), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(bars, BAR))
    assert sorted((r["exchange"], r["symbol"], r["event_id"], r["candidate_id"]) for r in got.collect()) == sorted(want)
    assert len(want) > 1500


def test_an_event_may_free_the_next_one(spark):
    """e1 fits c1; e2 fits c1 and c2, and has c2 alone when e1 has taken c1."""
    bars = spark.createDataFrame([("X", "A", "raw", day(i), 1.0) for i in range(5)], BAR)
    events = spark.createDataFrame([("X", "A", "e1", day(0), day(0), "split", "2.0"), ("X", "A", "e2", day(1), day(1), "split", "2.0")], EVENT)
    candidates = spark.createDataFrame([("X", "A", "c1", "split", day(1), 2.0), ("X", "A", "c2", "split", day(2), 2.0)], CANDIDATE)
    matches = inventory.candidate_event_match(events, candidates, bars)
    assert {(r["event_id"], r["candidate_id"]) for r in matches.collect()} == {("e1", "c1"), ("e2", "c2")}
    rows = inventory.event_inventory(events.selectExpr("*", "'verified' AS status"), candidates, matches).collect()
    assert all(r["classification"] == "SPLIT" and r["provider_confirmed"] for r in rows) and len(rows) == 2


@pytest.mark.parametrize("copies", [1, 2, 5000])
def test_many_candidates_of_one_event_are_not_gathered(spark, copies):
    bars = spark.createDataFrame([("X", "A", "raw", day(i), 1.0) for i in range(3)], BAR)
    events = spark.createDataFrame([("X", "A", "e1", day(0), day(0), "split", "2.0")], EVENT)
    candidates = spark.createDataFrame([("X", "A", f"c{k}", "split", day(1), 2.0) for k in range(copies)], CANDIDATE)
    assert inventory.candidate_event_match(events, candidates, bars).count() == (copies == 1)


def test_no_candidates_and_events_without_session(spark):
    bars = spark.createDataFrame([("X", "A", "raw", day(0), 1.0)], BAR)
    events = spark.createDataFrame([("X", "A", "e1", day(0), day(0), "split", "2.0"), ("X", "A", "e2", day(5), None, "split", "2.0")], EVENT)
    none = spark.createDataFrame([], CANDIDATE)
    assert inventory.candidate_event_match(events, none, bars).collect() == []
    last = spark.createDataFrame([("X", "A", "c1", "split", day(0), 2.0)], CANDIDATE)
    assert inventory.candidate_event_match(events, last, bars).first()["event_id"] == "e1"
