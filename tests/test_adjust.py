"""Exact adjustment against a loop in Python decimals of 28 digits."""

import random
from decimal import ROUND_HALF_EVEN, Decimal, getcontext, localcontext

import pytest
from helpers import day

from barloom.operators import adjust

BAR = "exchange string, symbol string, price_basis string, trading_date date, open decimal(28,10), high decimal(28,10), low decimal(28,10), close decimal(28,10), volume double"
EVENT = "exchange string, symbol string, effective_date date, split_ratio decimal(28,10), cash_per_unit decimal(28,10)"


def series(rng, symbol, n, k):
    """``n`` bars and ``k`` events on sessions, or on a closed day before one."""
    days = [day(2 * i) for i in range(n)]
    price = lambda: Decimal(rng.randrange(10**4, 10**8)) / Decimal(10 ** rng.randrange(2, 6))
    bars = [("X", symbol, "raw", d, *(price() for _ in range(4)), 1.0) for d in days]
    events = []
    for j, i in enumerate(sorted(rng.sample(range(1, n), k))):
        at = day(2 * i - rng.randrange(2))
        # Splits and joins in turn and small distributions, so that prices stay in the range of canonical decimals.
        ratio = Decimal(("2", "0.5", "1.1", "0.9", "0.3822195400", "2.6163")[j // 2 % 6])
        cash = (bars[i - 1][7] * rng.randrange(1, 50) / 10_000).quantize(Decimal("0.0000000001"))
        events.append(("X", symbol, at, ratio, None) if j % 2 else ("X", symbol, at, None, cash))
    return bars, events


def looped(bars, events, backward):
    """(factor, close) of each bar by the rules, one step after the other."""
    with localcontext() as c:
        c.prec = 28
        at = {}
        for e in events:
            at[next(b[3] for b in bars if b[3] >= e[2])] = e
        factor, out = Decimal(1), {}
        if backward:
            for i in range(len(bars) - 1, -1, -1):
                out[bars[i][3]] = (factor, bars[i][7] * factor)
                if e := at.get(bars[i][3]):
                    prev = bars[i - 1][7]
                    factor = factor / e[3] if e[3] is not None else factor * ((prev - e[4]) / prev)
        else:
            for i, b in enumerate(bars):
                if e := at.get(b[3]):
                    prev = bars[i - 1][7]
                    factor = factor * e[3] if e[3] is not None else factor * (prev / (prev - e[4]))
                out[b[3]] = (factor, b[7] * factor)
        return out


@pytest.mark.parametrize("backward", [False, True])
def test_five_hundred_events_equal_python_decimals(spark, backward):
    rng = random.Random(11)
    all_bars, all_events, want = [], [], {}
    for symbol, n, k in (("A", 1200, 500), ("B", 50, 3), ("C", 10, 0)):
        bars, events = series(rng, symbol, n, k)
        own = looped(bars, events, backward)
        all_bars, all_events = all_bars + bars, all_events + events
        want |= {(symbol, d): v for d, v in own.items()}
    f = adjust.exact_backward_adjust if backward else adjust.exact_forward_adjust
    got = {(r["symbol"], r["trading_date"]): r for r in f(spark.createDataFrame(all_bars, BAR).repartition(3), spark.createDataFrame(all_events, EVENT)).collect()}
    place = Decimal(1).scaleb(-28)
    with localcontext() as c:
        c.prec = 60
        for key, (factor, close) in want.items():
            assert Decimal(got[key]["factor"]) == factor, key
            assert got[key]["close"] == close.quantize(place, ROUND_HALF_EVEN), key
    assert len(got) == len(want) and getcontext().prec == 28


def test_errors_and_incomplete_ledgers(spark):
    bars, _ = series(random.Random(1), "A", 4, 0)
    b = spark.createDataFrame(bars, BAR)
    e = lambda *rows: spark.createDataFrame([("X", "A", *r) for r in rows], EVENT)
    for rows, message in (([(day(0), Decimal(2), None)], "first bar"), ([(day(2), Decimal(2), None), (day(1), Decimal(2), None)], "two events"), ([(day(2), None, Decimal(10**7))], "reaches"), ([(day(99), Decimal(2), None)], "no session")):
        with pytest.raises(Exception, match=message):
            adjust.exact_forward_adjust(b, e(*rows)).collect()
    # What no session follows is told by application_errors; it does not hide other errors here.
    assert adjust.cash_errors(b, e((day(99), Decimal(2), None), (day(2), None, Decimal(10**7)))).count() == 1
    named = e((day(2), Decimal(2), None)).selectExpr("'l1' as ledger_id", "*")
    for state in ("partial", None):
        with pytest.raises(Exception, match="not complete"):
            adjust.require_complete(named, spark.createDataFrame([("l1", state)], "ledger_id string, completeness string")).collect()
    assert adjust.require_complete(named, spark.createDataFrame([("l1", "complete")], "ledger_id string, completeness string")).count() == 1
