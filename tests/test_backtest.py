import random

import pytest
from helpers import day
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators import backtest as B


def cost(n, m=1.0):
    return (max(n * B.RATE, B.MINIMUM) + n * (B.HALF_SPREAD + B.SLIPPAGE)) * m if n > 0 else 0.0


def afford(c, m=1.0):
    s = B.HALF_SPREAD + B.SLIPPAGE
    flat = (c - m * B.MINIMUM) / (1 + m * s)
    return 0.0 if flat <= 0 else flat if flat * B.RATE <= B.MINIMUM else c / (1 + m * (B.RATE + s))


def loop(cash, qty, opens, weights, m=1.0):
    """One rebalance by a plain loop."""
    value = cash + sum(qty[s] * opens[s] for s in qty)
    gaps = {s: value * weights[s] - qty[s] * opens[s] for s in qty}
    out = {}
    for s in sorted(qty):
        if gaps[s] < 0:
            cash += -gaps[s] - cost(-gaps[s], m)
            out[s] = gaps[s]
    for s in sorted(qty):
        if gaps[s] >= 0:
            n = 0.0 if cash <= 0 else gaps[s] if gaps[s] + cost(gaps[s], m) <= cash else afford(cash, m)
            cash -= n + cost(n, m)
            out[s] = n
    return cash, {s: qty[s] + out[s] / opens[s] for s in qty}, out


def test_known_costs(spark):
    r = spark.range(1).select(B.trade_cost(F.lit(1000.0)).alias("a"), B.trade_cost(F.lit(1000.0), 2.0).alias("b"), B.trade_cost(F.lit(0.0)).alias("c"), B.affordable_notional(F.lit(5.0)).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (pytest.approx(5.5), pytest.approx(11.0), 0.0, 0.0)


@given(st.floats(0.01, 1e7), st.sampled_from([1.0, 2.0]))
@settings(max_examples=200, deadline=None)
def test_affordable_spends_all(c, m):
    n = afford(c, m)
    assert n + cost(n, m) <= c * (1 + 1e-9)
    assert n == 0 or n + cost(n, m) >= c * (1 - 1e-9)


def test_rebalance_equals_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(60):
        names = [f"S{k}" for k in range(4)]
        qty = {s: rng.choice([0.0, rng.uniform(0, 50)]) for s in names}
        opens = {s: rng.uniform(1, 300) for s in names}
        w = [rng.random() for _ in names]
        weights = {s: x / sum(w) * rng.choice([1.0, 0.9]) for s, x in zip(names, w)}
        cash = rng.uniform(0, 5000)
        want[p] = loop(cash, qty, opens, weights)
        rows += [(p, s, cash, qty[s], opens[s], weights[s], 1.0) for s in names]
    df = spark.createDataFrame(rows, "p int, symbol string, cash double, qty double, open double, weight double, multiplier double")
    for r in B.rebalance_trades(df, "p").collect():
        c, q, out = want[r["p"]]
        assert r["notional"] == pytest.approx(out[r["symbol"]], abs=1e-6) and r["new_cash"] == pytest.approx(c, abs=1e-6) and r["new_qty"] == pytest.approx(q[r["symbol"]], abs=1e-9)


def test_roll_forward_equals_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for p in range(12):
        cash, qty, m = B.INITIAL_CASH, {s: 0.0 for s in "ABC"}, rng.choice([1.0, 2.0])
        for d in range(8):
            opens = {s: rng.uniform(1, 300) for s in "ABC"}
            w = [rng.random() for _ in "ABC"]
            weights = {s: x / sum(w) for s, x in zip("ABC", w)}
            cash, qty, _ = loop(cash, qty, opens, weights, m)
            want[p, day(d)] = (cash, dict(qty))
            rows += [(p, day(d), s, opens[s], weights[s], m) for s in "ABC"]
    df = spark.createDataFrame(rows, "p int, execution_date date, symbol string, open double, weight double, multiplier double")
    got = B.portfolio_roll_forward(df, "p").collect()
    assert len(got) == len(rows)
    for r in got:
        c, q = want[r["p"], r["execution_date"]]
        assert r["cash"] == pytest.approx(c, abs=1e-6) and r["qty"] == pytest.approx(q[r["symbol"]], abs=1e-9)


def test_mark_to_market(spark):
    rolled = spark.createDataFrame([(1, day(1), "A", 10.0, 500.0)], "p int, execution_date date, symbol string, qty double, cash double")
    b = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(2), 3.0)], "symbol string, trading_date date, close double")
    assert [(r["equity"], round(r["cash_weight"], 4)) for r in B.mark_to_market(rolled, b, b.select(F.lit(1).alias("p"), "trading_date"), "p").orderBy("trading_date").collect()] == [(100000, 1), (520, 0.9615), (530, 0.9434)]
