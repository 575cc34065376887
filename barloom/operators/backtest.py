"""Costs, rebalances and portfolio roll-forward as table operators over any number of portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, MINIMUM, HALF_SPREAD, SLIPPAGE = 0.0003, 5.0, 0.0002, 0.0003
INITIAL_CASH = 100000.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def trade_cost(notional: Column, multiplier=1.0, rate=RATE, minimum=MINIMUM, half_spread=HALF_SPREAD, slippage=SLIPPAGE) -> Column:
    """Commission with its minimum, half spread and slippage of a positive notional; of none, nothing."""
    n = notional
    return F.when(n > 0, (F.greatest(n * lit(rate), lit(minimum)) + n * (lit(half_spread) + lit(slippage))) * lit(multiplier)).otherwise(F.lit(0.0))


def affordable_notional(cash: Column, multiplier=1.0, rate=RATE, minimum=MINIMUM, half_spread=HALF_SPREAD, slippage=SLIPPAGE) -> Column:
    """Largest notional whose price and cost fit into the cash. A rate of zero has no minimum."""
    m, r, low, s = lit(multiplier), lit(rate), lit(minimum), lit(half_spread) + lit(slippage)
    flat = (cash - m * low) / (1 + m * s)  # while the minimum holds
    full = cash / (1 + m * (r + s))
    return F.when(r == 0, F.greatest(cash / (1 + m * s), F.lit(0.0))).when(flat <= 0, F.lit(0.0)).when(flat * r <= low, flat).otherwise(full)


def bps_to_rate(bps: Column) -> Column:
    return bps / 10000


def rebalance_trades(positions: DataFrame, *portfolio: str) -> DataFrame:
    """One rebalance of each portfolio. ``positions``: portfolio, symbol, cash, qty, open, weight, multiplier.

    Sides are fixed by the gap before any trade. All sells come first; buys follow in symbol order, each as far as
    the cash left goes, which is a running sum: once a buy is cut, the cash is spent."""
    w = Window.partitionBy(*portfolio)
    held = F.col("qty") * F.col("open")
    rows = positions.withColumn("value", F.col("cash") + F.sum(held).over(w)).withColumn("gap", F.col("value") * F.col("weight") - held)
    m = F.col("multiplier")
    rows = rows.withColumn("sell", F.greatest(-F.col("gap"), F.lit(0.0))).withColumn("want", F.greatest(F.col("gap"), F.lit(0.0)))
    rows = rows.withColumn("after", F.col("cash") + F.sum(F.col("sell") - trade_cost(F.col("sell"), m)).over(w))
    before = w.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("need", F.col("want") + trade_cost(F.col("want"), m)).withColumn("left", F.col("after") - F.coalesce(F.sum("need").over(before), F.lit(0.0)))
    buy = F.when(F.col("left") <= 0, 0.0).when(F.col("need") <= F.col("left"), F.col("want")).otherwise(affordable_notional(F.col("left"), m))
    rows = rows.withColumn("notional", F.when(F.col("sell") > 0, -F.col("sell")).otherwise(buy)).withColumn("cost", trade_cost(F.abs("notional"), m))
    rows = rows.withColumn("new_qty", F.col("qty") + F.col("notional") / F.col("open")).withColumn("new_cash", F.col("cash") - F.sum(F.col("notional") + F.col("cost")).over(w)).withColumn("turnover", F.sum(F.abs("notional")).over(w) / F.col("value"))
    return rows.select(*portfolio, "symbol", "notional", "cost", "new_qty", "new_cash", "turnover")


def portfolio_roll_forward(steps: DataFrame, *portfolio: str, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """Chains of rebalances. ``steps``: portfolio, execution_date, symbol, open, weight, multiplier, with the same
    symbols on every date of a portfolio. Returns ``portfolio, execution_date, symbol, notional, cost, qty, cash, turnover``.

    A portfolio's rebalances are folded in order, one portfolio in one row; its array is bounded by
    rebalances times symbols."""
    day = steps.groupBy(*portfolio, "execution_date").agg(F.array_sort(F.collect_list(F.struct("symbol", F.col("open").cast("double").alias("open"), F.col("weight").cast("double").alias("weight")))).alias("legs"), F.max("multiplier").cast("double").alias("m"))
    runs = day.groupBy(*portfolio).agg(F.array_sort(F.collect_list(F.struct("execution_date", "legs", "m"))).alias("days"))
    leg = "struct<symbol:string,notional:double,cost:double,qty:double>"
    done = f"array<struct<execution_date:date,cash:double,turnover:double,legs:array<{leg}>>>"
    start = F.struct(F.lit(float(initial_cash)).alias("cash"), F.transform(F.get(F.col("days"), 0)["legs"], lambda x: F.lit(0.0)).alias("qty"), F.array().cast(done).alias("log"))

    def step(acc: Column, d: Column) -> Column:
        m = d["m"]

        def held(priced: Column) -> Column:  # value before trading
            return F.aggregate(priced, acc["cash"], lambda a, x: a + x["q"] * x["o"])

        priced = F.zip_with(d["legs"], acc["qty"], lambda x, q: F.struct(x["symbol"].alias("s"), x["open"].alias("o"), x["weight"].alias("w"), q.alias("q")))

        def trade(bound: Column) -> Column:
            """``bound``: priced legs and the value, bound to a name."""
            gaps = F.transform(bound["p"], lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["q"].alias("q"), (bound["v"] * x["w"] - x["q"] * x["o"]).alias("g")))
            begin = F.struct(acc["cash"].alias("cash"), F.array().cast(f"array<{leg}>").alias("legs"))

            def go(a: Column, x: Column, selling: bool) -> Column:
                own = F.greatest(-x["g"], F.lit(0.0)) if selling else F.greatest(x["g"], F.lit(0.0))
                n = own if selling else F.when(a["cash"] <= 0, F.lit(0.0)).when(own + trade_cost(own, m) <= a["cash"], own).otherwise(affordable_notional(a["cash"], m))
                c = trade_cost(n, m)
                signed = -n if selling else n
                return F.struct((a["cash"] - signed - c).alias("cash"), F.concat(a["legs"], F.array(F.struct(x["s"].alias("symbol"), signed.alias("notional"), c.alias("cost"), (x["q"] + signed / x["o"]).alias("qty")))).alias("legs"))

            sold = F.aggregate(F.filter(gaps, lambda x: x["g"] < 0), begin, lambda a, x: go(a, x, True))
            return F.aggregate(F.filter(gaps, lambda x: x["g"] >= 0), sold, lambda a, x: go(a, x, False))

        v = F.transform(F.array(priced), lambda p: F.struct(p.alias("p"), held(p).alias("v")))
        out = F.transform(v, lambda b: F.struct(trade(b).alias("t"), b["v"].alias("v")))
        return F.get(
            F.transform(out, lambda r: F.struct(
                r["t"]["cash"].alias("cash"), F.transform(F.array_sort(r["t"]["legs"]), lambda x: x["qty"]).alias("qty"),
                F.concat(acc["log"], F.array(F.struct(d["execution_date"].alias("execution_date"), r["t"]["cash"].alias("cash"), (F.aggregate(r["t"]["legs"], F.lit(0.0), lambda a, x: a + F.abs(x["notional"])) / r["v"]).alias("turnover"), F.array_sort(r["t"]["legs"]).alias("legs")))).alias("log"),
            )), 0)

    log = runs.select(*portfolio, F.explode(F.aggregate("days", start, step)["log"]).alias("d"))
    return log.select(*portfolio, "d.execution_date", "d.cash", "d.turnover", F.explode("d.legs").alias("l")).select(*portfolio, "execution_date", "l.symbol", "l.notional", "l.cost", "l.qty", "cash", "turnover")


def mark_to_market(rolled: DataFrame, bars: DataFrame, days: DataFrame, *portfolio: str, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """``portfolio, trading_date, equity, cash_weight`` on each of ``days(trading_date, some of portfolio)``, the sessions of the portfolios that
    share their values: the latest rebalance's holdings at the close; before the first, cash."""
    state = rolled.groupBy(*portfolio, "execution_date").agg(F.first("cash").alias("cash"), F.collect_list(F.struct("symbol", "qty")).alias("legs"))
    on = [c for c in portfolio if c in days.columns]
    days = rolled.select(*portfolio).distinct().join(days.select(*on, "trading_date").distinct(), on)
    # A date has at most one state: the last on or before it, by one ordered pass per portfolio.
    rows = days.join(state.withColumnRenamed("execution_date", "trading_date"), [*portfolio, "trading_date"], "left")
    w = Window.partitionBy(*portfolio).orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cash", F.last("cash", ignorenulls=True).over(w)).withColumn("legs", F.last("legs", ignorenulls=True).over(w))
    held = rows.select(*portfolio, "trading_date", "cash", F.explode_outer("legs").alias("l")).select(*portfolio, "trading_date", "cash", F.col("l.symbol").alias("symbol"), F.col("l.qty").alias("qty"))
    held = held.join(bars.select("symbol", "trading_date", F.col("close").cast("double").alias("close")), ["symbol", "trading_date"], "left")
    out = held.groupBy(*portfolio, "trading_date").agg(F.coalesce(F.first("cash"), F.lit(float(initial_cash))).alias("cash"), F.coalesce(F.sum(F.col("qty") * F.col("close")), F.lit(0.0)).alias("stock"))
    return out.select(*portfolio, "trading_date", (F.col("cash") + F.col("stock")).alias("equity"), (F.col("cash") / (F.col("cash") + F.col("stock"))).alias("cash_weight"))


def fill_audit(trades: DataFrame, raw: DataFrame) -> DataFrame:
    """Trades with the raw open of their session and the raw quantity."""
    r = raw.select("symbol", F.col("trading_date").alias("execution_date"), F.col("open").cast("double").alias("raw_open"))
    return trades.where("notional <> 0").join(r, ["symbol", "execution_date"], "left").withColumn("raw_qty", F.col("notional") / F.col("raw_open"))
