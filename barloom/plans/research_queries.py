"""Queries of adjustment, features, portfolios and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import adjust as A
from ..operators import backtest as B
from ..operators import calendar as C
from ..operators import evaluate as E
from ..operators import features as W
from ..operators import provenance as P
from ..operators import validate as V
from ..operators.prefix_scan import cut, running
from ..sources import fixtures as X
from ..sources.workdir import stored
from .registry import query
from .sql import with_parts


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns))


# --- Adjustment ---------------------------------------------------------------------------------------


@query(with_parts("factors") + "SELECT symbol, trading_date, round(close * backward + 0.0000003, 4) AS close, round(backward, 8) AS factor FROM factors")
def backward_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return A.backward_adjust(b, X.ledger(b)).select("symbol", "trading_date", F.round(F.col("close") + 0.0000003, 4).alias("close"), F.round("factor", 8).alias("factor"))


FORWARD = "SELECT symbol, trading_date, round(close * forward + 0.0000003, 4) AS close, round(forward, 6) AS factor FROM factors"


def forward(b: DataFrame) -> DataFrame:
    return A.forward_adjust(b, X.ledger(b)).select("symbol", "trading_date", F.round(F.col("close") + 0.0000003, 4).alias("close"), F.round("factor", 6).alias("factor"))


@query(with_parts("factors") + FORWARD)
def forward_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward(X.bars_dense(spark, sf_dir))


@query(with_parts("factors", wide=True) + FORWARD)
def forward_adjust_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward(X.bars_wide(spark, sf_dir))


def as_decimals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars of a series per supplier and their events, as decimals."""
    b = X.bars_wide(spark, sf_dir)
    led = X.ledger(b)
    money = lambda c: F.col(c).cast("decimal(28,10)")
    return b.withColumns({c: money(c) for c in ("open", "high", "low", "close")}), led.withColumns({c: money(c) for c in ("cash_per_unit", "split_ratio")})


@query(with_parts("factors", wide=True) + FORWARD)
def exact_forward_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In 28 digits; here shown to the places that SQL in doubles can tell."""
    out = A.exact_forward_adjust(*as_decimals(spark, sf_dir))
    return out.select("symbol", "trading_date", F.round(F.col("close").cast("double") + 0.0000003, 4).alias("close"), F.round(F.col("factor").cast("double"), 6).alias("factor"))


@query(with_parts("factors", wide=True) + "SELECT symbol, trading_date, round(close * backward + 0.0000003, 4) AS close, round(backward, 8) AS factor FROM factors")
def exact_backward_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.exact_backward_adjust(*as_decimals(spark, sf_dir))
    return out.select("symbol", "trading_date", F.round(F.col("close").cast("double") + 0.0000003, 4).alias("close"), F.round(F.col("factor").cast("double"), 8).alias("factor"))


@query(with_parts("ledger") + "SELECT symbol, effective_date AS trading_date, round(cash_per_unit * 200, 4) AS cash_per_unit FROM ledger WHERE kind = 'cash' AND k % 4 = 0")
def cash_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions that reach the previous close: every second one is made to."""
    b = X.bars_dense(spark, sf_dir)
    led = X.ledger(b).withColumn("cash_per_unit", F.when(F.col("k") % 4 == 0, F.col("cash_per_unit") * 200).otherwise(F.col("cash_per_unit")))
    return A.cash_errors(b, led).select("symbol", "trading_date", F.round("cash_per_unit", 4).alias("cash_per_unit"))


@query(with_parts("bars") + "SELECT symbol, trading_date FROM bars WHERE false")
def no_lookahead_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before 2000 that a later action or later bars would change: none."""
    b = stored(X.bars_dense(spark, sf_dir), "bars")
    led, cut = X.ledger(b), F.lit("2000-01-01").cast("date")
    early = b.where(F.col("trading_date") < cut)
    now = A.forward_adjust(early, led.where(F.col("effective_date") < cut))
    adjusted = A.changed_rows(now.where(F.col("trading_date") < cut), A.forward_adjust(b, led), "close")
    featured = A.changed_rows(W.features(early), W.features(b), "ma", "mom_126", "vol")
    return adjusted.select("symbol", "trading_date").unionByName(featured.select("symbol", "trading_date"))


@query(with_parts("features") + """
    SELECT symbol, trading_date, round(move, 6) AS move, jumped FROM (
        SELECT *, abs(move) > 0.2 AS jumped, lag(abs(move) > 0.2) OVER (PARTITION BY symbol ORDER BY trading_date) AS prev FROM (
            SELECT symbol, trading_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS move FROM bars)) WHERE coalesce(jumped, false) OR coalesce(prev, false)""")
def price_discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.price_discontinuity(X.bars_dense(spark, sf_dir)).select("symbol", "trading_date", F.round("move", 6).alias("move"), "jumped")


# --- Features and weights -----------------------------------------------------------------------------

MOMENTA = ("mom_63", "mom_126", "mom_252")


@query(with_parts("features") + "SELECT symbol, trading_date, close, round(ma, 7) AS ma, round(mom_63, 6) AS mom_63, round(mom_126, 6) AS mom_126, round(mom_252, 6) AS mom_252, round(vol, 6) AS vol FROM features")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.features(X.bars_dense(spark, sf_dir)).select("symbol", "trading_date", "close", "ma", *MOMENTA, "vol")
    return rounded(rounded(f, 7, "ma"), 6, *MOMENTA, "vol")


@query(with_parts("features") + "SELECT symbol, trading_date, round(ma, 7) AS ma FROM features WHERE ma IS NOT NULL")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.features(X.bars_dense(spark, sf_dir)).where("ma is not null").select("symbol", "trading_date", F.round("ma", 7).alias("ma"))


@query(with_parts("features") + "SELECT symbol, trading_date, round(mom_63, 6) AS mom_63, round(mom_126, 6) AS mom_126, round(mom_252, 6) AS mom_252 FROM features")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.features(X.bars_dense(spark, sf_dir)).select("symbol", "trading_date", *MOMENTA), 6, *MOMENTA)


@query(with_parts("features") + "SELECT symbol, trading_date, round(vol, 6) AS vol FROM features")
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.features(X.bars_dense(spark, sf_dir)).select("symbol", "trading_date", F.round("vol", 6).alias("vol"))


@query(with_parts("wide") + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS rn FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY trading_date))
    SELECT symbol, trading_date, round(CASE WHEN rn >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END, 7) AS ma, round(close / lag(close, 126) OVER w - 1, 6) AS mom_126, round(CASE WHEN rn > 60 THEN stddev_pop(r) OVER (w ROWS 59 PRECEDING) END, 6) AS vol
    FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)""")
def feature_table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.features(X.bars_wide(spark, sf_dir)).select("symbol", "trading_date", "ma", "mom_126", "vol")
    return rounded(rounded(f, 7, "ma"), 6, "mom_126", "vol")


@query(with_parts("features") + """
    SELECT trading_date, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY mom_126 DESC, symbol) AS rank FROM features
    WHERE ma IS NOT NULL AND mom_126 IS NOT NULL AND vol > 0 AND close >= ma) WHERE rank <= 2""")
def momentum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.momentum_rank(W.features(X.bars_dense(spark, sf_dir))).select("trading_date", "symbol", F.col("rank").cast("long").alias("rank"))


@query(with_parts("features") + """
    , ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY mom_126 DESC, symbol) AS rank FROM features WHERE ma IS NOT NULL AND mom_126 IS NOT NULL AND vol > 0 AND close >= ma) WHERE rank <= 2),
    own AS (SELECT trading_date, symbol, least(0.9 * (1 / vol) / sum(1 / vol) OVER (PARTITION BY trading_date), 0.5) AS weight FROM ranked)
    SELECT trading_date, symbol, round(weight, 8) AS weight FROM own
    UNION ALL SELECT d.trading_date, 'CASH', round(1 - coalesce(s.w, 0), 8) FROM (SELECT DISTINCT trading_date FROM bars) d LEFT JOIN (SELECT trading_date, sum(weight) AS w FROM own GROUP BY 1) s USING (trading_date)""")
def inverse_vol_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.features(X.bars_dense(spark, sf_dir))
    return rounded(W.inverse_vol_weights(f.select("trading_date"), W.momentum_rank(f)), 8, "weight")


@query(with_parts("targets") + "SELECT signal_date, symbol, round(weight, 8) AS weight FROM targets")
def monthly_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.monthly_targets(W.features(X.bars_dense(spark, sf_dir))), 8, "weight")


@query(with_parts("targets", wide=True) + "SELECT signal_date, symbol, round(weight, 8) AS weight FROM targets")
def monthly_targets_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.monthly_targets(W.features(X.bars_wide(spark, sf_dir))), 8, "weight")


@query(with_parts("bars") + """
    , e AS (SELECT max(trading_date) AS signal_date FROM bars GROUP BY date_trunc('month', trading_date)), u AS (SELECT DISTINCT symbol FROM bars)
    SELECT signal_date, symbol, round(1.0 / (SELECT count(*) FROM u), 8) AS weight FROM e, u UNION ALL SELECT signal_date, 'CASH', 0.0 FROM e""")
def equal_weight_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    return rounded(W.equal_weight_targets(C.month_end_sessions(b), X.universe(b)), 8, "weight")


@query(with_parts("targets") + "SELECT signal_date, round(sum(weight), 6) AS total, 0 AS bad FROM targets GROUP BY 1")
def target_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    t = stored(W.monthly_targets(W.features(b)), "targets")
    bad = V.target_guard(t, X.universe(b)).select("signal_date", F.lit(1).alias("b"))
    return t.groupBy("signal_date").agg(F.round(F.sum("weight"), 6).alias("total")).join(bad, "signal_date", "left").select("signal_date", "total", F.coalesce("b", F.lit(0)).alias("bad"))


@query(with_parts("targets") + "SELECT signal_date, round(sum(CASE WHEN symbol = 'CASH' THEN weight + 0.25 ELSE weight END), 6) AS total FROM targets WHERE month(signal_date) = 6 GROUP BY 1")
def target_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """June targets get a quarter too much cash, and are found."""
    b = X.bars_dense(spark, sf_dir)
    t = W.monthly_targets(W.features(b))
    t = t.withColumn("weight", F.when((F.month("signal_date") == 6) & (F.col("symbol") == "CASH"), F.col("weight") + 0.25).otherwise(F.col("weight")))
    return V.target_guard(t, X.universe(b)).select("signal_date", F.round("total", 6).alias("total"))


@query(with_parts("features") + """
    , s AS (SELECT symbol, trading_date, close, coalesce(lag(coalesce(close > ma, false)) OVER w, false) AS entry FROM features WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)),
    f AS (SELECT symbol, min(trading_date) AS d, first(close ORDER BY trading_date) AS c FROM s WHERE entry GROUP BY symbol)
    SELECT s.symbol, s.trading_date, entry, round(CASE WHEN s.trading_date >= f.d THEN 100000 * s.close / f.c ELSE 100000 END, 4) AS equity FROM s LEFT JOIN f USING (symbol)""")
def t1_signal_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.features(X.bars_dense(spark, sf_dir)).withColumn("signal", F.coalesce(F.col("close") > F.col("ma"), F.lit(False)))
    return rounded(W.t1_signal_shift(f, "signal", "symbol").select("symbol", "trading_date", "entry", "equity"), 4, "equity")


@query(with_parts("features") + """
    SELECT trading_date, symbol, k FROM (SELECT trading_date, symbol, row_number() OVER (PARTITION BY trading_date ORDER BY mom_63 DESC NULLS LAST, symbol) AS k FROM features) WHERE k <= 3""")
def top_k_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("trading_date").orderBy(F.col("mom_63").desc_nulls_last(), "symbol")
    return W.features(X.bars_dense(spark, sf_dir)).select("trading_date", "symbol", F.row_number().over(w).cast("long").alias("k")).where("k <= 3")


@query("""
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders), n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM d), s AS (SELECT unnest(generate_series(0, ((SELECT count(*) FROM d) - 625) // 125)) AS k)
    SELECT k AS split, a.t AS train_start, b.t AS train_end, c.t AS test_start, e.t AS test_end FROM s JOIN n a ON a.i = k * 125 JOIN n b ON b.i = k * 125 + 499 JOIN n c ON c.i = k * 125 + 500 JOIN n e ON e.i = k * 125 + 624 WHERE (SELECT count(*) FROM d) >= 625""")
def walk_forward_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("trading_date"))
    return W.walk_forward_splits(d, 500, 125)


@query(with_parts("curves") + """SELECT curve, trading_date FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY trading_date) AS a, row_number() OVER (PARTITION BY curve ORDER BY trading_date DESC) AS z FROM curves) WHERE a > 21 AND z > 5""")
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.edge_trim(curves(spark, sf_dir), 21, 5, "curve").select("curve", "trading_date")


# --- Curves: daily order values by priority stand in for equity ---------------------------------------


def curves(spark: SparkSession, sf_dir: str, key: str | None = "o_orderpriority") -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = [F.col(key).alias("curve")] if key else []
    rows = o.groupBy(*keys, F.year("o_orderdate").cast("long").alias("fold"), F.col("o_orderdate").cast("date").alias("trading_date"))
    return rows.agg((F.floor(F.sum("o_totalprice") / 1000 + 0.5) + 1000).cast("double").alias("equity"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir, None)


@query(with_parts("returns") + "SELECT curve, fold, trading_date, round(ret, 6) AS ret FROM returns")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.daily_returns(curves(spark, sf_dir), "curve", "fold").drop("equity"), 6, "ret")


@query(with_parts("metrics") + "SELECT curve, fold, trading_date, round(dd, 6) AS dd FROM allret WHERE curve <> 'BENCH'")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.drawdown(curves(spark, sf_dir), "curve", "fold").drop("equity"), 6, "dd")


STREAK = """,
    streaks AS (SELECT curve, fold, max(n) AS longest_drawdown FROM (
        SELECT curve, fold, count(*) FILTER (dd < 0) AS n FROM (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY curve, fold ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS island FROM allret) GROUP BY curve, fold, island) GROUP BY ALL)
"""


@query(with_parts("metrics") + STREAK + "SELECT * FROM streaks WHERE curve <> 'BENCH'")
def drawdown_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drawdown_streak(curves(spark, sf_dir), "curve", "fold")


@query(with_parts("curves") + "SELECT * FROM (SELECT curve, fold AS year, round(e / lag(e) OVER (PARTITION BY curve ORDER BY fold) - 1, 6) AS year_return FROM (SELECT curve, fold, last(equity ORDER BY trading_date) AS e FROM curves GROUP BY ALL)) WHERE year_return IS NOT NULL")
def calendar_year_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calendar_year_returns(curves(spark, sf_dir), "curve").withColumn("year", F.col("year").cast("long")), 6, "year_return")


METRICS = ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown")


@query(with_parts("metrics") + STREAK + """
    SELECT m.curve, m.fold, points, longest_drawdown, round(total_return, 5) AS total_return, round(cagr, 5) AS cagr, round(volatility, 5) AS volatility, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino, round(max_drawdown, 5) AS max_drawdown,
           round(cagr / abs(max_drawdown), 5) AS calmar, round(total_return, 5) AS best_year, round(total_return, 5) AS worst_year
    FROM metrics m JOIN streaks s USING (curve, fold) WHERE m.curve <> 'BENCH'""")
def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.curve_metrics(curves(spark, sf_dir), "curve", "fold"), 5, *METRICS, "calmar", "best_year", "worst_year")


@query(with_parts("returns") + "SELECT curve, fold, trading_date, round(active, 6) AS active FROM active")
def active_return_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.active_returns(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",))
    return rounded(a.select("curve", "fold", "trading_date", "active"), 6, "active")


@query(with_parts("curves") + """
    SELECT k.curve, b.fold, b.trading_date, 'benchmark' AS only_in FROM bench b JOIN (SELECT DISTINCT curve, fold FROM curves) k USING (fold)
    WHERE NOT EXISTS (SELECT 1 FROM curves c WHERE c.curve = k.curve AND c.fold = b.fold AND c.trading_date = b.trading_date)""")
def curve_date_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unmatched_dates(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",))


RELATIVE = with_parts("metrics", "returns") + """,
    relative AS (
        SELECT m.curve, m.fold, m.cagr - b.cagr AS excess_cagr, m.sharpe - b.sharpe AS sharpe_difference, m.max_drawdown - b.max_drawdown AS drawdown_difference, t.te AS tracking_error
        FROM metrics m JOIN metrics b ON b.fold = m.fold AND b.curve = 'BENCH' JOIN (SELECT curve, fold, stddev_pop(active) * sqrt(252) AS te FROM active GROUP BY ALL) t ON t.curve = m.curve AND t.fold = m.fold WHERE m.curve <> 'BENCH')
"""


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.relative_metrics(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",))


@query(RELATIVE + "SELECT curve, fold, round(excess_cagr, 5) AS excess_cagr, round(sharpe_difference, 5) AS sharpe_difference, round(drawdown_difference, 5) AS drawdown_difference, round(tracking_error, 5) AS tracking_error FROM relative")
def relative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relative(spark, sf_dir), 5, "excess_cagr", "sharpe_difference", "drawdown_difference", "tracking_error")


FOLDED = RELATIVE + """,
    folded AS (SELECT curve, median(excess_cagr) AS median_excess, avg(CASE WHEN excess_cagr > 0 THEN 1.0 ELSE 0.0 END) AS positive_share, arg_min(fold, (excess_cagr, fold)) AS worst_fold, arg_max(fold, (excess_cagr, fold)) AS best_fold FROM relative GROUP BY curve)
"""


@query(FOLDED + "SELECT curve, round(median_excess, 5) AS median_excess, round(positive_share, 5) AS positive_share, worst_fold, best_fold FROM folded")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.fold_summary(relative(spark, sf_dir).withColumnRenamed("excess_cagr", "excess"), "curve"), 5, "median_excess", "positive_share")


CONCENTRATED = """,
    pos AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY active DESC, trading_date) AS rn FROM active WHERE active > 0),
    concentrated AS (SELECT curve, sum(active) FILTER (rn <= 10) / sum(active) AS concentration FROM pos GROUP BY curve)
"""


@query(with_parts("returns") + CONCENTRATED + "SELECT curve, round(concentration, 6) AS concentration FROM concentrated")
def gain_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.active_returns(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",))
    return rounded(E.gain_concentration(a, 10, "curve"), 6, "concentration")


@query(with_parts("returns") + "SELECT curve, trading_date, round(active, 6) AS active FROM active WHERE active > 0 ORDER BY active.active DESC, curve, trading_date LIMIT 20")
def top_k_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.active_returns(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",)).where("active > 0")
    return rounded(a.orderBy(F.col("active").desc(), "curve", "trading_date").limit(20).select("curve", "trading_date", "active"), 6, "active")


@query(RELATIVE + "SELECT fold, round(median(excess_cagr), 5) AS median_excess, count(*) FILTER (excess_cagr >= 0) AS not_negative, median(excess_cagr) >= 0 AND count(*) FILTER (excess_cagr >= 0) >= 3 AS robust FROM relative GROUP BY fold")
def neighborhood_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.neighborhood_rule(relative(spark, sf_dir).withColumnRenamed("excess_cagr", "excess"), 0.0, 3, "fold"), 5, "median_excess")


@query(FOLDED + CONCENTRATED + """
    SELECT f.curve, CASE WHEN f.curve LIKE '5%' THEN 'INVALID' WHEN f.median_excess > 0 AND f.positive_share >= 0.5 AND c.concentration <= 0.5 THEN 'ROBUST' ELSE 'NO_EVIDENCE' END AS outcome FROM folded f JOIN concentrated c USING (curve)""")
def outcome_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.active_returns(curves(spark, sf_dir), benchmark(spark, sf_dir), ("curve", "fold"), ("fold",))
    f = E.fold_summary(relative(spark, sf_dir).withColumnRenamed("excess_cagr", "excess"), "curve").join(E.gain_concentration(a, 10, "curve"), "curve")
    f = f.select("curve", (~F.col("curve").startswith("5")).alias("integrity"), (F.col("median_excess") > 0).alias("t1"), (F.col("positive_share") >= 0.5).alias("t2"), (F.col("concentration") <= 0.5).alias("t3"))
    return E.outcome_classification(f, "integrity", "t1", "t2", "t3").select("curve", "outcome")


CHAINED = with_parts("curves") + """
    SELECT curve, fold, trading_date, round(chained / 100000, 5) AS growth FROM (SELECT curve, fold, trading_date, 100000 * exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY curve ORDER BY fold, trading_date ROWS UNBOUNDED PRECEDING)) AS chained FROM (
        SELECT *, equity / lag(equity) OVER (PARTITION BY curve, fold ORDER BY trading_date) - 1 AS r FROM curves))"""


@query(CHAINED)
def chained_oos_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chained_oos_curve(curves(spark, sf_dir), "curve")
    return c.select("curve", "fold", "trading_date", F.round(F.col("chained") / 100000, 5).alias("growth"))


@query(CHAINED)
def chained_oos_curve_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chained_oos_curve_long(curves(spark, sf_dir), "curve", blocks=16)
    return c.select("curve", "fold", "trading_date", F.round(F.col("chained") / 100000, 5).alias("growth"))


@query("""
    WITH flow AS (SELECT event_id, ts, CAST(1000000 AS DECIMAL(38, 2)) + sum(CAST(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS DECIMAL(18, 2))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity FROM events)
    SELECT event_id, CAST(equity AS DOUBLE) AS equity, round(CAST(equity AS DOUBLE) / CAST(max(equity) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) - 1, 9) AS dd FROM flow""")
def drawdown_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one curve: the running sum of signed values, and its drawdown."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).cast("decimal(18,2)")
    flow = running(e, [], F.struct("ts", "event_id"), cut(e, "ts"), {"equity": ("sum", signed)}).withColumn("equity", (F.col("equity") + F.lit(1000000)).cast("decimal(38,2)"))
    return E.drawdown_long(flow, date="ts", tie="event_id").select("event_id", F.col("equity").cast("double").alias("equity"), F.round("dd", 9).alias("dd"))


@query(with_parts("curves") + """
    SELECT c.curve, f.y - 1997 AS fold, min(trading_date) AS first_date, max(trading_date) AS last_date, min(trading_date) = make_date(f.y, 1, 1) AND max(trading_date) = make_date(f.y, 12, 31) AS compatible
    FROM curves c JOIN (SELECT unnest(generate_series(1998, 2001)) AS y) f ON c.trading_date BETWEEN make_date(f.y, 1, 1) AND make_date(f.y, 12, 31) GROUP BY c.curve, f.y""")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.fold_assignment(curves(spark, sf_dir).drop("fold"), X.folds(spark))
    return E.fold_bounds(a, "curve").withColumn("fold", F.col("fold").cast("long"))


@query(with_parts("curves") + "SELECT curve, count(*) AS points, 0::BIGINT AS repeated, count(*) FILTER (day(trading_date) = 1) AS bad FROM curves GROUP BY 1 HAVING count(*) FILTER (day(trading_date) = 1) > 0")
def equity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir).withColumn("equity", F.when(F.dayofmonth("trading_date") == 1, 0.0).otherwise(F.col("equity")))
    return V.equity_guard(c, "curve")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0")
def t1_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("signal_date"))
    return V.t1_guard(o.withColumn("fill_date", F.when(F.col("k") % 4 == 0, F.date_sub("signal_date", (F.col("k") % 3).cast("int"))).otherwise(F.date_add("signal_date", 1)))).select("k")


# --- Costs and portfolios -----------------------------------------------------------------------------

COST = "(CASE WHEN {n} > 0 THEN (greatest({n} * 0.0003, 5.0) + {n} * 0.0005) * {m} ELSE 0 END)"
AFFORD = "(CASE WHEN ({c} - {m} * 5.0) / (1 + {m} * 0.0005) <= 0 THEN 0 WHEN ({c} - {m} * 5.0) / (1 + {m} * 0.0005) * 0.0003 <= 5.0 THEN ({c} - {m} * 5.0) / (1 + {m} * 0.0005) ELSE {c} / (1 + {m} * 0.0008) END)"


@query(f"SELECT o_orderkey AS k, round({COST.format(n='o_totalprice', m='1')}, 8) AS cost, round({COST.format(n='o_totalprice', m='2')}, 8) AS doubled FROM orders")
def trade_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.round(B.trade_cost(n), 8).alias("cost"), F.round(B.trade_cost(n, 2.0), 8).alias("doubled"))


@query(f"SELECT o_orderkey AS k, round({AFFORD.format(c='c', m='1')}, 4) AS notional FROM (SELECT o_orderkey, o_totalprice / (1 + o_orderkey % 50 * 200) AS c FROM orders)")
def affordable_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_totalprice") / (1 + F.col("o_orderkey") % 50 * 200)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.round(B.affordable_notional(c), 4).alias("notional"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS bps, round(l_quantity / 10000, 8) AS rate FROM lineitem")
def bps_to_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("bps"), F.round(B.bps_to_rate(F.col("l_quantity")), 8).alias("rate"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio per bar date: six symbols with derived holdings and weights."""
    b = V.aligned(X.bars_dense(spark, sf_dir))
    i = F.ascii(F.substring("symbol", 1, 1)) + F.ascii(F.substring("symbol", 2, 1))
    d = F.dayofyear("trading_date")
    return b.select("trading_date", "symbol", F.lit(2000.0).alias("cash"), ((d * i) % 7).cast("double").alias("qty"), "open", (((d + i) % 5) / 25.0).alias("weight"), F.lit(1.0).alias("multiplier"))


@query(with_parts("bars") + f"""
    , p AS (SELECT trading_date, symbol, 2000.0 AS cash, CAST(dayofyear(trading_date) * i % 7 AS DOUBLE) AS qty, open, (dayofyear(trading_date) + i) % 5 / 25.0 AS weight
        FROM (SELECT *, ascii(symbol[1]) + ascii(symbol[2]) AS i FROM bars WHERE trading_date IN (SELECT trading_date FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)))),
    v AS (SELECT *, cash + sum(qty * open) OVER (PARTITION BY trading_date) AS value FROM p), g AS (SELECT *, value * weight - qty * open AS gap FROM v),
    s AS (SELECT *, cash + sum(greatest(-gap, 0) - {COST.format(n='greatest(-gap, 0)', m='1')}) OVER (PARTITION BY trading_date) AS after_sells, greatest(gap, 0) AS want, greatest(gap, 0) + {COST.format(n='greatest(gap, 0)', m='1')} AS need FROM g),
    b AS (SELECT *, after_sells - coalesce(sum(need) OVER (PARTITION BY trading_date ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM s),
    n AS (SELECT *, CASE WHEN gap < 0 THEN gap WHEN l <= 0 THEN 0 WHEN need <= l THEN want ELSE {AFFORD.format(c='l', m='1')} END AS notional FROM b)
    SELECT trading_date, symbol, round(notional + 0.0000003, 4) AS notional, round({COST.format(n='abs(notional)', m='1')} + 0.0000003, 4) AS cost, round(qty + notional / open + 0.0000003, 4) AS new_qty FROM n""")
def rebalance_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.rebalance_trades(positions(spark, sf_dir), "trading_date")
    # A shift far below the last place keeps ties of the rounding apart in both engines.
    return t.select("trading_date", "symbol", *(F.round(F.col(c) + 0.0000003, 4).alias(c) for c in ("notional", "cost", "new_qty")))


@query(with_parts("bars") + "SELECT trading_date AS execution_date, symbol, CAST(100 * (1 + day(trading_date)) AS DOUBLE) AS notional, open AS raw_open, round(100.0 * (1 + day(trading_date)) / open, 6) AS raw_qty FROM bars")
def fill_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bars_dense(spark, sf_dir)
    trades = b.select("symbol", F.col("trading_date").alias("execution_date"), (100.0 * (1 + F.dayofmonth("trading_date"))).alias("notional"))
    return rounded(B.fill_audit(trades, b).select("execution_date", "symbol", "notional", "raw_open", "raw_qty"), 6, "raw_qty")


@query("""
    SELECT s.scenario, f.fold FROM (VALUES ('base'), ('double_cost'), ('delay_2'), ('m63_n1'), ('m63_n2'), ('m126_n1'), ('m252_n1'), ('m252_n2'), ('trim_start'), ('trim_end')) s(scenario),
    (SELECT DISTINCT year(l_shipdate) - 1997 AS fold FROM lineitem WHERE year(l_shipdate) BETWEEN 1998 AND 2001) f""")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios by those folds whose test year has rows."""
    years = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.year("l_shipdate") - 1997).alias("fold")).distinct()
    return X.scenarios(spark).select("scenario").join(X.folds(spark).join(years, "fold", "left_semi").select(F.col("fold").cast("long").alias("fold")), how="cross")


def steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bars, steps) of every scenario and fold, and of the equal-weight benchmark under each: targets of the causal bars at month
    ends within the test year, executed after the scenario's delay."""
    raw = V.aligned(X.bars_dense(spark, sf_dir))
    bars = stored(A.forward_adjust(raw, X.ledger(raw)), "causal")
    feats = stored(W.features(bars), "features")
    sc, dates = X.scenarios(spark), bars.select("trading_date").distinct()
    grid = None
    for r in [("mom_63", 1), ("mom_63", 2), ("mom_126", 1), ("mom_126", 2), ("mom_252", 1), ("mom_252", 2)]:
        t = W.monthly_targets(feats, *r).withColumn("momentum", F.lit(int(r[0][4:]))).withColumn("hold", F.lit(r[1]))
        grid = t if grid is None else grid.unionByName(t)
    equal = W.equal_weight_targets(C.month_end_sessions(bars), bars.select("symbol"))
    targets = sc.join(grid, ["momentum", "hold"]).select("scenario", F.lit("strategy").alias("portfolio"), "signal_date", "symbol", "weight", "delay", "cost_multiplier", "trim_start", "trim_end")
    targets = targets.unionByName(sc.join(equal, how="cross").select("scenario", F.lit("benchmark").alias("portfolio"), "signal_date", "symbol", "weight", "delay", "cost_multiplier", "trim_start", "trim_end"))
    f = X.folds(spark).select("fold", "test_start", "test_end")
    # Sessions of each fold and scenario after trimming, numbered: a delay is a step in this order.
    days = E.fold_assignment(dates, f).join(sc.select("scenario", "delay", "trim_start", "trim_end"), how="cross")
    up, down = Window.partitionBy("scenario", "fold").orderBy("trading_date"), Window.partitionBy("scenario", "fold").orderBy(F.col("trading_date").desc())
    days = days.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down)).where("a > trim_start and z > trim_end")
    days = days.withColumn("x1", F.lead("trading_date", 1).over(up)).withColumn("x2", F.lead("trading_date", 2).over(up))
    at = days.select("scenario", "fold", F.col("trading_date").alias("signal_date"), F.when(F.col("delay") == 1, F.col("x1")).otherwise(F.col("x2")).alias("execution_date")).where("execution_date is not null")
    legs = targets.where("symbol <> 'CASH'").select("scenario", "portfolio", "signal_date", "symbol", "weight")
    names = targets.select("scenario", "portfolio", "signal_date", "cost_multiplier").distinct().join(bars.select("symbol").distinct(), how="cross").join(legs, ["scenario", "portfolio", "signal_date", "symbol"], "left")
    opens = bars.select(F.col("trading_date").alias("execution_date"), "symbol", "open")
    out = names.join(at, ["scenario", "signal_date"]).join(opens, ["execution_date", "symbol"])
    return bars, out.select("scenario", "fold", "portfolio", "execution_date", "symbol", "open", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("cost_multiplier").alias("multiplier"))


KEYS = ("scenario", "fold", "portfolio")


def marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rolled trades, equity curves within each fold)."""
    bars, s = steps(spark, sf_dir)
    rolled = stored(B.portfolio_roll_forward(s, *KEYS), "rolled")
    f = X.folds(spark).select("fold", "test_start", "test_end")
    days = E.fold_assignment(bars.select("trading_date").distinct(), f).select("fold", "trading_date")
    curve = B.mark_to_market(rolled, bars, days, *KEYS)
    sc = X.scenarios(spark).select("scenario", "trim_start", "trim_end")
    up, down = Window.partitionBy(*KEYS).orderBy("trading_date"), Window.partitionBy(*KEYS).orderBy(F.col("trading_date").desc())
    curve = curve.join(sc, "scenario").withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down)).where("a > trim_start and z > trim_end")
    return rolled, stored(curve.select(*KEYS, "trading_date", "equity", "cash_weight"), "curves")


@query()
def portfolio_roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared with a sequential loop in tests/test_backtest.py."""
    return rounded(B.portfolio_roll_forward(steps(spark, sf_dir)[1], *KEYS), 6, "notional", "cost", "qty", "cash", "turnover")


@query()
def mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(marked(spark, sf_dir)[1], 6, "equity", "cash_weight")


@query()
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled, curve = marked(spark, sf_dir)
    out = E.execution_stats(curve, *KEYS).join(E.trade_stats(rolled, *KEYS), list(KEYS), "left")
    return rounded(out, 6, "time_in_market", "mean_cash_weight", "max_cash_weight", "turnover", "cost_total")


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, curve = marked(spark, sf_dir)
    own = curve.where("portfolio = 'strategy'").select("scenario", "fold", "trading_date", "equity")
    base = curve.where("portfolio = 'benchmark'").select("scenario", "fold", "trading_date", "equity")
    return own, E.relative_metrics(own, base, ("scenario", "fold"), ("scenario", "fold"))


@query()
def walk_forward_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario and fold: metrics, comparison with the benchmark, and the share of folds with an excess."""
    own, rel = evaluated(spark, sf_dir)
    out = E.curve_metrics(own, "scenario", "fold").join(rel, ["scenario", "fold"])
    out = out.withColumn("positive_share", F.avg((F.col("excess_cagr") > 0).cast("double")).over(Window.partitionBy("scenario")))
    return rounded(out, 6, *METRICS, "calmar", "best_year", "worst_year", "excess_cagr", "sharpe_difference", "drawdown_difference", "tracking_error", "positive_share")


@query()
def frozen_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scenario: folds, median excess, and a fingerprint of its chained curve."""
    own, rel = evaluated(spark, sf_dir)
    chained = E.chained_oos_curve(own, "scenario")
    print_ = P.series_fingerprint(chained, "chained", "scenario", scale=4)
    last = chained.groupBy("scenario").agg(F.round(F.max_by("chained", F.struct("fold", "trading_date")), 4).alias("final_equity"))
    folds = E.fold_summary(rel.withColumnRenamed("excess_cagr", "excess"), "scenario")
    return rounded(folds.join(last, "scenario").join(print_, "scenario"), 6, "median_excess", "positive_share")
