"""SQL of the tables that the comparison queries share, as common table expressions."""

from __future__ import annotations


def _bars(name: str, symbol: str, source: str) -> str:
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    return f"""
    {name}_px AS (
        SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS trading_date, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS px, {order}
        FROM {source} WHERE isodow(l_shipdate) < 6),
    {name} AS (
        SELECT symbol, CASE WHEN symbol < 'M' THEN 'SSE' ELSE 'SZSE' END AS exchange, 'raw' AS price_basis, trading_date,
               first(px ORDER BY {order}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {order}) AS close, sum(l_quantity) AS volume
        FROM {name}_px GROUP BY ALL)"""


def _walk(events: str, fits: str, name: str) -> str:
    """``name``: the events of each symbol visited in order, each taking the one unused candidate that fits it, if there is exactly one."""
    return f""",
    {name}_in_order AS (
        SELECT symbol, event_id, k, coalesce(list(candidate_id) FILTER (candidate_id IS NOT NULL), []) AS own
        FROM (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY effective_date, event_id) AS k FROM {events}) LEFT JOIN (SELECT DISTINCT symbol, event_id, candidate_id FROM {fits}) USING (symbol, event_id)
        GROUP BY symbol, event_id, k),
    {name}_walk AS (
        SELECT DISTINCT symbol, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS event_id, NULL::VARCHAR AS candidate_id FROM {events}
        UNION ALL
        SELECT w.symbol, e.k, CASE WHEN len(list_filter(e.own, lambda c: NOT list_contains(w.used, c))) = 1 THEN list_concat(w.used, list_filter(e.own, lambda c: NOT list_contains(w.used, c))) ELSE w.used END, e.event_id,
               CASE WHEN len(list_filter(e.own, lambda c: NOT list_contains(w.used, c))) = 1 THEN list_filter(e.own, lambda c: NOT list_contains(w.used, c))[1] END
        FROM {name}_walk w JOIN {name}_in_order e ON e.symbol = w.symbol AND e.k = w.k + 1),
    {name} AS (
        SELECT DISTINCT w.symbol, w.event_id, w.candidate_id, f.candidate_date FROM {name}_walk w JOIN {fits} f USING (symbol, event_id, candidate_id) WHERE w.candidate_id IS NOT NULL)"""


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "bars": (_bars("bars", "p_type", "lineitem JOIN part ON l_partkey = p_partkey"), ()),
    "wide": (_bars("wide", "CAST(l_suppkey AS VARCHAR)", "lineitem"), ()),
    "closures": ("""
    closures AS (
        SELECT CAST(d AS DATE) AS session_date FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)
        WHERE isodow(d) < 6 AND day(d) = 1 AND month(d) IN (1, 5, 10))""", ()),
    "sessions": ("""
    sessions AS (
        SELECT e.exchange, CAST(d AS DATE) AS session_date, row_number() OVER (PARTITION BY e.exchange ORDER BY d) AS ordinal
        FROM (SELECT DISTINCT exchange FROM bars) e, generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)
        WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT session_date FROM closures))""", ("bars", "closures")),
    "universe": ("""
    universe AS (
        SELECT exchange, symbol, min(trading_date) AS effective_from,
               CASE WHEN row_number() OVER (ORDER BY symbol DESC) = 1 THEN DATE '2000-12-29' END AS effective_to
        FROM bars GROUP BY exchange, symbol)""", ("bars",)),
    "expected": ("""
    expected AS (
        SELECT u.exchange, u.symbol, s.session_date, s.ordinal FROM universe u JOIN sessions s USING (exchange)
        WHERE s.session_date >= u.effective_from AND s.session_date <= coalesce(u.effective_to, DATE '9999-12-31'))""", ("sessions", "universe")),
    "absent": ("""
    absent AS (
        SELECT e.* FROM expected e ANTI JOIN bars b ON b.symbol = e.symbol AND b.exchange = e.exchange AND b.trading_date = e.session_date)""", ("expected",)),
    "documented": ("""
    documented AS (
        SELECT exchange, symbol, session_date, 'suspended' AS reason FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) AS k FROM absent) WHERE k % 5 = 0
        UNION ALL SELECT exchange, symbol, CAST(max(trading_date) AS DATE), 'suspended' FROM bars GROUP BY exchange, symbol
        UNION ALL SELECT DISTINCT exchange, symbol, DATE '1998-01-03', 'suspended' FROM bars)""", ("absent",)),
    "missing": ("""
    missing AS (
        SELECT a.exchange, a.symbol, a.session_date AS missing_date, 'expected_session_missing' AS kind FROM absent a
        ANTI JOIN documented d ON d.symbol = a.symbol AND d.exchange = a.exchange AND d.session_date = a.session_date
        WHERE a.session_date BETWEEN DATE '1995-01-01' AND DATE '2001-06-29'
        UNION ALL SELECT exchange, symbol, DATE '1995-01-01', 'pre_effective_range' FROM universe WHERE effective_from > DATE '1995-01-01'
        UNION ALL SELECT exchange, symbol, DATE '2001-07-02', 'incomplete_current_session' FROM universe)""", ("documented",)),
    "bars_b": ("""
    bars_b AS (
        SELECT symbol, exchange, price_basis, trading_date, open, greatest(high, c) AS high, low, c AS close, floor(volume * 0.01 + 0.5) AS volume FROM (
            SELECT *, CASE WHEN dayofyear(trading_date) % 97 = 0 THEN floor((close + 0.01) * 10000 + 0.5) / 10000 ELSE close END AS c
            FROM bars WHERE dayofyear(trading_date) % 53 <> 0))""", ("bars",)),
    "bars_c": ("""
    bars_c AS (
        SELECT symbol, exchange, price_basis, trading_date, open, high, low, close FROM bars WHERE dayofyear(trading_date) <> 291
        UNION ALL SELECT symbol, exchange, price_basis, trading_date, open, high, low, close FROM bars_b WHERE dayofyear(trading_date) = 291)""", ("bars_b",)),
    "ledger": ("""
    ledger AS (
        SELECT symbol || '_v1' AS ledger_id, symbol, exchange, symbol || '-' || k AS event_id, trading_date AS effective_date,
               CASE WHEN k % 2 = 1 THEN 'split' ELSE 'cash' END AS kind, CASE WHEN k % 2 = 0 THEN floor(prev * 100 + 0.5) / 10000 END AS cash_per_unit,
               CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE END AS split_ratio, trading_date - 1 AS record_date, trading_date + 5 AS payment_date,
               trading_date - 20 AS announced_on, CASE WHEN k % 5 = 0 THEN 'candidate' ELSE 'verified' END AS status, k
        FROM (SELECT *, rn // 250 AS k FROM (
            SELECT symbol, exchange, trading_date, row_number() OVER w AS rn, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trading_date))
            WHERE rn % 250 = 0))""", ("bars",)),
    "applied": ("""
    applied AS (
        SELECT l.*, (SELECT min(b.trading_date) FROM bars b WHERE b.symbol = l.symbol AND b.trading_date >= l.effective_date) AS application_date FROM ledger l)""", ("ledger",)),
    "candidates": ("""
    candidates AS (
        SELECT l.symbol, 'c-' || event_id AS candidate_id,
               CASE WHEN k % 3 = 0 THEN coalesce((SELECT min(b.trading_date) FROM bars b WHERE b.symbol = l.symbol AND b.trading_date > l.effective_date), effective_date) ELSE effective_date END AS candidate_date,
               kind, coalesce(split_ratio, cash_per_unit) AS value
        FROM ledger l WHERE k % 4 <> 0
        UNION ALL SELECT symbol, 'c-' || symbol || '-extra', max(trading_date) - 3, 'split', 3.0 FROM bars GROUP BY symbol)""", ("ledger",)),
    "matches": ("""
    fits AS (
        SELECT a.symbol, a.event_id, a.effective_date, c.candidate_id, c.candidate_date FROM applied a JOIN candidates c
        ON c.symbol = a.symbol AND c.kind = a.kind AND c.value = coalesce(a.split_ratio, a.cash_per_unit)
        AND (c.candidate_date = a.application_date OR c.candidate_date = (SELECT min(b.trading_date) FROM bars b WHERE b.symbol = a.symbol AND b.trading_date > a.application_date)))""" + _walk("applied", "fits", "matches"), ("applied", "candidates")),
    "crowded": ("""
    crowded AS (
        SELECT *, rn % 20 AS place, rn // 20 AS block, CASE WHEN rn // 20 % 5 = 4 THEN 'cash' ELSE 'split' END AS kind
        FROM (SELECT exchange, symbol, trading_date, row_number() OVER (PARTITION BY exchange, symbol ORDER BY trading_date) AS rn FROM bars)),
    crowded_events AS (SELECT symbol, symbol || '-' || rn AS event_id, trading_date AS effective_date, rn, kind FROM crowded WHERE place BETWEEN 5 AND 7),
    crowded_candidates AS (
        SELECT symbol, 'c-' || symbol || '-' || rn || '-' || copy AS candidate_id, trading_date AS candidate_date, rn, kind
        FROM crowded, (VALUES ('a'), ('b')) v(copy)
        WHERE place BETWEEN 5 AND 8 AND ((block % 16) >> (place - 5)) & 1 = 1 AND (copy = 'a' OR block % 7 = 3 AND place = 6)),
    crowded_fits AS (
        SELECT e.symbol, e.event_id, c.candidate_id, c.candidate_date FROM crowded_events e JOIN crowded_candidates c ON c.symbol = e.symbol AND c.kind = e.kind AND c.rn IN (e.rn, e.rn + 1))""" + _walk("crowded_events", "crowded_fits", "crowded_matches"), ("bars",)),
    "inventory": ("""
    inventory AS (
        SELECT l.symbol, l.event_id, m.candidate_id, l.effective_date AS event_date, l.kind, m.candidate_id IS NOT NULL AS provider_confirmed, l.status = 'verified' AS verified,
               CASE WHEN l.kind = 'split' THEN 'SPLIT' ELSE 'DIVIDEND' END AS classification
        FROM ledger l LEFT JOIN matches m USING (event_id)
        UNION ALL SELECT c.symbol, NULL, c.candidate_id, c.candidate_date, c.kind, true, false, 'UNEXPLAINED' FROM candidates c ANTI JOIN matches m USING (candidate_id))""", ("matches",)),
    "factors": ("""
    fa AS (
        SELECT b.*, CASE WHEN a.split_ratio IS NOT NULL THEN a.split_ratio WHEN a.cash_per_unit IS NOT NULL THEN prev / (prev - a.cash_per_unit) ELSE 1.0 END AS up,
               CASE WHEN a.split_ratio IS NOT NULL THEN 1 / a.split_ratio WHEN a.cash_per_unit IS NOT NULL THEN (prev - a.cash_per_unit) / prev ELSE 1.0 END AS down
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS prev FROM bars) b
        LEFT JOIN applied a ON a.symbol = b.symbol AND a.application_date = b.trading_date),
    factors AS (
        SELECT *, exp(sum(ln(up)) OVER (w ROWS UNBOUNDED PRECEDING)) AS forward,
               coalesce(exp(sum(ln(down)) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1.0) AS backward
        FROM fa WINDOW w AS (PARTITION BY symbol ORDER BY trading_date))""", ("applied",)),
    "features": ("""
    rets AS (SELECT *, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY exchange, symbol, price_basis ORDER BY trading_date)),
    features AS (
        SELECT *, CASE WHEN rn >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS ma, close / lag(close, 63) OVER w - 1 AS mom_63,
               close / lag(close, 126) OVER w - 1 AS mom_126, close / lag(close, 252) OVER w - 1 AS mom_252,
               CASE WHEN rn > 60 THEN stddev_pop(r) OVER (w ROWS 59 PRECEDING) END AS vol
        FROM rets WINDOW w AS (PARTITION BY exchange, symbol, price_basis ORDER BY trading_date))""", ("bars",)),
    "targets": ("""
    ends AS (SELECT max(trading_date) AS signal_date FROM bars GROUP BY date_trunc('month', trading_date)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY mom_126 DESC, symbol) AS rank FROM features
        WHERE trading_date IN (SELECT signal_date FROM ends) AND ma IS NOT NULL AND mom_126 IS NOT NULL AND vol > 0 AND close >= ma),
    own AS (
        SELECT trading_date AS signal_date, symbol, least(0.9 * (1 / vol) / sum(1 / vol) OVER (PARTITION BY trading_date), 0.5) AS weight FROM ranked WHERE rank <= 2),
    targets AS (
        SELECT * FROM own UNION ALL
        SELECT e.signal_date, 'CASH', 1 - coalesce((SELECT sum(weight) FROM own o WHERE o.signal_date = e.signal_date), 0) FROM ends e)""", ("features",)),
    "curves": ("""
    curves AS (
        SELECT o_orderpriority AS curve, year(o_orderdate) AS fold, CAST(o_orderdate AS DATE) AS trading_date, floor(sum(o_totalprice) / 1000 + 0.5) + 1000 AS equity
        FROM orders GROUP BY ALL),
    bench AS (
        SELECT year(o_orderdate) AS fold, CAST(o_orderdate AS DATE) AS trading_date, floor(sum(o_totalprice) / 1000 + 0.5) + 1000 AS equity FROM orders GROUP BY ALL)""", ()),
    "returns": ("""
    returns AS (SELECT * FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY curve, fold ORDER BY trading_date) - 1 AS ret FROM curves) WHERE ret IS NOT NULL),
    breturns AS (SELECT * FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY fold ORDER BY trading_date) - 1 AS ret FROM bench) WHERE ret IS NOT NULL),
    active AS (SELECT r.curve, r.fold, r.trading_date, r.ret - b.ret AS active FROM returns r JOIN breturns b USING (fold, trading_date))""", ("curves",)),
    "metrics": ("""
    allcurves AS (SELECT curve, fold, trading_date, equity FROM curves UNION ALL SELECT 'BENCH', fold, trading_date, equity FROM bench),
    allret AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM allcurves WINDOW w AS (PARTITION BY curve, fold ORDER BY trading_date)),
    metrics AS (
        SELECT curve, fold, count(*) AS points, last(equity ORDER BY trading_date) / first(equity ORDER BY trading_date) - 1 AS total_return,
               pow(last(equity ORDER BY trading_date) / first(equity ORDER BY trading_date), 252.0 / (count(*) - 1)) - 1 AS cagr,
               stddev_pop(ret) * sqrt(252) AS volatility, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe,
               avg(ret) / stddev_pop(ret) FILTER (ret < 0) * sqrt(252) AS sortino, min(dd) AS max_drawdown
        FROM allret GROUP BY curve, fold)""", ("curves",)),
}


def with_parts(*names: str, wide: bool = False) -> str:
    """``WITH`` clause of the named tables and what they build on; ``wide``: on the bars with a series per supplier."""
    parts = dict(PARTS, bars=(_bars("bars", "CAST(l_suppkey AS VARCHAR)", "lineitem"), ())) if wide else PARTS
    done: list[str] = []

    def add(name: str) -> None:
        for need in parts[name][1]:
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",".join(parts[n][0] for n in done) + "\n"
