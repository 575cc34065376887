import datetime as dt

import pytest
from helpers import bars, day
from pyspark.sql import functions as F

from barloom.functions import scalar
from barloom.operators import calendar, inventory, reconcile, validate
from barloom.sources import publish, scans
from barloom.streaming import validators


def session_table(spark, days, exchange="TEST"):
    return spark.createDataFrame([(exchange, d, i + 1) for i, d in enumerate(days)], "exchange string, session_date date, ordinal int")


def test_gap_is_found_and_documented(spark):
    b = bars(spark, [1, 2, 3, 4]).where(F.col("trading_date") != F.lit(day(2)))
    s = session_table(spark, [day(i) for i in range(4)])
    u = spark.createDataFrame([("TEST", "A", day(0), None)], "exchange string, symbol string, effective_from date, effective_to date")
    none = spark.createDataFrame([], "exchange string, symbol string, session_date date, reason string")
    doc = spark.createDataFrame([("TEST", "A", day(2), "halt")], none.schema)
    args = (str(day(0)), str(day(3)), str(day(3)))
    assert [(r["missing_date"], r["kind"]) for r in calendar.coverage_missing(b, s, u, none, *args).collect()] == [(day(2), "expected_session_missing")]
    assert calendar.coverage_missing(b, s, u, doc, *args).count() == 0
    assert calendar.documented_absence(b, s, u, doc).count() == 1
    assert calendar.documented_conflict(bars(spark, [1, 2, 3]), s, doc).first()["conflict"] == "has_bar"


def test_rules(spark):
    b = bars(spark, [1, 2]).withColumn("low", F.when(F.col("close") == 2, 3.0).otherwise(F.col("low")))
    assert [r["reason"] for r in validate.ohlc_validity(b).collect()] == ["low_above_body"]
    assert validate.duplicate_bars(b.unionByName(b.where("close = 1"))).count() == 1


def test_lots_and_adjudication(spark):
    a = bars(spark, [10, 11])
    b = a.withColumn("volume", F.lit(1.0)).withColumn("close", F.when(F.col("close") == 11, 11.5).otherwise(F.col("close"))).withColumn("high", F.greatest("high", "close"))
    events = spark.createDataFrame([], "symbol string, application_date date")
    o = reconcile.reconcile_overlap(a, b, events)
    assert o.where("volume_match").count() == 2 and o.where("price_match").count() == 1
    assert reconcile.adjudicate(o, a).first()["verdict"] == "adjudicated"
    assert reconcile.adjudicate(o, b).first()["verdict"] == "source_rejected"
    assert reconcile.adjudicate(o, a.where("close = 10")).first()["verdict"] == "unexplained"
    r = reconcile.reconciliation_report(o, reconcile.adjudicate(o, a)).first()
    assert (r["overlap"], r["mismatched"], r["adjudicated"], r["status"]) == (2, 1, 1, "pass")


def test_candidate_matches_once(spark):
    b = bars(spark, [1] * 6)
    e = spark.createDataFrame([("A", "e1", day(1), day(1), "split", "2.0"), ("A", "e2", day(3), day(3), "cash", "0.10")], "symbol string, event_id string, effective_date date, application_date date, kind string, official_value string")
    c = spark.createDataFrame([("A", "c1", day(2), "split", 2.04), ("A", "c2", day(3), "cash", 0.2)], "symbol string, candidate_id string, candidate_date date, kind string, value double")
    assert [(r["event_id"], r["candidate_id"]) for r in inventory.candidate_event_match(e, c, b).collect()] == [("e1", "c1")]


def test_session_neighbors_and_schedule(spark):
    s = session_table(spark, [day(0), day(1), day(4)])
    q = spark.createDataFrame([("TEST", day(2)), ("TEST", day(0))], "exchange string, day date")
    got = {r["day"]: (r["previous_session"], r["next_session"]) for r in calendar.session_neighbors(q, s).collect()}
    assert got == {day(2): (day(1), day(4)), day(0): (None, day(1))}
    sig = spark.createDataFrame([("TEST", day(1)), ("TEST", day(4)), ("TEST", day(2))], "exchange string, signal_date date")
    assert {r["signal_date"]: r["status"] for r in calendar.execution_schedule(sig, s).collect()} == {day(1): "scheduled", day(4): "rejected", day(2): "unknown_signal"}


def test_latest_completed(spark):
    s = session_table(spark, [day(0), day(1), day(365)])
    t = spark.createDataFrame([(dt.datetime(2024, 1, 2, 7, 59),), (dt.datetime(2024, 1, 2, 8, 0),), (dt.datetime(2025, 6, 1, 0, 0),)], "now timestamp")
    assert [r["latest"] for r in calendar.latest_completed_session(t, s).orderBy("now").collect()] == [day(0), day(1), day(365)]


def test_parsers(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"code":"0","data":{"code":"159919","picupdata":[["2024-01-02",1,3,0.5,4,0,0,700,9]]}}')
    (tmp_path / "short.json").write_text('{"code":"0","data":{"code":"159919","picupdata":[["2024-01-02",1,3,0.5,4,0,0,700,9],["2024-01-03",1]]}}')
    (tmp_path / "refused.json").write_text('{"code":"7","message":"busy"}')
    for name, reason in (("short", "short_row"), ("refused", "answer_refused")):
        assert [(x["reason"], x["n"]) for x in scans.kline_positional_rejects(spark, str(tmp_path / f"{name}.json")).collect()] == [(reason, 1)]
        with pytest.raises(Exception, match=reason):
            scans.scan_kline_positional(spark, str(tmp_path / f"{name}.json"), "SZSE").collect()
    r = scans.scan_kline_positional(spark, str(tmp_path / "k.json"), "SZSE").collect()
    assert len(r) == 1 and (float(r[0]["open"]), float(r[0]["close"]), float(r[0]["low"]), float(r[0]["high"]), float(r[0]["volume"])) == (1, 3, 0.5, 4, 700)
    (tmp_path / "c.json").write_text('{"code":"510300","total":2,"kline":[[20240102,1,2,1,2,5]]}')
    with pytest.raises(publish.LoadRejected, match="wrong_count"):
        scans.scan_kline_counted(spark, str(tmp_path / "c.json"), "SSE")
    assert scans.kline_counted_rejects(spark, str(tmp_path / "c.json")).first()["found"] == 1
    (tmp_path / "f.js").write_text('var x={"symbol":"A","data":[{"d":"1900-01-01","s":"1","u":"0"},{"d":"2024-01-02","s":"2","u":"0"}]}\n/* cached */')
    assert [(r["split"]) for r in scans.scan_factor_changes(spark, str(tmp_path / "f.js")).collect()] == [2.0]
    (tmp_path / "a.json").write_text('{"symbol":"1","result":[{"SECURITY_CODE":"1","TITLE":"分红公告","URL":"/x","SSEDATE":"2024-01-02"}],"pageHelp":{"total":2}}')
    assert not scans.scan_announcements(spark, str(tmp_path / "a.json")).first()["complete"]


def test_bad_csv_fails(spark, tmp_path):
    head, good = "symbol,exchange,price_basis,trading_date,open,high,low,close,volume\n", "A,T,raw,2024-01-02,1,1,1,1,1\n"
    (tmp_path / "g.csv").write_text(head + good)
    assert scans.scan_bars_csv(spark, str(tmp_path / "g.csv")).count() == 1
    for name, row, reason in (("d", good, "duplicate"), ("n", "A,T,raw,2024-01-03,1,1,-1,1,1\n", "price_not_positive")):
        (tmp_path / f"{name}.csv").write_text(head + good + row)
        with pytest.raises(Exception, match=reason):
            scans.scan_bars_csv(spark, str(tmp_path / f"{name}.csv")).select("trading_date").collect()
    (tmp_path / "b.csv").write_text("symbol,exchange,price_basis,trading_date,open,high,low,close,volume\nA,T,raw,2024-01-02,x,1,1,1,1\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        scans.scan_bars_csv(spark, str(tmp_path / "b.csv")).collect()


def test_no_filter_passes_a_faulty_load_by(spark, tmp_path):
    """Each loader checks all rows before a reader is given any; what is rejected leaves nothing behind."""
    import os

    (tmp_path / "b.csv").write_text("symbol,exchange,price_basis,trading_date,open,high,low,close,volume\nA,T,raw,2024-01-02,1,1,1,1,1\nB,T,raw,2024-01-02,1,1,-4,1,1\n")
    row = lambda *v: "[" + ",".join(map(str, v)) + "]"
    positional = lambda *rows: '{"code":"0","data":{"code":"A","picupdata":[' + ",".join(rows) + "]}}"
    good = row('"2024-01-02"', 1, 1, 1, 1, 0, 0, 5, 9)
    bad = {"unreadable_date": row('"soon"', 1, 1, 1, 1, 0, 0, 5, 9), "missing": row('"2024-01-03"', '"junk"', 1, 1, 1, 0, 0, 5, 9), "price_not_positive": row('"2024-01-03"', 1, 1, -4, 1, 0, 0, 5, 9), "duplicate": good, "short_row": row('"2024-01-03"', 1)}
    for reason, r in bad.items():
        (tmp_path / f"{reason}.json").write_text(positional(good, r))
    (tmp_path / "none.json").write_text(positional())
    (tmp_path / "c.json").write_text('{"code":"A","total":2,"kline":[[20240102,1,1,1,1,5],[20240102,1,1,1,1,5]]}')
    (tmp_path / "d.json").write_text('{"symbol":"A","date":"2024-01-02T00:00","open":"1","high":"1","low":"1","close":"x","volume":"5"}')
    loads = {"b.csv": (scans.scan_bars_csv, (), "price_not_positive B 2024-01-02"), "c.json": (scans.scan_kline_counted, ("SSE",), "duplicate"), "d.json": (scans.scan_decoded_rows, ("SSE",), "missing"), "none.json": (scans.scan_kline_positional, ("SZSE",), "short_row|answer_refused")}
    loads |= {f"{reason}.json": (scans.scan_kline_positional, ("SZSE",), reason) for reason in bad}
    before = sorted(os.listdir(tmp_path))
    for name, (load, args, reason) in loads.items():
        with pytest.raises(publish.LoadRejected, match=reason):
            load(spark, str(tmp_path / name), *args, to=str(tmp_path / "table")).where("symbol = 'A'").limit(1).count()
        assert sorted(os.listdir(tmp_path)) == before
    (tmp_path / "g.json").write_text(positional(good, row('"2025-01-02"', '"junk"', 1, 1, 1, 0, 0, 5, 9)))
    got = scans.scan_kline_positional(spark, str(tmp_path / "g.json"), "SZSE", as_of="2024-12-31", to=str(tmp_path / "table"))
    assert [str(r["trading_date"]) for r in got.collect()] == ["2024-01-02"]
    with pytest.raises(publish.LoadRejected, match="already"):
        scans.scan_kline_positional(spark, str(tmp_path / "g.json"), "SZSE", as_of="2024-12-31", to=str(tmp_path / "table"))
    with pytest.raises(publish.LoadRejected, match="0 rows"):
        scans.scan_kline_positional(spark, str(tmp_path / "g.json"), "SZSE", as_of="2023-12-31")
    (tmp_path / "w.json").write_text('{"code":"A","total":1,"kline":[[20240102,1,1,1,1,5]]}')
    with pytest.raises(publish.LoadRejected, match="wrong_symbol"):
        scans.scan_kline_counted(spark, str(tmp_path / "w.json"), "SSE", symbol="B")
    assert scans.scan_kline_counted(spark, str(tmp_path / "w.json"), "SSE", symbol="A").count() == 1


def test_counted_files_are_read_whole(spark, sf):
    """The query gives back every bar its files were made of; a range is left to the caller of the reader."""
    from barloom.plans import data_queries
    from barloom.sources import fixtures

    key = ("symbol", "trading_date")
    made, got = fixtures.bars_dense(spark, sf).select(*key), data_queries.scan_kline_counted(spark, sf).select(*key)
    assert made.where("trading_date < '1996-01-01'").count() > 0
    assert made.exceptAll(got).count() == 0 and got.exceptAll(made).count() == 0


def test_range_of_counted_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"code":"A","total":4,"kline":[[20240102,1,1,1,1,5],[20240103,1,1,1,1,5],[20240104,1,1,1,1,5],[20240105,1,1,1,1,5]]}')
    for bounds, days in (({}, [2, 3, 4, 5]), ({"start": "2024-01-03"}, [3, 4, 5]), ({"start": "2024-01-03", "as_of": "2024-01-04"}, [3, 4])):
        assert sorted(r["trading_date"].day for r in scans.scan_kline_counted(spark, str(tmp_path / "r.json"), "SSE", **bounds).collect()) == days


def test_order_id_is_uuid5(spark):
    import uuid

    r = spark.range(1).select(scalar.order_id(F.lit("s"), F.lit("510300"), F.lit("buy"), F.lit("100.500").cast("decimal(10,3)"), F.lit("2024-01-02").cast("date")).alias("i")).first()["i"]
    assert r == str(uuid.uuid5(uuid.NAMESPACE_URL, "barloom/order/s|510300|buy|100.5|2024-01-02"))


def test_stream_validators(spark, tmp_path):
    b = bars(spark, [1, 2, 3]).withColumn("low", F.when(F.col("close") == 3, 9.0).otherwise(F.col("low")))
    scans.sink_bars_parquet(b, str(tmp_path / "in"))
    q = validators.invalid_bars(validators.bar_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bad").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["reason"] for r in spark.sql("SELECT * FROM bad").collect()] == ["low_above_body"]
    q = validators.first_bars(validators.bar_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM once").count() == 3


def test_export_is_loaded_whole_or_not_at_all(spark, tmp_path):
    head, good = "日期,开盘,收盘,最高,最低,成交量\n", "2024-01-02,1,1,1,1,5\n"
    load = lambda name, **k: scans.scan_provider_export(spark, str(tmp_path / name), "A", "T", "raw", **k).collect()
    (tmp_path / "g.csv").write_text(head + good)
    assert len(load("g.csv")) == 1
    for name, row, reason in (("x", "2024-01-03,1,--,1,1,5\n", "missing"), ("y", "soon,1,1,1,1,5\n", "unreadable_date"), ("z", good, "duplicate")):
        (tmp_path / f"{name}.csv").write_text(head + good + row)
        with pytest.raises(Exception, match=reason):
            load(f"{name}.csv")
    with pytest.raises(Exception, match="out_of_range"):
        load("g.csv", start="2024-01-03", as_of="2024-02-01")
    (tmp_path / "e.csv").write_text(head)
    with pytest.raises(ValueError, match="no rows"):
        load("e.csv")


def test_instruments_without_overlap_are_blocked(spark):
    a = bars(spark, [10, 11]).unionByName(bars(spark, [5], "B"))
    o = reconcile.reconcile_overlap(a, a.where("symbol = 'A'").withColumn("volume", F.lit(1.0)), spark.createDataFrame([], "symbol string, application_date date"))
    got = {r["symbol"]: (r["overlap"], r["status"], r["reason"]) for r in reconcile.reconciliation_report(o, reconcile.adjudicate(o, a), a).collect()}
    assert got == {"A": (2, "pass", None), "B": (0, "blocked", "no_overlap")}


def test_contexts_are_told_by_footers(spark, tmp_path):
    from barloom.operators import provenance

    b = bars(spark, [1, 2]).unionByName(bars(spark, [3], "B"))
    scans.sink_bars_parquet(b, str(tmp_path / "x"), "ab" * 32)
    scans.sink_bars_parquet(b.where("symbol = 'A'"), str(tmp_path / "y"))
    found = scans.scan_file_contexts(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split("/")[-5], r["context"], r["rows"]) for r in found) == [("x", "ab" * 32, 1), ("x", "ab" * 32, 2), ("y", None, 2)]
    sizes = {r["path"]: r["length"] for r in found}
    assert all((tmp_path / p.split(str(tmp_path) + "/")[1]).stat().st_size == n for p, n in sizes.items())
    plan = scans.scan_file_contexts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    at = "m string, manifest_id string, path string, sha256 string, size_bytes long, context string"
    files = spark.createDataFrame([("p", 5, "h", "c"), ("q", 6, "k", None), ("r", 7, "two", "c"), ("z", 8, "moved", "c")], "path string, length long, sha256 string, context string")
    want = [("ok", "p", "h", 5, "c"), ("mismatch", "p", "h2", 5, "c"), ("missing", "no", "h3", 5, "c"), ("path_mismatch", "away", "moved", 8, "c"), ("ambiguous", "r", "two", 7, "c"), ("missing", "gone", "twin", 7, "c"), ("missing", "gone2", "twin", 7, "c"), ("path_mismatch", "s", "two", 7, "c")]
    for status, size, context in (("mismatch", 7, None), ("mismatch", 6, "other"), ("ok", 6, None), ("ok", None, None)):
        m = spark.createDataFrame([("x", "i", "q", "k", size, context)], at)
        assert provenance.artifact_verify(m, files).first()["status"] == status
    m = spark.createDataFrame([(w[0], f"i{k}", *w[1:]) for k, w in enumerate(want)], at)
    got = {r["manifest_id"]: r["status"] for r in provenance.artifact_verify(m, files).collect()}
    assert got == {f"i{k}": w[0] for k, w in enumerate(want)}


def test_canonical_types_are_stored(spark, tmp_path):
    b = bars(spark, [1]).selectExpr("symbol", "exchange", "price_basis", "trading_date", *(f"cast('1.2345678901234567890123456789' as decimal(38,28)) as {c}" for c in ("open", "high", "low", "close")), "volume")
    scans.sink_bars_parquet(b, str(tmp_path / "c"), "ab" * 32, canonical=True)
    assert str(scans.scan_bars_parquet(spark, str(tmp_path / "c"), canonical=True).first()["close"]) == "1.2345678901234567890123456789"
    assert scans.scan_file_contexts(spark, str(tmp_path / "c")).first()["price_type"] == "decimal(38,28)"
    huge = bars(spark, [10**10])
    with pytest.raises(Exception, match="(?i)overflow|numeric_value_out_of_range"):
        scans.sink_bars_parquet(huge, str(tmp_path / "h"), canonical=True)
