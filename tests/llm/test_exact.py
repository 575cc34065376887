import re

from barloom.llm import exact

SCHEMA = "doc_id long, text string, n long, p string, sha string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-(len(t or "")), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def test_cases_and_clashing_columns(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "a b"), (7, "A b"), (8, "a  b"), (9, "x" * 300_000), (10, "x" * 300_000 + " "), (11, "x" * 299_999 + "y")]
    want = brute(rows)
    for digests in ("all", "survivors"):
        got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_dedup(table(spark, rows), digests=digests).collect()}
        assert got == want


def test_repeated_rows_and_empty(spark):
    got = exact.exact_dedup(table(spark, [(1, "a"), (1, "a"), (2, "b")])).collect()
    assert sorted((r["id"], r["group_size"], r["kept"]) for r in got) == [(1, 2, True), (1, 2, True), (2, 1, True)]
    assert exact.exact_dedup(table(spark, [])).count() == 0


def test_native(spark, sf):
    plan = exact.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """With as few bits as pairs, texts that only seem to have company are hashed too, and found to be alone."""
    monkeypatch.setattr(exact, "BITS", 7)
    rows = [(k, f"text {k // 2 if k < 400 else k} {'x' * (k % 300)}" if k >= 400 else f"text {k // 2}") for k in range(900)] + [(None, "text 3"), (900, None), (901, " ")]
    want = brute([r for r in rows if r[0] is not None])
    got = exact.exact_dedup(table(spark, rows)).collect()
    own = {r["id"]: r for r in got if r["id"] is not None}
    assert {i: r["keep_id"] for i, r in own.items()} == {i: w[0] for i, w in want.items()}
    assert sum(r["text_sha256"] is not None for r in got) > 450
    monkeypatch.setattr(exact, "BITS", 27)
    again = exact.exact_dedup(table(spark, rows)).collect()
    plain = lambda rs: sorted((str(r["id"]), r["keep_id"], r["group_size"], r["kept"]) for r in rs)
    assert plain(got) == plain(again)
    # Unique texts are not hashed when the bitmap has room.
    assert all((r["text_sha256"] is None) == (r["group_size"] == 1) for r in again)
