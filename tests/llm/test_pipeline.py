import random
import re

import corpus_pipeline as P
import pytest
from helpers import duck, same

from barloom.llm import queries
from barloom.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, frames = [], []
    for k, (_, f) in enumerate(P.STAGES):
        docs = stored(f(spark, docs, sf), f"t{k}")
        frames.append({r["doc_id"]: r for r in docs.collect()})
        left.append(set(frames[-1]))
        if k < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left[0] >= left[1] >= left[2] >= left[3] == left[4]
    white = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    # Exact copies by brute force: the longest original stays, then the smallest id.
    groups: dict = {}
    for i, r in frames[0].items():
        groups.setdefault(white(r["text"]), []).append((-len(r["text"]), i))
    assert left[1] == {min(g)[1] for g in groups.values()}
    # Near copies by brute force.
    sh = {i: set(zip(*(r["text"].encode().lower().split()[j:] for j in range(5)))) for i, r in frames[1].items()}
    up = {i: i for i in sh}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sh)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sh[a] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert left[2] == {i for i in ids if root(i) == i}
    # What is left holds no benchmark item, and only documents that hold part of one are gone.
    tok = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    items = [tok(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, r in frames[2].items() if any(b in tok(r["text"]) for b in items)}
    assert not held & left[3] and left[2] - left[3] == held


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), duck(sf).sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, f) in enumerate(P.STAGES):
        docs = stored(f(spark, docs, sf), f"e{k}")
        assert docs.count() == 0


def test_stages_do_not_depend_on_how_files_are_split(spark, sf, tmp_path):
    """The same rows stay when files are split otherwise from one scan to the next, as on a cluster whose executors come and go."""
    path = f"{tmp_path}/documents.parquet"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(6):
        docs.where(f"pmod(doc_id, 6) = {k}").coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    key, calls = "spark.sql.leafNodeDefaultParallelism", []
    plain = P.stored

    def changing(df, what):
        calls.append(what)
        spark.conf.set(key, 1 + 7 * (len(calls) % 2))
        return plain(df, what)

    try:
        for name, f in P.STAGES[:-1]:
            want = None
            for first in (1, 8):
                spark.conf.set(key, first)
                P.stored = changing
                out = f(spark, docs, sf)
                spark.conf.set(key, 9 - first)
                rows = sorted(r["doc_id"] for r in out.collect())
                want = want or rows
                assert rows == want, name
            if name == "exact dedup":
                assert len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()}) == len(want)
        assert calls
    finally:
        P.stored = plain
        spark.conf.unset(key)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt int, more int, id long, _row string"


def stage(spark, name, rows, sf):
    docs = stored(spark.createDataFrame([(*r, 1, 2, 3, "n") for r in rows], SCHEMA), "rows")
    out = dict(P.STAGES)[name](spark, docs, sf)
    if name != "best-fit packing":
        assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) if name != "best-fit packing" else r["doc_id"] for r in out.collect()), key=str)


def row(i, t):
    return (i, t, "en" if t and t.isascii() else None, "src", len(t or ""))


def test_stages_decide_row_by_row(spark, sf):
    """Null ids, ids that rows share, equal rows, nulls in all columns, empty and very long texts, and further columns with clashing names."""
    english = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").select("text").distinct().orderBy("text").collect()]
    starts = {tuple(t.split()[:4]): " ".join(t.split()[:60]) for t in english}  # no copies among them
    a, b, c = list(starts.values())[:3]
    rng, own = random.Random(6), " ".join(english).split()
    long = " ".join(rng.choice(own) for _ in range(100_000))
    assert len(long) > 500_000
    junk = "日本語の文章です。" * 9
    rows = [row(1, a), row(1, junk), row(None, a), row(None, junk), row(2, None), row(3, ""), (4, b, None, None, None), row(5, long)]
    assert stage(spark, "language ID", [*rows, *(row(100 + k, t) for k, t in enumerate(english))], sf) == sorted(((r[0], r[1]) for r in [*rows, *(row(100 + k, t) for k, t in enumerate(english))] if r[1] and r[1] != junk), key=str)
    rows = [row(7, a), row(7, a), row(7, b), row(None, b + " "), row(None, c), row(9, a), row(2, None), row(3, "  "), row(5, long)]
    got = stage(spark, "exact dedup", rows, sf)
    assert got == sorted([(7, a), (None, b + " "), (None, c), (3, "  "), (5, long)], key=str)
    near = a + " more"
    rows = [row(7, near), row(7, b), row(None, a), row(4, a + " end"), row(None, c), row(None, c), row(2, None), row(3, ""), row(5, long), row(6, long + " x")]
    assert stage(spark, "SimHash near-dedup", rows, sf) == sorted([(4, a + " end"), (7, b), (None, c), (2, None), (3, ""), (5, long)], key=str)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [row(1, a), row(1, f"{a} {item}"), row(None, f"{item} {b}"), row(None, b), row(None, b), row(2, None), row(5, long), row(6, f"{long} {item}")]
    assert stage(spark, "benchmark decontamination", rows, sf) == sorted([(1, a), (None, b), (None, b), (2, None), (5, long)], key=str)
    got = stage(spark, "best-fit packing", [row(1, "a"), row(1, "a"), row(None, None), row(2, "")], sf)
    assert got == [1, 1, 2, None]
