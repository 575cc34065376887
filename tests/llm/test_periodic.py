"""Runs against a search of all starts and periods, and the query's columns against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import queries
from barloom.llm.periodic import period_runs, runs_of
from barloom.llm.common import words


def all_runs(x: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, less those with a smaller period."""
    out, n = [], len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            s, size = i, j - i + q
            if size >= max(least, exponent * q) and not any(all(x[k] == x[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    of, start, length, period = runs_of([np.array(t, np.int64) for t in texts])
    out: list[list] = [[] for _ in texts]
    for k, s, n, q in zip(of, start, length, period):
        out[k].append((int(s), int(n), int(q)))
    return out


def drawn(rng: random.Random) -> list[int]:
    """Noise of a few words with runs of all periods planted, one inside or beside another."""
    letters = rng.choice((2, 3, 30))
    out: list[int] = []
    for _ in range(rng.randrange(4)):
        out += [rng.randrange(letters) for _ in range(rng.randrange(40))]
        q = rng.choice((1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50))
        unit = [rng.randrange(letters) for _ in range(q)]
        if rng.random() < 0.3:
            unit = unit[: max(1, q // 3)] * 3 + unit[:1]
        out += (unit * 8)[: int(len(unit) * rng.uniform(2, 8))]
    return out


def test_random_texts_equal_a_search_of_everything():
    rng = random.Random(5)
    for _ in range(40):
        texts = [drawn(rng) for _ in range(12)] + [[]]
        assert told(texts) == [all_runs(t) for t in texts]


def test_small_texts_of_two_words():
    texts = [[int(b) for b in format(k, "012b")] for k in range(1 << 12)]
    assert told(texts) == [all_runs(t) for t in texts]


def test_long_periods_and_long_runs():
    rng = random.Random(6)
    unit = [rng.randrange(1 << 20) for _ in range(20_011)]
    assert told([[1 << 21, *unit * 4, 7]]) == [[(1, 80_044, 20_011)]]
    assert told([[1, 2, 3] * 200_000]) == [[(0, 600_000, 3)]]
    assert told([list(range(300_000))]) == [[]]


def expected(doc_id: int | None, text: str | None) -> tuple:
    own = words(text)
    n = len(own)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = all_runs(own)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(own) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(k, " ".join(str(w) for w in drawn(rng)) if k % 7 else None, 1) for k in range(120)]
    rows += [(None, "a a a a a a", 2), (3, "", 3), (3, " \t\n ", 3), (5, "ha ha ha ha ha ha ha ha ha ha ha ha", 4), (6, "x y\x0bx\x0cy\rx\ny x  y", 5), (6, "x y\x0bx\x0cy\rx\ny x  y", 5)]
    folder = str(tmp_path_factory.mktemp("periodic"))
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_on_odd_rows(spark, odd):
    folder, rows = odd
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(str(r[c]) for c in COLUMNS)) for r in queries.op12_periodic_runs(spark, folder).collect())
    assert got == sorted((i is None, i or 0, tuple(str(v) for v in expected(i, t))) for i, t, _ in rows)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    small = {i: t for i, t in texts.items() if len(words(t)) <= 600}
    assert len(small) > 100 and all(got[i] == expected(i, t) for i, t in small.items())


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert period_runs(none).collect() == []
    rng = random.Random(9)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    row = period_runs(spark.createDataFrame([(1, " ".join(["x", *unit * 5]))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 250_000, 50_000)] and row["collapsed"] == " ".join(["x", *unit])


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError):
        period_runs(spark.createDataFrame([], "doc_id long, text string"), exponent=3)
