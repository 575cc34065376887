import hashlib
import random

import pytest

from barloom.llm import substring


def brute(rows, window=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            else:
                seen[key] = 1
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def run(spark, rows):
    d = spark.createDataFrame([(i, t, "m", 3) for i, t in rows], "doc_id long, text string, m string, start int")
    return {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(d).collect()}


@pytest.mark.parametrize("shard", [1500, 10])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    rng = random.Random(shard)
    words = [f"w{i}" for i in range(30)] + ["é", "the x", "日本"]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (19, 20, 21, 60, 140)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a " * 400), (504, "a b " * 300), (505, "a " * 19), (506, rows[3][1]), (507, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_null_ids_and_repeated_rows(spark):
    assert run(spark, []) == {}
    text = " ".join(map(str, range(30)))
    d = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r["id"] is not None, r["n_removed"]) for r in substring.remove_repeats(d, texts_too=True).collect())
    assert got == [(False, 0), (True, 30), (True, 30)]


def test_windows_of_hot_anchors_are_dealt_once(spark, monkeypatch):
    """A passage between other neighbours in each of many documents: no group holds a row for each of them."""
    monkeypatch.setattr(substring, "SHARD", 50)
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = [(i, " ".join([*(f"x{rng.getrandbits(40)}" for _ in range(20)), passage, *(f"x{rng.getrandbits(40)}" for _ in range(20))])) for i in range(600)]
    widest = []
    kept = substring.hot_windows
    monkeypatch.setattr(substring, "hot_windows", lambda k, w: widest.append((k.groupBy("m").count().agg({"count": "max"}).first()[0], kept(k, w).groupBy("m", "ctx").count().agg({"count": "max"}).first()[0])) or kept(k, w))
    assert run(spark, rows) == brute(rows)
    assert widest and widest[0][0] > 300 and widest[0][1] == 1


def test_equal_hashes_of_different_windows(monkeypatch):
    """Where hashes tell nothing apart, the automaton still decides by the words."""
    import numpy as np
    import pandas as pd

    text = ["a b c d e", "b c d e f", "x y z u v", "x y z u w", "q q q q q"]
    rows = pd.DataFrame({"m": 1, "c1": range(5), "c2": 0, "base": 0, "ctx": text, "doc": range(5), "start": 0, "n": [1, 1, 1, 1, 3]})
    want = sorted(substring.locate(rows, 4).itertuples(index=False, name=None))
    assert want == [(1, 0, 0, 1, 1, 0, 1), (1, 1, 0, 0, 1, 0, 1), (1, 2, 0, 0, 1, 2, 0), (1, 3, 0, 0, 1, 2, 0), (1, 4, 0, 0, 1, 4, 0), (1, 4, 0, 1, 1, 4, 0)]
    monkeypatch.setattr(substring, "_window_hashes", lambda ids, w: np.zeros(max(0, len(ids) - w + 1), np.uint64))
    assert sorted(substring.locate(rows, 4).itertuples(index=False, name=None)) == want
    monkeypatch.setattr(substring, "SINGLE", 2)
    monkeypatch.setattr(substring, "SECOND", 3)
    assert sorted(substring.locate(rows, 4).itertuples(index=False, name=None)) == want
