"""Spelling variants against a plain search of every edit of every word."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, queries
from barloom.llm.spelling import HELD, slipped, spelling_variants, variants, word_counts

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counted(rows) -> dict[str, int]:
    out: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def searched(words: dict[str, int]) -> list[tuple]:
    form = {}
    near_of = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ALPHABET}
        near_of[w] = sorted((e for e in edits - {w} if e in words), key=lambda e: (-words[e], e))
        if near_of[w] and words[near_of[w][0]] >= 2 * words[w]:
            form[w] = near_of[w][0]
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near_of[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = searched(counted(rows))
    assert len(want) > 1000 and sum(r[4] > 0 for r in want) > 100
    assert rows_of(queries.op11_spelling_variants(spark, sf)) == want


def test_random_words_of_few_letters(spark):
    """Rows of equal letters, many neighbours, ties and chains of forms."""
    rng = random.Random(3)
    words = {}
    while len(words) < 1500:
        words["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))] = rng.choice((3, 3, 4, 6, 8, 12, 24, 25, 50, 100))
    got = rows_of(variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == searched(words) and max(r[4] for r in got) > 20
    assert any(r[1] and r[2] != r[1] for r in got)


def test_longest_chains_of_forms(spark):
    """Each word leads to the next, which is twice as frequent."""
    words = {"a" * k: 3 << k for k in range(1, 30)}
    got = rows_of(variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == searched(words) and {r[2] for r in got} == {"a" * 29}


def test_odd_rows(spark):
    long = " ".join(f"word{chr(97 + k % 26)}" for k in range(200_000))
    rows = [(1, None, 5), (None, "Strasse Strasse straße", 5), (None, "Strasse Strasse straße", 5), (2, "", 5), (2, "straße STRASSE", 5), (3, long, 5), (4, "ābcdef abcādefgh Étatés étatés 1234567", 5), (4, "Étatés Étatés defgh defgh", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    from barloom.llm.spelling import slipped

    assert rows_of(spelling_variants(docs, change=slipped)) == searched(counted([r[:2] for r in rows]))
    assert spelling_variants(docs.limit(0)).collect() == []


def test_tasks_without_words(spark):
    """More tasks than rows, as when a file has more splits than row groups, and tasks whose texts have no word."""
    rows = [(1, "Strasse Strasse Strasse"), (2, "Strassen strassen strassen strasse strasse strasse"), (3, None), (4, "12 345")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert rows_of(spelling_variants(docs, change=slipped)) == searched(counted(rows)) != []
    empty = docs.where("doc_id > 2")
    assert spelling_variants(empty).collect() == [] and spelling_variants(empty.where("doc_id > 4")).collect() == []


def test_nothing_left_after_the_last_words_were_passed_on(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["x" + "".join(w) for w in itertools.product(letters, repeat=4)]
    assert len(words) > HELD
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = word_counts(docs).agg(F.count("*"), F.sum("n"), F.count_distinct("word")).first()
    assert tuple(found) == (len(words),) * 3


def test_tables_too_large_to_be_broadcast_are_not(spark, monkeypatch):
    """Spark takes the copies for as large as the small files they come from."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    words = {"a" * k: 3 << k for k in range(1, 30)}
    out = variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    last = common.joined(*(common.stored(out.select("word", c), c) for c in ("n", "root")), ["word"])
    assert rows_of(out) == searched(words) and last.count() == len(words)
    for df in (out, last):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_ratio_under_two_is_refused(spark):
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([], "word string, n long"), ratio=1)
