import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.bpe import encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_and_spans_equal_the_library(tok, spark, sf):
    rng = random.Random(3)
    pieces = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0​  ab'sllveé日ñ1٣!?.<|endoftext|>😀́")
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)] + ["x<|endoftext|> y", "<|endoftext|>hi", "hi  <|endoftext|>", "<|endoftext|><|endoftext|> é", "<|endoftext|", "", "a" * 5000]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    e = encode([*texts, None], PATH, spans=True)
    for i, y in enumerate(tok.encode_batch([*texts, ""], add_special_tokens=False)):
        z = slice(e.bounds[i], e.bounds[i + 1])
        assert y.ids == e.ids[z].tolist() and y.offsets == list(zip(e.first[z].tolist(), e.end[z].tolist()))


def test_every_token_is_placed_once(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 5000), (10**6 + 3, "same"), (10**6 + 4, "same")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, sequence_id int")
    got = [r.asDict() for r in packing.pack_documents(df, PATH).collect()]
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["length"] == 1024 for r in own[1:]) and own[0]["start"] == 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(by_seq) <= least * 1.01 + 2


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4])
    bins = packing.local_search([[0, 2], [1, 3], [4, 5]], lengths, 15)
    assert len(bins) == 2 and sorted(x for b in bins for x in b) == list(range(6)) and all(lengths[b].sum() <= 15 for b in bins)
    swap = np.array([7, 2, 6, 3, 2])  # only an exchange makes room
    bins = packing.local_search([[0, 1], [2, 3], [4]], swap, 10)
    assert len(bins) == 2 and all(swap[b].sum() <= 10 for b in bins)


def test_groups_and_second_round(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randint(1, 1024), 0) for i in range(3000)]
    p = spark.createDataFrame(rows, packing.PIECES).cache()
    got = packing.pack_pieces(p, group=300).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    alone = len(packing.best_fit(np.array([r[3] for r in rows]), 1024))
    assert max(fill.values()) <= 1024 and len(fill) <= alone * 1.03


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_equal_rows_spread_over_groups(spark):
    """Rows that share doc_id and piece, equal or not, are dealt to all groups and keep sequences apart."""
    rows = [(-(1 << 63), 0, 0, 700, 5)] * 6000 + [(-(1 << 63), 0, 0, 600, k) for k in range(1000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    sizes = [r["count"] for r in packing.dealt(pieces, 0, 500).groupBy("g").count().collect()]
    assert sum(sizes) == 7000 and len(sizes) == 14 and max(sizes) < 700
    got = packing.pack_pieces(pieces, group=500).collect()
    assert len(got) == 7000 and len({r["sequence_id"] for r in got}) == 7000 and all(r["offset"] == 0 for r in got)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "\x0b", "\r", "\u3000", "a", "ab ", "1", "!"])
def test_long_runs_of_anything_have_the_ids_of_the_library(unit):
    library = Tokenizer.from_file(PATH)
    for n in (99_998, 100_001, 1_200_000):
        text = "y" + unit * (n // len(unit)) + "z <|endoftext|> é"
        e = encode(["x", text], PATH, spans=True)
        own = library.encode(text, add_special_tokens=False)
        assert e.ids[e.bounds[1] :].tolist() == own.ids
        assert e.first[e.bounds[1]] == 0 and e.end[-1] == len(text)
