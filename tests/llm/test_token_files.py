"""Files of ids against the untouched library, exact round trips, single reads, and broken files."""

from __future__ import annotations

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import queries
from barloom.llm.token_files import WordEncoder, lookup, read_files, write_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTEWISE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text: str | None) -> bytes:
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def odd_texts(n: int) -> list[str]:
    """Texts of every white space, marks, cases, added tokens, and letters of many scripts side by side."""
    rng = random.Random(12)
    bits = ["the", "Ing", "DON'T", "we'll", "x's", "'S", "42", "7", "...", "!?", "é", "É", "ß", "ẞ", "İ", "ΑΣ", "Σ", "ö", "ö", "́", "À", "×", "÷", "ª", "µ", "ÿ", "Ÿ", "中文", "한", "하", "ﬁ", "²", "½", "_", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "​", "﻿", "\x00", "\x1f", "🙂", "أ", "ͅ", "ǅ"]
    white = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", " ", " ", "　", "", ""]
    return ["".join(rng.choice(bits) + rng.choice(white) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_encoder_equals_the_library(spark, library):
    own = WordEncoder(TOKENIZER)
    assert own.by_piece
    for t in [*odd_texts(4000), "a" * 100_000, " " * 100_000, "é" * 5000 + "́" * 50]:
        assert own.ids(t) == ids_of(library, t)[:-4], t[:80]
    for c in range(0x250):
        t = f"ab{chr(c)}cd {chr(c)} {chr(c)}x x{chr(c)}"
        assert own.ids(t) == ids_of(library, t)[:-4], hex(c)


def test_encoder_of_other_files_is_the_library():
    own, library = WordEncoder(BYTEWISE), Tokenizer.from_file(BYTEWISE)
    assert not own.by_piece
    for t in odd_texts(50):
        assert own.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_are_forgotten_in_time(library):
    own = WordEncoder(TOKENIZER)
    own.KEPT = 20
    for t in odd_texts(200):
        assert own.ids(t) == ids_of(library, t)[:-4]
        assert len(own.piece_ids) < 60


def test_query_on_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_token_files(spark, sf).collect()
    assert len(rows) == len(texts)
    start = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = ids_of(library, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with a hot id, null ids, equal rows, null texts, a long text and a clashing column, in files of a few frames each."""
    rows = [(k * 3, t, "x") for k, t in enumerate(odd_texts(300))] + [(77, f"same id {k}", "x") for k in range(400)] + [(78, "equal rows", "x")] * 200
    rows += [(None, "no id", "x"), (None, None, "x"), (5, None, "x"), (-4, "", "x"), (6, "long text " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = "file://" + str(tmp_path_factory.mktemp("ids"))
    return docs, rows, path, write_files(docs, path, TOKENIZER, file_bytes=3000)


def test_round_trip_in_order(spark, odd, library):
    docs, rows, path, files = odd
    got = sorted(read_files(files, path).collect(), key=lambda r: r["start"])
    assert sorted((r["id"] is not None, r["id"] or 0, bytes(r["ids"])) for r in got) == sorted((i is not None, i or 0, ids_of(library, t)) for i, t, _ in rows)
    order = [(r["id"] is not None, r["id"] or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    sizes = [r["docs"] for r in files.collect()]
    assert len(sizes) > 4 and max(sizes) < len(rows) / 2  # the hot ids are cut too


def test_single_documents(spark, odd, library):
    docs, rows, path, files = odd
    wanted = spark.createDataFrame([(6,), (77,), (30,), (-4,), (10**9,)], "id long")
    whole = {(r["id"], r["start"]): bytes(r["ids"]) for r in read_files(files, path).collect() if r["id"] in (6, 77, 30, -4)}
    assert {(r["id"], r["start"]): bytes(r["ids"]) for r in lookup(files, path, wanted).collect()} == whole and len(whole) >= 403
    assert lookup(files, path, wanted.limit(0)).collect() == []


def test_dictionary_is_named_by_its_hash_and_shared(odd):
    _, _, path, files = odd
    folder = path.removeprefix("file://")
    (own,) = glob.glob(f"{folder}/*.dictionary")
    for f in glob.glob(f"{folder}/*.ids"):
        with open(f, "rb") as file:
            assert file.read(41)[9:].hex() in own


def test_broken_files_are_refused(spark, odd, tmp_path):
    docs, _, _, _ = odd
    path = f"file://{tmp_path}"
    files = write_files(docs.limit(50), path, TOKENIZER)
    name = files.first()["file"]
    raw = bytearray((tmp_path / name).read_bytes())
    raw[-struct.calcsize("<QQQQI8s") - 3] ^= 1
    (tmp_path / name).write_bytes(raw)
    with pytest.raises(Exception, match="broken"):
        read_files(files, path).collect()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_files(write_files(docs, f"file://{tmp_path}", TOKENIZER), f"file://{tmp_path}").collect() == []


def test_texts_alike_need_no_dictionary(spark, tmp_path, library):
    docs = spark.createDataFrame([(k, "a") for k in range(5)], "doc_id long, text string")
    got = read_files(write_files(docs, f"file://{tmp_path}", TOKENIZER), f"file://{tmp_path}").collect()
    assert {bytes(r["ids"]) for r in got} == {ids_of(library, "a")} and len(got) == 5
