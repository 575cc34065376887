"""Null ids, nulls in other columns, and repeated rows, through every operator."""

import public_tokenizers

from barloom.llm import decontam, exact, html_blocks, packing, pu_quality, simhash, substring, tokens, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = " ".join(f"word{i}" for i in range(40))
BIG = 1 << 60


def docs(spark):
    return spark.createDataFrame([(None, TEXT, None, None), (BIG + 1, TEXT, None, None), (BIG + 1, TEXT, None, None), (BIG + 3, None, "en", "s")], "doc_id long, text string, lang string, source string")


def test_null_and_large_ids(spark):
    d = docs(spark)
    ids = {None, BIG + 1, BIG + 3}
    p = packing.pack_documents(d, PATH).collect()
    assert {r["doc_id"] for r in p} == ids and len(p) == 4
    e = exact.exact_dedup(d).collect()
    assert {r["id"] for r in e} == ids and all(r["keep_id"] == BIG + 1 for r in e if r["id"] != BIG + 3)
    assert {(r["id"], r["component"]) for r in simhash.simhash_classes(d).collect()} == {(None, BIG + 1), (BIG + 1, BIG + 1), (BIG + 3, BIG + 3)}
    assert sorted(map(tuple, simhash.near_copies(d).collect()), key=str) == [(BIG + 1, BIG + 1)] * 2 + [(None, BIG + 1)]
    s = substring.remove_repeats(d).collect()
    assert {r["id"] for r in s} == ids and [r["n_removed"] for r in s if r["id"] is None] == [0] and all(r["n_removed"] == 40 for r in s if r["id"] == BIG + 1)
    assert {r["id"] for r in tokens.section_tokens(d, PATH).collect()} == ids
    assert {r["id"] for r in pu_quality.score(d, pu_quality.fit(d, d.limit(0).selectExpr("doc_id as id"), d.limit(0).selectExpr("doc_id as id"))).collect()} == ids
    b = spark.createDataFrame([(None, TEXT)], "item_id long, text string")
    assert {(r["id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(None, None), (BIG + 1, None)}
    pages = d.selectExpr("doc_id as page_id", "lang as url", "text as html")
    assert {r["id"] for r in html_blocks.extract(pages).collect()} == ids
    assert {r["id"] for r in warc.round_trip(pages).collect()} == ids
