"""Repeated and null ids: every operator keeps rows apart that share an id, whatever its frequency."""

import hashlib
import re
from collections import Counter

import public_tokenizers

from barloom.llm import decontam, exact, html_blocks, langid, packing, pu_quality, simhash, substring, tokens, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(5)]
#: One id with five different texts (one twice), a thousand null ids, and ids of their own.
ROWS = [(9, t) for t in TEXTS] + [(9, TEXTS[0])] + [(None, TEXTS[i % 3] if i % 2 else f"null {i}") for i in range(1000)] + [(1, TEXTS[4] + " "), (2, "alone")]


def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ROWS], "doc_id long, text string, lang string, source string, id long")


def white(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t)


def test_exact(spark):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(white(t), []).append((-len(t), i is None, i or 0))
    want = Counter()
    for i, t in ROWS:
        g = groups[white(t)]
        best = min(g)
        keep = None if best[1] else best[2]
        want[i, keep, len(g), keep == i, hashlib.sha256(white(t).encode()).hexdigest()] += 1
    got = exact.exact_dedup(docs(spark), digests="all").collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    short = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(docs(spark)).collect())
    assert short == sum((Counter({k[:4]: n}) for k, n in want.items()), Counter())
    assert short == Counter(tuple(r)[:4] for r in exact.exact_dedup(docs(spark), prefix=2).collect())


def test_paths_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    from barloom.llm import common

    key = lambda df: sorted(map(repr, df.collect()))
    want = key(exact.exact_dedup(docs(spark), digests="all")), key(warc.round_trip(pages(spark)))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", 0)
    assert want == (key(exact.exact_dedup(docs(spark), digests="all")), key(warc.round_trip(pages(spark))))


X = "<p>" + "x" * 1200
PAGES = [(9, X), (9, X + "y"), (12, X), (None, X), (None, X + "z"), (None, X + "z"), (12, X), (3, "s"), (None, None), (4, "s")]


def pages(spark):
    return spark.createDataFrame([(i, "u", h) for i, h in PAGES], "page_id long, url string, html string")


def test_warc(spark):
    got = Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark)).collect())
    want = Counter()
    for i, h in PAGES:
        raw = (h or "").encode()
        top = max((j for j, g in PAGES if g == h and j is not None), default=None) if len(raw) >= 1000 else None
        again = top is not None and top != i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert got == want


def test_no_payload_is_lost(spark):
    from barloom.llm.common import new_dir

    path = new_dir(spark, "warc")
    held = {bytes(r["payload"]) for r in warc.read_records(warc.write_archives(pages(spark), path), path).collect()}
    assert held == {(h or "").encode() for _, h in PAGES} | {b""}


def test_packing_of_one_hot_id(spark):
    one = spark.createDataFrame([(5,)], "doc_id long").crossJoin(spark.range(70_000).select()).selectExpr("doc_id", "0 as piece", "0L as start", "1024L as length", "1L as ids_crc32")
    fill = packing.pack_pieces(one.withColumn("piece", one["piece"].cast("int"))).groupBy("sequence_id").sum("length").collect()
    assert len(fill) == 70_000 and all(r[1] == 1024 for r in fill)


def test_pieces_and_sections(spark):
    got = Counter((r["doc_id"], r["ids_crc32"]) for r in packing.pack_documents(docs(spark), PATH).collect())
    assert sum(got.values()) == len(ROWS) and Counter(i for i, _ in got.elements()) == Counter(i for i, _ in ROWS)
    assert Counter(r["id"] for r in tokens.section_tokens(docs(spark), PATH).collect()) == Counter(i for i, _ in ROWS)


def test_row_by_row_operators(spark):
    d = docs(spark)
    ids = Counter(i for i, _ in ROWS)
    none = d.limit(0).selectExpr("doc_id as id")
    assert Counter(r["id"] for r in pu_quality.score(d, pu_quality.fit(d, none, none)).collect()) == ids
    assert Counter(r["id"] for r in langid.identify(langid.document_evidence(d), langid.fit(d)).collect()) == ids
    assert Counter(r["id"] for r in html_blocks.extract(d.selectExpr("doc_id as page_id", "source as url", "text as html")).collect()) == ids
    s = substring.remove_repeats(d).collect()
    assert Counter(r["id"] for r in s) == ids
    found = decontam.contaminated(d, spark.createDataFrame([(1, TEXTS[2])], "item_id long, text string")).collect()
    assert {(r["id"], r["item_id"]) for r in found} == {(9, 1), (None, 1)}
    classes = simhash.simhash_classes(d).collect()
    assert Counter(r["id"] for r in classes) == ids
    by = {}
    for r in classes:
        by.setdefault(r["fp"], set()).add(r["component"])
    assert all(len(c) == 1 for c in by.values())
