import html
import math
import re
from collections import Counter

import pytest

from barloom.llm import langid, queries

NONE = "doc_id long, text string, lang string, source string"


def plain_letters(text):
    out = bytearray(b" ")
    for x in (text or "").encode("utf-8", "replace").lower() + b" ":
        x = x if 97 <= x <= 122 or x >= 128 else 32
        if x != 32 or out[-1] != 32:
            out.append(x)
    return bytes(out)


def plain_trigrams(text):
    b = plain_letters(text)
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(b) - 2)]


def plain_page(url, page):
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    host = m.group(1).lower() if m else None
    parts = host.split(".") if host else []
    n = 3 if len(parts) > 2 and len(parts[-1]) == 2 and len(parts[-2]) <= 3 else 2
    domain = ".".join(parts[-n:]) or None
    lang = re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", page or "")
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page or "")
    return html.unescape(re.sub(r"<[^>]*>", " ", text)), [lang and lang.group(1).lower(), parts[-1] if parts else None, domain, host if host != domain else None]


def test_equals_brute_force(spark, sf):
    """The whole computation in plain Python, over all pages and documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    names = sorted({r["lang"] for r in docs})
    count, single = {n: Counter() for n in names}, Counter()
    for r in docs:  # fewer than the sample's bound
        count[r["lang"]].update(plain_trigrams(r["text"]))
        single.update(plain_letters(r["text"]))
    log = {n: (lambda c, t: lambda g: math.log((c[g] + 0.02) / (t + 0.02 * 65536)))(c, sum(c.values())) for n, c in count.items()}
    alone = {b: math.log((single[b] + 1) / (sum(single.values()) + 256)) for b in range(256)}
    rows = [("d", r["doc_id"], r["text"], [None, None, None, r["source"] and "source:" + r["source"]]) for r in docs]
    rows += [("p", r["page_id"], *plain_page(r["url"], r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    post, sums, whole = [], {}, [0.0] * len(names)
    for _, _, text, evidence in rows:
        g = plain_trigrams(text)
        ll = [sum(map(log[n], g)) for n in names]
        b = plain_letters(text)
        random = sum(math.log((math.exp(alone[x] + alone[y] + alone[z]) + 1 / 65536) / 2) for x, y, z in zip(b, b[1:], b[2:]))
        p = [math.exp((x - max(ll)) / 3) for x in ll]
        p = [x / sum(p) for x in p]
        post.append((p, bool(g), bool(g) and max(ll) > random))
        if g:
            whole = [a + x for a, x in zip(whole, p)]
            for kind, v in enumerate(evidence):
                if v is not None:
                    sums[kind, v] = [a + x for a, x in zip(sums.get((kind, v), [0.0] * len(names)), p)]
    prior = [(x + 1) / (sum(whole) + len(names)) for x in whole]
    want = {}
    for (t, i, _, evidence), (p, seen, known) in zip(rows, post):

        def smoothed(kind, parent):
            v = evidence[kind]
            if v is None:
                return parent
            own = [max(s - (x if seen else 0.0), 0.0) for s, x in zip(sums.get((kind, v), [0.0] * len(names)), p)]
            return [(s + 20 * q) / (sum(own) + 20) for s, q in zip(own, parent)]

        host = smoothed(3, smoothed(2, smoothed(1, prior)))
        score = [math.log(max(x, 1e-300)) + math.log(h) + math.log(d) - math.log(w) for x, h, d, w in zip(p, host, smoothed(0, prior), prior)]
        best = max(range(len(names)), key=lambda k: score[k])
        probability = 1 / sum(math.exp(s - score[best]) for s in score)
        want[t, i] = names[best], probability, known and probability >= 0.5
    got = queries.op3_language_id(spark, sf).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        language, probability, kept = want["d" if r["page_id"] is None else "p", r["doc_id"] if r["page_id"] is None else r["page_id"]]
        assert r["language"] == language and r["kept"] == kept and r["probability"] == pytest.approx(probability, rel=1e-4)


def test_held_out_documents_and_pages(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(d.where("doc_id % 2 = 0"))
    want = {r["doc_id"]: r["lang"] for r in d.where("doc_id % 2 = 1").select("doc_id", "lang").collect()}
    got = langid.identify(langid.document_evidence(d.where("doc_id % 2 = 1")), model).collect()
    assert sum(r["language"] == want[r["id"]] for r in got) >= 0.98 * len(want) and sum(r["kept"] for r in got) >= 0.97 * len(want)
    p = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    path = {r["page_id"]: re.search(r"//[^/]+/(\w\w)/", r["url"]).group(1) for r in p.collect() if re.search(r"//[^/]+/(\w\w)/", r["url"] or "")}
    got = {r["id"]: r["language"] for r in langid.identify(langid.page_evidence(p), model).collect()}
    assert sum(got[i] == lang for i, lang in path.items()) >= 0.95 * len(path) and len(path) > 100


def test_random_letters_are_no_known_language(spark, sf):
    import random

    rng = random.Random(2)
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    junk = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(50)), None, "s") for i in range(20)] + [(100, "日本語の文章です。" * 9, None, "s"), (101, "12 34 !!", None, "s")]
    got = langid.identify(langid.document_evidence(spark.createDataFrame(junk, NONE)), model).collect()
    assert len(got) == 22 and not any(r["kept"] for r in got)


def evidence(spark, rows):
    return spark.createDataFrame([(*r[:2], False, *r[2:]) for r in rows], "id long, text string, markup boolean, declared string, suffix string, domain string, host string, p double, seen string, score int")


def test_host_and_markup_decide_without_text(spark, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    d = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'fr'").limit(20).collect()
    rows = [(i, r["text"], "fr", "org", "a.org", "x.a.org", 1.0, "s", 1) for i, r in enumerate(d)] + [(100, None, "fr", "org", "a.org", "x.a.org", 1.0, "s", 1), (101, "***", None, None, None, "x.a.org", 1.0, "s", 1)] + [(102, None, None, None, None, None, 1.0, "s", 1)] * 2 + [(None, "long " * 200_000, None, None, None, None, 1.0, "s", 1)]
    got = {r["id"]: r for r in langid.identify(evidence(spark, rows), model).collect()}
    assert got[100]["language"] == got[101]["language"] == "fr" and not got[100]["kept"] and got[100]["text_language"] is None
    assert got[0]["kept"] and got[None]["text_language"] is not None


def test_ties_go_to_the_first_name(spark):
    model = langid.fit(spark.createDataFrame([(1, "same words", "xx", "s"), (2, "same words", "bb", "s")], NONE))
    r = langid.identify(langid.document_evidence(spark.createDataFrame([(5, "same words", None, None)], NONE)), model).first()
    assert r["language"] == r["text_language"] == "bb" and abs(r["probability"] - 0.5) < 1e-9


def test_page_parts(spark):
    rows = [(1, "https://blog.a.example.org/en/1?x", '<html LANG="de"><p>Text &amp; caf&eacute;s</p><script>no</script>'), (2, "http://u@www.shop.co.uk:80/", None), (3, "http://example.net", ""), (4, None, None)]
    p = langid.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("id").collect()
    assert [(r["declared"], r["suffix"], r["domain"], r["host"]) for r in p] == [("de", "org", "example.org", "blog.a.example.org"), (None, "uk", "shop.co.uk", "www.shop.co.uk"), (None, "net", "example.net", None), (None, None, None, None)]
    assert langid.between_tags(p[0]["text"]).split() == ["Text", "&", "cafés"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], NONE)
    assert langid.fit(none)["languages"] == []
    one = spark.createDataFrame([(1, "a", None, None)], none.schema)
    assert langid.identify(langid.document_evidence(one), langid.fit(none)).first()["kept"] is False
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en", "s")], none.schema))
    assert langid.identify(langid.document_evidence(none), model).count() == 0
