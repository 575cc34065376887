"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The text gives likelihoods of hashed byte trigrams under each language and under a background of no known
language, in which letters follow each other at random, with the frequencies they have in the fitted texts. The other evidence is weighed by what the corpus shows of it: grouped aggregations over all rows
sum the text posteriors per declared language, per address suffix, per domain and per host, and the smoothed shares of a
value, against the overall shares, are its likelihood ratio. Shares are smoothed hierarchically: a host toward its
domain, a domain toward its suffix, a suffix toward the whole corpus; each row's own contribution is
taken out first, so no text counts twice.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_sample, id_in, id_out, joined, stored
from .html_scan import TEXT, scan

BUCKETS = 1 << 16
KINDS = ("declared", "suffix", "domain", "host")
_LETTER = np.zeros(256, np.uint8) + 32
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTER[list(range(65, 91))] = list(range(97, 123))


def letters(text: str | None) -> np.ndarray:
    """The bytes of a whole text: letters in lower case, runs of anything else one space, and spaces around it."""
    b = _LETTER[np.frombuffer((" " + (text or "") + " ").encode("utf-8", "replace"), np.uint8)]
    return b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]


def trigrams(b: np.ndarray) -> np.ndarray:
    """Hashed trigrams of ``letters``."""
    b = b.astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def fit(docs: DataFrame, per_language: int = 1500, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> dict:
    """Log likelihoods of the trigrams of each language, and of the single letters of all, from at most ``per_language`` labelled rows of each, those
    with the smallest hashes of their ids. Counting is grouped; what comes back is a table of languages and buckets. Rows without id or
    label are not fitted; of rows that share a sampled id all count; an empty table fits no language."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where("id is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the declared languages: a short list
    if not names:
        return {"languages": [], "log": np.zeros((0, BUCKETS), np.float32), "letters": np.zeros(256)}
    few = reduce(DataFrame.unionByName, (hash_sample(rows.where(F.col("lang") == n), per_language) for n in names))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for f in batches(frames, "text"):
            for lang, t in zip(f["lang"], f["text"]):
                b = letters(t)
                c = np.concatenate([np.bincount(trigrams(b), minlength=BUCKETS), np.bincount(b, minlength=256)])
                sums[lang] = sums.get(lang, 0) + c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    found = rows.join(F.broadcast(few.distinct()), "id").repartition(8, "id").mapInPandas(count, "lang string, bucket long, n long")
    got = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 65,792 per language
    c = np.zeros((len(names), BUCKETS + 256))
    c[np.searchsorted(names, got["lang"].to_numpy(str)), got["bucket"].to_numpy()] = got["n"].to_numpy()
    c, own = c[:, :BUCKETS], c[:, BUCKETS:].sum(0)
    return {"languages": names, "log": np.log((c + 0.02) / (c.sum(1, keepdims=True) + 0.02 * BUCKETS)).astype(np.float32), "letters": np.log((own + 1) / (own.sum() + 256))}


def page_evidence(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Evidence rows of web pages: the markup (its text is read between tags, character references decoded), the declared language, and
    the parts of the address. The domain is the last two labels of the host, or three where the last two are a country's
    code and a short label under it (``co.uk``); a host that is no more than its domain is no evidence of its own. Null html and
    URLs give no evidence of their kinds; very long pages are read whole; other columns are ignored."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    domain = F.regexp_extract(host, r"((?:[^.]+\.)?[^.]+\.[^.]+)$", 1)
    domain = F.when(domain.rlike(r"^[^.]+\.[^.]{1,3}\.[a-z]{2}$"), domain).otherwise(F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1))
    named = lambda c: F.when(c != "", c)
    return pages.select(
        F.col(id_col).alias("id"), F.col("html").alias("text"), F.lit(True).alias("markup"),
        named(F.lower(F.regexp_extract(F.regexp_extract("html", r"(?i)<html([^<>]*+)", 1), r"(?i)\blang\s*+=\s*+[\"']?+([a-zA-Z]{2,3})", 1))).alias("declared"),
        named(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), named(domain).alias("domain"), F.when(host != domain, named(host)).alias("host"),
    )


def document_evidence(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Evidence rows of plain documents: text and source; nothing is declared and there is no address. A null source is no evidence;
    other columns are ignored."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), "text", F.lit(False).alias("markup"), none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.concat(F.lit("source:"), F.col("source")).alias("host"))


def background(b: np.ndarray, single: np.ndarray) -> float:
    """Log likelihood of the trigrams of ``letters`` under no known language: half the chance that its letters stand there each by
    itself, half that of any bucket, for letters that no fitted text has."""
    own = single[b]
    return float((np.logaddexp(own[:-2] + own[1:-1] + own[2:], -np.log(BUCKETS)) - np.log(2)).sum())


_UNREAD = frozenset(("script", "style"))


def between_tags(page: str) -> str:
    """The text between the tags of a page, without scripts and styles, character references decoded."""
    return html.unescape(" ".join(text for kind, text, _ in scan(page, _UNREAD) if kind == TEXT))


def identify(rows: DataFrame, model: dict, smoothing: float = 20.0, accept: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, language, probability, text_language, kept)``, and the columns ``carry``, per row of ``rows(id, text, markup, declared, suffix, domain, host)``.

    All trigrams of a text count, each for a third, since neighbouring
    ones share two of their three letters. ``kept``: the text has letters, a known language is more likely than
    the background, and the fused probability of the best reaches ``accept``.

    Defined cases: null and empty texts, and texts without letters, have no text evidence: the other evidence
    decides, ``text_language`` is null and they are not kept; very long texts are read whole; null evidence of a kind is left out; repeated rows, and rows that share an id or
    have a null one, count once each; ties go to the first language by name; an empty table gives an empty result; without
    fitted languages everything is ``und`` and not kept."""
    names = model["languages"]
    k = len(names)
    if not k:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"), *carry)
    log, single = np.ascontiguousarray(model["log"].T), model["letters"]
    held = ["id", *KINDS, *carry]

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            ll, known = np.zeros((len(f), k)), np.zeros(len(f), bool)
            seen = np.zeros(len(f), bool)
            for i, (t, markup) in enumerate(zip(f["text"], f["markup"])):
                b = letters(between_tags(t) if markup and t else t)
                if len(b) > 2:
                    total = log[trigrams(b)].sum(0, dtype=np.float64)
                    ll[i], seen[i] = total / 3, True
                    known[i] = total.max() > background(b, single)
            p = np.exp(ll - ll.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            out = f[held].copy()
            out["p"], out["seen"], out["known"] = list(p), seen, known
            yield out

    types = dict(rows.dtypes)
    whole_number = types["id"] in ("tinyint", "smallint", "int", "bigint")
    types["id"] = "bigint" if whole_number else types["id"]
    more = "".join(f", {c} {types[c]}" for c in carry)
    base = rows.select(id_in("id").alias("id") if whole_number else F.col("id"), "text", "markup", *KINDS, *carry)
    base = stored(base.mapInPandas(weigh, f"id {types['id']}, declared string, suffix string, domain string, host string{more}, p array<double>, seen boolean, known boolean"), "language-text")
    sums = [F.coalesce(F.sum(F.when(F.col("seen"), F.col("p")[i])), F.lit(0.0)) for i in range(k)]
    share = base.agg(F.array(*sums).alias("s")).first()["s"]  # one number per language
    prior = (np.array(share) + 1) / (sum(share) + k)
    whole = F.array(*(F.lit(float(x)) for x in prior))
    out = base
    for kind in KINDS:
        table = stored(base.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.array(*sums).alias(f"{kind}_s")), f"language-{kind}")
        out = joined(out, table, [kind])

    def smoothed(kind: str, parent: Column) -> Column:
        """Shares of the value without this row, drawn toward the parent's; of no value, the parent's."""
        own = F.zip_with(F.col(f"{kind}_s"), F.col("p"), lambda s, p: F.greatest(s - F.when(F.col("seen"), p).otherwise(0.0), F.lit(0.0)))
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        got = F.zip_with(own, parent, lambda s, q: (s + smoothing * q) / (total + smoothing))
        return F.coalesce(got, parent)

    out = out.withColumn("q_suffix", smoothed("suffix", whole)).withColumn("q_domain", smoothed("domain", F.col("q_suffix"))).withColumn("q_host", smoothed("host", F.col("q_domain"))).withColumn("q_declared", smoothed("declared", whole))
    # posterior ~ text likelihood x host shares (the prior) x declared shares / overall shares
    score = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log(F.greatest(F.get("p", i), F.lit(1e-300))) + F.log(F.get("q_host", i)) + F.log(F.get("q_declared", i)) - F.log(F.get(whole, i)))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    best = F.array_position("score", F.col("top")).cast("int") - 1
    probability = 1 / F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    named = F.array(*map(F.lit, names))
    text_best = F.get(named, F.array_position("p", F.array_max("p")).cast("int") - 1)
    out = id_out(out) if whole_number else out
    return out.select("id", F.get(named, best).alias("language"), probability.alias("probability"), F.when(F.col("seen"), text_best).alias("text_language"), (F.col("known") & (probability >= accept)).alias("kept"), *carry)
