r"""Repeated-passage removal: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and
located in the documents.

A window is ``window`` consecutive words. The anchor of a window is the least hash among its word sequences of
``ANCHOR`` words, so equal windows have equal anchors, and neighbouring windows mostly share one: a run of
windows with the same anchor is a context. Where an anchor occurs once, none of its windows recurs.

1. Anchors of all documents are counted; those that occur again are kept.
2. Documents are joined with their recurring anchors and cut into the contexts around them. All other words of
   all documents lie in no recurring window.
3. Equal contexts are counted once, with their first place; contexts go to shards by anchor. A shard takes the windows whose hashes
   recur, compiles the passages they form where they first stand into an automaton, and streams the contexts of all documents through it: what it
   finds, word by word, tells how often a window occurs and its first place in the corpus. Of an anchor with very many contexts the distinct windows are dealt,
   each once with its count and first place, and the confirmed ones are joined back to its contexts.
4. Occurrences that are not the first are removed from their documents.

Texts travel compressed. Nothing is collected, and a shard holds a bounded number of contexts at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, joined, spent, stored

ANCHOR = 8
#: Contexts of a shard, and contexts of one anchor from which it is dealt by windows.
SHARD = 1500
#: Words of a shard that are spelled in one letter, the first met, and second letters of the others, which have two: an automaton's
#: root has few branches more, and no other node has more.
SINGLE, SECOND = 192, 256

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start of each word, its hash, its document) of texts laid end to end."""
    buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    white = _WHITE[buf]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    n = ends - starts
    if not len(n):
        return buf, starts, np.empty(0, np.uint64), starts
    letters = np.flatnonzero(~white)
    first = np.cumsum(n) - n
    place = np.arange(len(letters)) - np.repeat(first, n)
    power = np.cumprod(np.full(int(n.max()), _BASE, np.uint64))
    h = _mix(np.add.reduceat(_BYTE[buf[letters]] * power[place], first))
    edges = np.cumsum([len(t) + 1 for t in texts])
    return buf, starts, h, np.searchsorted(edges, starts - 1, "right")


def _rolled(h: np.ndarray, k: int, how) -> np.ndarray:
    """``how`` over each k consecutive values, by doubling (``how(a, b, size of a)``); k need not be a power of two if
    ``how`` may count a value twice."""
    out, size = h, 1
    while size * 2 <= k:
        out = how(out[: len(out) - size], out[size:], size)
        size *= 2
    if size < k:
        out = how(out[: len(h) - k + 1], out[k - size : k - size + len(h) - k + 1], k - size)
    return out


def contexts(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, whether it holds its anchor more than once) of the contexts;
    windows are numbered by their first word."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    grams = _rolled(h, ANCHOR, lambda a, b, size: _mix(a * _BASE + np.uint64(size)) + b)
    grams = _mix(grams)
    least = _rolled(grams, window - ANCHOR + 1, lambda a, b, _: np.minimum(a, b))[:n]
    whole = doc[:n] == doc[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.empty(0, np.uint64), at, at, np.empty(0, bool)
    new = np.concatenate([[True], (np.diff(at) != 1) | (least[at][1:] != least[at][:-1]) | (doc[at][1:] != doc[at][:-1])])
    head = np.flatnonzero(new)
    m, s, n = least[at[head]], at[head], np.diff(np.append(head, len(at)))
    wide = n + window - ANCHOR
    first = np.cumsum(wide) - wide
    held = grams[np.arange(int(wide.sum())) - np.repeat(first, wide) + np.repeat(s, wide)] == np.repeat(m, wide)
    return m, s, n, np.add.reduceat(held.astype(np.int64), first) > 1


def _pack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _window_hashes(ids: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` consecutive numbers, from one running sum of powers."""
    base, back = np.uint64(int(_BASE) | 1), np.uint64(pow(int(_BASE) | 1, -1, 1 << 64))
    ones = np.concatenate([[np.uint64(1)], np.full(max(len(ids) - 1, 0), base, np.uint64)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(ids.astype(np.uint64) + np.uint64(1)) * np.cumprod(ones))])
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(ids) - 1, 0), back, np.uint64)]))
    n = max(0, len(ids) - window + 1)
    return _mix((sums[window:] - sums[:-window])[:n] * inverse[:n])


def locate(f: pd.DataFrame, window: int) -> pd.DataFrame:
    """One shard: contexts ``m, c1, c2, base, ctx, doc, start, n`` to ``m, c1, c2, off, len, fd, fs``: the stretches of recurring
    windows of each context, with the place where their first occurrence begins.

    Windows whose hashes occur again are candidates. Their stretches where they first stand, the passages, are compiled into an
    automaton, window by window, over words spelled in one or two letters, so that no node has many branches. All contexts are
    streamed through it, and what it finds, word by word, gives the counts and the first places."""
    import ahocorasick

    number: dict[str, int] = {}
    seqs = [[number.setdefault(w, len(number)) for w in c.split(" ")] for c in f["ctx"]]
    sizes = np.array([len(s) for s in seqs])
    ids = np.fromiter(chain.from_iterable(seqs), np.int64, int(sizes.sum()))
    # First letters and second letters differ, so no match begins within a word.
    two = max(0, len(number) - SINGLE)
    letters = [chr(0x100 + w) for w in range(min(len(number), SINGLE))] + [chr(0x1000 + SECOND + w // SECOND) + chr(0x1000 + w % SECOND) for w in range(two)]
    spelled = ["".join(map(letters.__getitem__, s)) for s in seqs]

    # Places of all windows: context and number within it.
    h = _window_hashes(ids, window)
    first = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - window + 1, 0)
    ctx = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    h = h[first[ctx] + k]
    n, doc, start = f["n"].to_numpy(np.int64), f["doc"].to_numpy(np.int64), f["start"].to_numpy(np.int64)
    order = np.lexsort((start[ctx] + k, doc[ctx], h))
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(order) else order
    many = np.add.reduceat(n[ctx[order]], head) > 1 if len(order) else head
    wanted = np.zeros(len(ctx), bool)
    wanted[order] = np.repeat(many, np.diff(np.append(head, len(order))))
    new = order[head[many]]
    wide = np.where(ids < SINGLE, 1, 2)
    letter = np.concatenate([[0], np.cumsum(wide)])  # the first letter of each word, all contexts in a row
    word_of = np.repeat(np.arange(len(ids)), wide)
    c = k_ = p = np.empty(0, np.int64)
    automaton, patterns, distinct = ahocorasick.Automaton(), 0, True  # at first, one pattern per hash
    while len(new):
        a, z = first[ctx[new]] + k[new], first[ctx[new]] + k[new] + window
        base = letter[first[ctx[new]]]
        for i, x, y in zip(ctx[new].tolist(), (letter[a] - base).tolist(), (letter[z] - base).tolist()):
            word = spelled[i][x:y]
            if distinct or word not in automaton:
                automaton.add_word(word, patterns)
                patterns += 1
        automaton.make_automaton()
        found = [list(automaton.iter(s)) for s in spelled]
        c = np.repeat(np.arange(len(found)), [len(x) for x in found])
        ends, p = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64, 2 * len(c)).reshape(-1, 2).T
        k_ = word_of[letter[first[c]] + ends] - first[c] - window + 1
        # A candidate that no pattern matches shares another window's hash: it is a pattern of its own.
        known = np.zeros(len(ctx), bool)
        known[(np.cumsum(count) - count)[c] + k_] = True
        new, distinct = np.flatnonzero(wanted & ~known), False
    k = k_
    times = np.bincount(p, weights=n[c], minlength=patterns)
    order = np.lexsort((start[c] + k, doc[c], p))
    top = order[np.concatenate([[True], p[order][1:] != p[order][:-1]])] if len(order) else order
    fd, fs = np.zeros(patterns, np.int64), np.zeros(patterns, np.int64)
    fd[p[top]], fs[p[top]] = doc[c[top]], (start[c] + k)[top]
    sure = times[p] > 1
    c, k, fd, fs = c[sure], k[sure], fd[p[sure]], fs[p[sure]]
    order = np.lexsort((k, c))
    c, k, fd, fs = c[order], k[order], fd[order], fs[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1] + 1) | (fd[1:] != fd[:-1]) | (fs[1:] != fs[:-1] + 1)]) if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    own = f.iloc[c[at]]
    return pd.DataFrame({"m": own["m"].to_numpy(), "c1": own["c1"].to_numpy(), "c2": own["c2"].to_numpy(), "off": (own["base"].to_numpy() + k[at]).astype(np.int32), "len": np.diff(np.append(at, len(c))).astype(np.int32), "fd": fd[at], "fs": fs[at]})


def windows_of(kinds: DataFrame, window: int) -> DataFrame:
    """The single windows of contexts: ``m, c1, c2`` of the context, ``base`` the window's place in it, and its words ``ctx``
    with ``doc, start, n``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                w = r.ctx.split(" ")
                out += [(r.m, r.c1, r.c2, k, " ".join(w[k : k + window]), r.doc, r.start + k, r.n) for k in range(len(w) - window + 1)]
            yield pd.DataFrame(out, columns=f.columns)

    return kinds.mapInPandas(cut, "m long, c1 long, c2 long, base int, ctx string, doc long, start long, n long")


def _window_key() -> tuple[Column, Column]:
    return F.xxhash64("ctx").alias("w1"), F.xxhash64(F.lit(7), "ctx").alias("w2")


def hot_windows(kinds: DataFrame, window: int) -> DataFrame:
    """The distinct windows of contexts as rows for ``locate``: each once per anchor, with the number of its occurrences and its
    first place, however many contexts hold it."""
    own = windows_of(kinds, window).groupBy("m", "ctx").agg(F.min(F.struct("doc", "start")).alias("f"), F.sum("n").alias("n"))
    w1, w2 = _window_key()
    return own.select("m", w1.alias("c1"), w2.alias("c2"), F.lit(0).alias("base"), "ctx", "f.doc", "f.start", "n")


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: ``texts(doc, th, packed)``, the compressed texts of all rows, and ``spans(doc, th, removed)``, for
    rows with such words the word ranges ``array<struct<a, b>>`` covered by a window that also starts earlier."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text", 2_000_000):
            _, _, h, doc = word_table([t.encode("utf-8", "replace") for t in f["text"]])
            m, at, _, twice = contexts(h, doc, window)
            own = pd.DataFrame({"m": m.view(np.int64), "i": doc[at] if len(at) else at, "k": 1 + twice})
            own = own.groupby(["i", "m"], as_index=False)["k"].sum()
            yield pd.DataFrame({"m": own["m"], "k": np.minimum(own["k"], 2).astype(np.int32), "doc": f["doc"].to_numpy()[own["i"]], "th": f["th"].to_numpy()[own["i"]]})

    found = rows.mapInPandas(anchors, "m long, k int, doc long, th long")
    again = stored(found.groupBy("m").agg(F.sum("k").alias("k")).where("k > 1").select("m"), "anchors")
    lists = found.select("m", "doc", "th").join(again, "m", "left_semi").groupBy("doc", "th").agg(F.collect_set("m").alias("ms"))

    def packer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            yield pd.DataFrame({"doc": f["doc"], "th": f["th"], "packed": [_pack(t.encode("utf-8", "replace")) for t in f["text"]]})

    texts = rows.mapInPandas(packer, "doc long, th long, packed binary")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 200):
                part = f.iloc[a : a + 200]
                raw = [_unpack(p) for p in part["packed"]]
                buf, starts, h, doc = word_table(raw)
                m, at, n, _ = contexts(h, doc, window)
                if not len(m):
                    continue
                wanted = np.concatenate([np.asarray(x, np.int64) for x in part["ms"]])
                of = np.repeat(np.arange(len(part)), [len(x) for x in part["ms"]])
                have = pd.MultiIndex.from_arrays([doc[at], m.view(np.int64)])
                keep = np.flatnonzero(have.isin(pd.MultiIndex.from_arrays([of, wanted])))
                first = np.searchsorted(doc, np.arange(len(part)))  # first word of each document
                words: dict[int, list[bytes]] = {}
                out = []
                for k in keep.tolist():
                    d = int(doc[at[k]])
                    if d not in words:
                        words[d] = raw[d].split()
                    s = int(at[k] - first[d])
                    out.append((int(m[k].view(np.int64)), int(part["doc"].iat[d]), int(part["th"].iat[d]), s, b" ".join(words[d][s : s + int(n[k]) + window - 1]).decode()))
                yield pd.DataFrame(out, columns=["m", "doc", "th", "start", "ctx"])

    occ = stored(texts.join(lists, ["doc", "th"]).mapInPandas(cut, "m long, doc long, th long, start long, ctx string"), "contexts")
    spent(again)
    first = F.min(F.struct("doc", "start"))
    kinds = occ.groupBy("m", "ctx").agg(first.alias("f"), F.count("*").alias("n")).select("m", F.xxhash64("ctx").alias("c1"), F.xxhash64(F.lit(7), "ctx").alias("c2"), F.lit(0).alias("base"), "ctx", "f.doc", "f.start", "n")
    kinds = stored(kinds, "distinct-contexts")
    shards = max(1, -(-kinds.count() // SHARD))
    hot = stored(kinds.groupBy("m").count().where(F.col("count") > SHARD).select("m"), "hot-anchors")

    result = "m long, c1 long, c2 long, off int, len int, fd long, fs long"
    cool = kinds.join(hot, "m", "left_anti").withColumn("g", F.pmod(F.xxhash64("m"), F.lit(shards)))
    hits = cool.groupBy("g").applyInPandas(lambda f: locate(f, window), result)
    if not hot.isEmpty():
        of_hot = kinds.join(hot, "m", "left_semi")
        distinct = stored(hot_windows(of_hot, window), "hot-windows")
        dealt = distinct.withColumn("g", F.pmod(F.xxhash64("ctx"), F.lit(max(1, -(-distinct.count() // SHARD)))))
        sure = dealt.groupBy("g").applyInPandas(lambda f: locate(f, window), result).select("m", F.col("c1").alias("w1"), F.col("c2").alias("w2"), "fd", "fs")
        found_in = joined(windows_of(of_hot, window).select("m", "c1", "c2", "base", *_window_key()), stored(sure, "sure-windows"), ["m", "w1", "w2"], "inner")
        hits = hits.unionByName(found_in.select("m", "c1", "c2", F.col("base").alias("off"), F.lit(1).alias("len"), "fd", "fs"))
    places = occ.select("m", "doc", "th", "start", F.xxhash64("ctx").alias("c1"), F.xxhash64(F.lit(7), "ctx").alias("c2"))
    again_at = places.join(hits, ["m", "c1", "c2"]).where("not (fd = doc and fs = start + off)")
    span = F.struct((F.col("start") + F.col("off")).alias("a"), (F.col("start") + F.col("off") + F.col("len") + (window - 1)).alias("b"))
    return texts, again_at.groupBy("doc", "th").agg(F.collect_set(span).alias("removed"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` per row, and with ``texts_too`` the kept words joined by spaces
    (``kept``): every word is removed that a window covers whose word sequence also starts earlier, in a
    document with a smaller id or earlier in the same one.

    Defined cases: null and empty texts have no words; very long texts are read whole; texts of fewer words than a window lose none; rows that share an id are
    places of one document each (equal rows do not repeat each other; only other ids do); a null id counts as the
    smallest; an empty table gives an empty result; other columns are ignored."""
    texts, spans = repeats(docs, window, id_col, text_col)
    lowest = -(1 << 63)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, packed, removed in zip(f["doc"].tolist(), f["packed"], f["removed"]):
                w = _unpack(packed).split()
                n = len(w)
                if removed is not None:
                    gone = np.zeros(n + 1, np.int64)
                    for r in removed:
                        gone[r["a"]] += 1
                        gone[r["b"]] -= 1
                    w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                kept = b" ".join(w)
                out.append((None if doc == lowest else doc, n, n - len(w), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts_too else [])))
            frame = pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts_too else [])])
            yield frame.astype({"id": "Int64"})

    return texts.join(spans, ["doc", "th"], "left").mapInPandas(finish, "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts_too else ""))
