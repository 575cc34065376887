r"""Runs of repeated words, found by multi-scale minimizers.

Words are those of ``[^\x20\x09-\x0D]+``. A run is a stretch of consecutive words with smallest period q and at least
``exponent`` periods (and ``least`` words) that no neighbouring word extends. Periods below ``DIRECT`` are found by comparing the words
with themselves at each such lag. Longer ones are sought scale by scale: at scale w, for periods from w to below 2w, grams of 2w words are
hashed, and each window of w grams marks its least ones. Grams inside a run of such a period are equal only at
multiples of the period, since a shorter one would be the run's smallest; so the least gram of a period is marked there and again one period on, with
no equal gram between. Pairs of neighbouring equal marks at a distance of the scale are extended word by word both ways, which decides.

A run of four periods holds 2w + 1 such grams at least, more than the period and the window need; the scales reach as far as a quarter of
the longest text, so no run is missed whatever its period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_in, id_out

#: Periods below this are found by direct comparison; the scales begin here.
DIRECT = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _over(h: np.ndarray, size: int, how) -> np.ndarray:
    """``how`` (minimum or maximum) of each ``size`` consecutive values."""
    done = 1
    while done * 2 <= size:
        h, done = how(h[: len(h) - done], h[done:]), done * 2
    if done < size:
        h = how(h[: len(h) - (size - done)], h[size - done :])
    return h


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return edge[::2], edge[1::2]


def _reach(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first index from ``at`` on, in steps of 1 or -1, where ``x`` differs from itself ``lag`` words on, or the end."""
    size = 64
    while True:
        stop = min(at + size, len(x) - lag) if step > 0 else max(at - size, -1)
        if at == stop:
            return at
        a = x[at:stop] if step > 0 else x[stop + 1 : at + 1][::-1]
        b = x[at + lag : stop + lag] if step > 0 else x[stop + 1 + lag : at + 1 + lag][::-1]
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return at + step * int(unlike[0])
        at, size = stop, min(size * 2, 1 << 16)


def _smallest(x: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no proper part of ``period`` is a period of the stretch. A shorter period must divide it, as the stretch has two of both."""
    rest, prime = period, 2
    while rest > 1:
        if rest % prime == 0:
            d = period // prime
            if np.array_equal(x[start : start + period], x[start + d : start + d + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime = prime + 1 if prime * prime <= rest else max(rest, 2)
    return True


def _seeds(x: np.ndarray, size: np.ndarray, exponent: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of neighbouring equal marks, scale by scale, by rising distance and place. ``size``: words of each text in ``x``, where
    each text is followed by one value of its own."""
    doc = np.repeat(np.arange(len(size)), size + 1)
    place, w = np.arange(len(x)), DIRECT
    gram, g = _mixed(x.astype(np.uint64) + np.uint64(1)), 1
    while True:
        long = (size >= exponent * w)[doc]
        if not long.any():
            return
        gram, doc, place = gram[long], doc[long], place[long]
        while g < 2 * w:
            # Grams that reach past the end of their text are of no meaning; what they seed fails when it is extended.
            tail = np.zeros(len(gram), np.uint64)
            tail[: max(0, len(gram) - g)] = gram[g:]
            gram, g = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + tail), 2 * g
        if len(gram) >= w:
            low = _over(gram, w, np.minimum)
            pad = np.zeros(w - 1, np.uint64)
            marked = np.flatnonzero(_over(np.concatenate([pad, low, pad]), w, np.maximum) == gram)
            order = marked[np.argsort(gram[marked], kind="stable")]
            a, b = order[:-1], order[1:]
            good = (gram[a] == gram[b]) & (doc[a] == doc[b]) & (b - a >= w) & (b - a < 2 * w)
            a, d = a[good], (b - a)[good]
            for k in np.lexsort((a, d)):
                yield int(place[a[k]]), int(d[k])
        w *= 2


def runs_of(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts given as numbers of their words (from 0), by text, start and period."""
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size + 1)
    x = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for t, e, n in zip(texts, ends, size):
        x[e - 1 - n : e - 1] = t
    x[ends - 1] = -2 - np.arange(len(size))  # equal to nothing, so no stretch passes a text's end
    found: list[tuple[int, int, int]] = []

    def keep(start: int, stop: int, q: int) -> None:
        n = stop - start + q
        if n >= max(least, exponent * q) and _smallest(x, start, n, q):
            found.append((start, n, q))

    for q in range(1, min(DIRECT, len(x))):
        a, b = _stretches(x[q:] == x[:-q])
        enough = b - a + q >= max(least, exponent * q)
        for s, e in zip(a[enough].tolist(), b[enough].tolist()):
            keep(s, e, q)
    lag, done = 0, -1
    for m, d in _seeds(x, size, exponent):
        if d != lag:
            lag, done = d, -1
        if m >= done and m + d < len(x) and x[m] == x[m + d]:
            start, done = _reach(x, m, d, -1) + 1, _reach(x, m, d, 1)
            keep(start, done, d)
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    of = np.searchsorted(ends, out[:, 0], "right")
    start = out[:, 0] - (ends - size - 1)[of] if len(out) else out[:, 0]
    order = np.lexsort((out[:, 2], start, of))
    return of[order], start[order], out[order, 1], out[order, 2]


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """Per document: ``id, n_words, runs, collapsed``. ``runs``: every run of at least ``exponent`` (4 or more) periods and ``least``
    words, ``start`` in words from 0, by start and period; ``collapsed``: the words joined by one space, less those that some run holds after
    its first period.

    Defined cases: null and empty texts have no words, no runs and an empty text; very long texts are searched whole, for periods up to their
    length by ``exponent``; runs that overlap are told each; repeated rows, and rows that share an id, are answered once each;
    a null id stays null; an empty table gives an empty result; other columns are ignored, whatever their names."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods may hold too few grams to be seeded")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            number: dict[bytes, int] = {}
            put = number.setdefault
            words = [(t or "").encode("utf-8", "replace").split() for t in f["text"]]
            of, start, length, period = runs_of([np.fromiter((put(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words], exponent, least)
            cut = np.searchsorted(of, np.arange(len(words) + 1))
            runs, text = [], []
            for ws, i, j in zip(words, cut, cut[1:]):
                if i < j:
                    change = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(change, start[i:j] + period[i:j], 1)
                    np.add.at(change, start[i:j] + length[i:j], -1)
                    ws = [ws[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(start[i:j].tolist(), length[i:j].tolist(), period[i:j].tolist())])
                text.append(b" ".join(ws).decode())
            yield pd.DataFrame({"id": f["id"].to_numpy(), "n_words": np.array([len(w) for w in words], np.int64), "runs": runs, "collapsed": text})

    return id_out(docs.select(id_in(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id long, n_words long, runs {RUNS}, collapsed string"))
