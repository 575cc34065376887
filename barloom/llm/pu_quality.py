"""Quality classification by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network on the non-negative unbiased risk
(Kiryo et al. 2017) with logistic loss, given the share of positives among the unlabelled. That share is
estimated first (best bin estimation, Garg et al. 2021): of a classifier between positives and
unlabelled, the lowest ratio of the two tails over all cuts on rows it did not see bounds the share from above.
Labels of the other class are never read. Features are counts over the whole text: of classes of bytes and their pairs, of hashed
words and byte trigrams, and measures of length and repetition.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_sample, id_in, id_out

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "*", "#", "%", "&", "$", "|", "'\"()[]{}<>/-_=+@\\^`~", "\t\r\x0b\x0c")
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
#: Slots that words and byte trigrams are hashed to.
SLOTS = 256
N_FEATURES = 256 + 16 + 10 + 2 * SLOTS
#: Weight of the features of content, decay and epochs: what ``choose`` picks of GRID on sf0.1 (``python -m barloom.llm.pu_quality``).
CONTENT, DECAY, EPOCHS = 0.05, 1e-3, 15
GRID = tuple((content, decay, epochs) for content in (1.0, 0.3, 0.1, 0.05) for decay in (1e-3, 1e-2) for epochs in (8, 15))


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of pairs of neighbouring classes, measures of length and repetition, and shares of hashed words
    and of hashed byte trigrams, over the whole text. The empty text gives zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    codes = np.frombuffer(raw, np.uint8)
    c = _CLASS[codes]
    out[:256] = np.sqrt(np.bincount(c[:-1].astype(np.int64) * 16 + c[1:], minlength=256) / len(c))
    out[256:272] = np.sqrt(np.bincount(c, minlength=16) / len(c))
    w = raw.split()
    if w:
        n, seen, lines = len(w), Counter(w), [x for x in raw.split(b"\n") if x.strip()]
        pairs = len(set(zip(w, w[1:])))
        alike = sum(map(bytes.__eq__, w, w[1:]))
        ends = Counter(x[-1] for x in w)
        out[272:282] = (
            math.log1p(n) / 8, len(seen) / n, math.log(n / len(seen)), max(seen.values()) / n, pairs / max(n - 1, 1), alike / n,
            sum(map(len, w)) / n / 10, len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 5, max(ends.values()) / n,
        )
        slots = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % SLOTS
        out[282 : 282 + SLOTS] = np.sqrt(np.bincount(slots, weights=np.fromiter(seen.values(), np.float64, len(seen)), minlength=SLOTS) / n)
    if len(codes) > 2:
        b = codes.astype(np.uint32)
        grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(24)
        out[282 + SLOTS :] = np.sqrt(np.bincount(grams, minlength=SLOTS) / len(grams))
    return out


def forward(x: np.ndarray, m: dict) -> np.ndarray:
    return np.tanh(((x - m["mean"]) / m["sd"]) @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"]


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk of outputs on positives and unlabelled rows, logistic loss."""
    soft = lambda z: np.logaddexp(0, z).mean()
    return float(prior * soft(-fp) + max(0.0, soft(fu) - prior * soft(fp)))


def nn_gradient(fp: np.ndarray, fu: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The step's gradient by the outputs: that of the risk while the estimated risk of the negatives is not below zero, else
    the one that raises it again; without a prior, that of the plain risk of positives against unlabelled."""
    soft = lambda z: np.logaddexp(0, z).mean()
    if prior is None:
        return -_sig(-fp) / len(fp), _sig(fu) / len(fu)
    if soft(fu) - prior * soft(fp) >= 0:
        return prior * (-_sig(-fp) - _sig(fp)) / len(fp), _sig(fu) / len(fu)
    return prior * _sig(fp) / len(fp), -_sig(fu) / len(fu)


def train(xp: np.ndarray, xu: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = EPOCHS, rate: float = 0.01, decay: float = DECAY, seed: int = 7, content: float = CONTENT) -> dict:
    """Adam on the non-negative risk with the prior, or, without one, on the plain risk of positives against
    unlabelled."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([xp, xu])
    # The many sparse features of content may weigh less, so that they cannot learn the rows by heart.
    weight = np.where(np.arange(x.shape[1]) < N_FEATURES - 2 * SLOTS, 1.0, content)
    mean = x.mean(0, dtype=np.float64)
    sd = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean**2, 0))
    del x
    m = {"mean": mean.astype(xp.dtype), "sd": ((sd + 0.02) / weight).astype(xp.dtype), "w1": rng.normal(0, 1 / math.sqrt(xp.shape[1]), (xp.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.3, hidden), "b2": np.zeros(1)}
    names = ("w1", "b1", "w2", "b2")
    mom, sq, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    zp, zu = (xp - m["mean"]) / m["sd"], (xu - m["mean"]) / m["sd"]
    size = 256
    for _ in range(epochs):
        ip, iu = rng.permutation(len(zp)), rng.permutation(len(zu))
        for k in range(max(1, max(len(zp), len(zu)) // size)):
            a, b = zp[np.take(ip, range(k * size, k * size + size), mode="wrap")], zu[np.take(iu, range(k * size, k * size + size), mode="wrap")]
            z = np.concatenate([a, b])
            h = np.tanh(z @ m["w1"] + m["b1"])
            f = h @ m["w2"] + m["b2"]
            g = np.concatenate(nn_gradient(f[: len(a)], f[len(a) :], prior))
            dh = np.outer(g, m["w2"]) * (1 - h * h)
            grad = {"w1": z.T @ dh + decay * m["w1"], "b1": dh.sum(0), "w2": h.T @ g + decay * m["w2"], "b2": np.array([g.sum()])}
            step += 1
            for n in names:
                mom[n] = 0.9 * mom[n] + 0.1 * grad[n]
                sq[n] = 0.999 * sq[n] + 0.001 * grad[n] ** 2
                m[n] -= rate * (mom[n] / (1 - 0.9**step)) / (np.sqrt(sq[n] / (1 - 0.999**step)) + 1e-8)
    return m


def class_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Share of positives among the unlabelled from the scores of both on unseen rows: the lowest upper bound
    of the ratio of their tails over all cuts that keep enough positives."""
    cuts = np.sort(sp)
    qp = 1 - np.searchsorted(cuts, cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(su)
    slack = np.sqrt(math.log(20) / (2 * len(su))) + np.sqrt(math.log(20) / (2 * len(sp)))
    keep = qp > 0.05
    k = np.flatnonzero(keep)[np.argmin((qu[keep] + slack) / qp[keep])]
    return float(np.clip(qu[k] / qp[k], 0.05, 0.98))


def choose(xp: np.ndarray, xu: np.ndarray, grid: tuple = GRID, folds: int = 2) -> tuple[tuple[float, float, int], dict]:
    """The setting of ``grid`` with the least non-negative risk on rows left out, and the risks of all, from positives and unlabelled rows alone: each fold is
    left out in turn, and the prior, the median of what all settings estimate, comes from the rest. No label of the other class, and no held-out one, has a
    part in it."""
    risk = dict.fromkeys(grid, 0.0)
    for k in range(folds):
        p, u = np.arange(len(xp)) % folds == k, np.arange(len(xu)) % folds == k
        tp, tu = xp[~p], xu[~u]

        def own(setting: tuple, a: np.ndarray, b: np.ndarray, prior: float | None) -> dict:
            return train(a, b, prior, content=setting[0], decay=setting[1], epochs=setting[2])

        priors = []
        for setting in grid:
            first = own(setting, tp[0::2], tu[0::2], None)
            priors.append(class_prior(forward(tp[1::2], first), forward(tu[1::2], first)))
        prior = float(np.median(priors))
        for setting in grid:
            m = own(setting, tp, tu, prior)
            risk[setting] += nn_risk(forward(xp[p], m), forward(xu[u], m), prior) / folds
    return min(grid, key=lambda s: risk[s]), risk


def sources(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """Ids ``(id)`` of the positives and of the unlabelled rows that are not held out."""
    mark = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y is not null")
    free = ~held_out(F.col("id"), folds)
    unlabelled = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & free).join(mark, "id", "left_anti")
    return mark.where((F.col("y") == 1) & free).select("id"), unlabelled


def choose_settings(docs: DataFrame, labels: DataFrame, sample_positive: int = 2000, sample_unlabelled: int = 4000, grid: tuple = GRID) -> tuple[tuple[float, float, int], dict]:
    """``choose`` on bounded samples of a corpus, as ``fit`` takes them."""
    positive, unlabelled = sources(docs, labels)
    return choose(_sample(docs, positive, sample_positive, "doc_id", "text"), _sample(docs, unlabelled, sample_unlabelled, "doc_id", "text"), grid)


def _sample(docs: DataFrame, ids: DataFrame, rows: int, id_col: str, text_col: str) -> np.ndarray:
    """Features of the rows with the smallest hashes of ``ids``, one per id and at most ``rows`` of them."""
    few = hash_sample(ids, rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            yield pd.DataFrame({"id": f["id"], "x": [features(t).tobytes() for t in f["text"]]})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").mapInPandas(run, "id long, x binary")
    # One row per id, however many share it: the least by its features.
    got = found.groupBy("id").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    return np.stack([np.frombuffer(x, np.float32) for x in got["x"]]) if len(got) else np.empty((0, N_FEATURES), np.float32)


def fit(docs: DataFrame, positive_ids: DataFrame, unlabelled_ids: DataFrame, sample_positive: int = 4000, sample_unlabelled: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from bounded samples: at most ``sample_positive`` and ``sample_unlabelled`` rows, those with the
    smallest hashes of their ids. Without positives or unlabelled rows the model scores everything 0.5."""
    xp, xu = (_sample(docs, i, n, id_col, text_col) for i, n in ((positive_ids, sample_positive), (unlabelled_ids, sample_unlabelled)))
    if not len(xp) or not len(xu):
        return {"mean": np.zeros(N_FEATURES), "sd": np.ones(N_FEATURES), "w1": np.zeros((N_FEATURES, 1)), "b1": np.zeros(1), "w2": np.zeros(1), "b2": np.zeros(1), "prior": 0.5}
    first = train(xp[0::2], xu[0::2], None)
    even = forward(xp[1::2] if len(xp) > 1 else xp, first), forward(xu[1::2] if len(xu) > 1 else xu, first)
    prior = class_prior(*even)
    return train(xp, xu, prior) | {"prior": prior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per row: the estimated probability that its whole text is of the positive class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            z = forward(np.stack([features(t) for t in f["text"]]).astype(np.float64), model)
            yield pd.DataFrame({"id": f["id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return id_out(docs.select(id_in(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, score double"))


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % folds == 0


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **sizes) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``; ids with crc32 divisible by ``folds`` are held
    out: nothing is learnt from them, labelled or not.

    Defined cases: null and empty texts are scored like any other (all features zero); null ids are not held out
    and never learnt from; very long texts are read whole; repeated rows, and rows that share an id, get the score of their own text each (one of an id's texts is learnt
    from at most); equal texts have equal scores; an empty table gives an empty result; null labels
    count as none; other columns, clashing or not, are never read."""
    positive, unlabelled = sources(docs, labels, folds, id_col, label_col)
    model = fit(docs, positive, unlabelled, id_col=id_col, text_col=text_col, **sizes)
    out = score(docs, model, id_col, text_col)
    return out.select("id", F.coalesce(held_out(F.col("id"), folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    _spark = SparkSession.builder.getOrCreate()
    _best, _risk = choose_settings(*(_spark.read.parquet(f"{sys.argv[1]}/{t}.parquet") for t in ("documents", "labels")))
    print("\n".join(f"{r:.5f} {s}" for s, r in sorted(_risk.items(), key=lambda x: x[1])), _best, sep="\n")
