import zlib

import numpy as np

from barloom.llm import pu_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r for r in pu_quality.quality(d, labels).collect()}
    assert len(got) == d.count()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(got[i]["score"], v) for i, v in y.items() if got[i]["held_out"]]
    pos, neg = [s for s, v in rows if v], [s for s, v in rows if not v]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.97 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_negative_and_held_out_labels_are_never_read(spark):
    sf = "/root/testdata/sf0.001"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    base = {r["id"]: r["score"] for r in pu_quality.quality(d, labels).collect()}
    flipped = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["id"]: r["score"] for r in pu_quality.quality(d, flipped).collect()} == base


def test_cases(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 400_000, "c"), (None, "text", "d"), (1, None, "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = pu_quality.quality(d, none).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 for r in got)
    assert pu_quality.quality(d.limit(0), none).count() == 0


def test_prior_is_found():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for share in (0.3, 0.8):
        u = np.concatenate([rng.normal(2, 1, int(4000 * share)), n[: int(4000 * (1 - share))]])
        assert abs(pu_quality.class_prior(p, u) - share) < 0.06


def test_risk_and_gradient_by_plain_loops():
    import math

    def risk(fp, fu, prior):
        soft = lambda z: math.log(1 + math.exp(z))
        negative = sum(map(soft, fu)) / len(fu) - prior * sum(map(soft, fp)) / len(fp)
        return prior * sum(soft(-z) for z in fp) / len(fp) + max(0.0, negative), negative

    rng = np.random.default_rng(3)
    for shift in (2.0, -9.0):  # the second makes the estimated risk of the negatives negative
        fp, fu = rng.normal(1, 1, 7), rng.normal(shift, 1, 9)
        want, negative = risk(fp, fu, 0.7)
        assert (negative < 0) == (shift < 0) and abs(pu_quality.nn_risk(fp, fu, 0.7) - want) < 1e-12
        gp, gu = pu_quality.nn_gradient(fp, fu, 0.7)
        for g, f, k in ((gp, fp, 2), (gu, fu, 5)):
            old, out = f[k], []
            for e in (1e-5, -1e-5):
                f[k] = old + e
                out.append(risk(fp, fu, 0.7)[0] if shift > 0 else -risk(fp, fu, 0.7)[1])  # below zero the step raises it
            f[k] = old
            assert abs((out[0] - out[1]) / 2e-5 - g[k]) < 1e-6


def plain_features(text):
    raw = (text or "").encode("utf-8", "replace")
    out = [0.0] * pu_quality.N_FEATURES
    c = [int(pu_quality._CLASS[b]) for b in raw]
    for k in c:
        out[256 + k] += 1 / len(raw)
    for a, b in zip(c, c[1:]):
        out[16 * a + b] += 1 / len(raw)
    w, base = raw.split(), 282 + pu_quality.SLOTS
    for x in w:
        out[282 + zlib.crc32(x) % pu_quality.SLOTS] += 1 / len(w)
    for x, y, z in zip(raw, raw[1:], raw[2:]):
        out[base + ((x << 16 | y << 8 | z) * 2654435761 % (1 << 32) >> 24)] += 1 / (len(raw) - 2)
    out = [x**0.5 for x in out]
    if w:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n, most = len(w), lambda v: max(v.count(x) for x in set(v))
        out[272:282] = [
            np.log1p(n) / 8, len(set(w)) / n, np.log(n / len(set(w))), most(w) / n, len(set(zip(w, w[1:]))) / max(n - 1, 1), sum(a == b for a, b in zip(w, w[1:])) / n,
            sum(map(len, w)) / n / 10, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, most([x[-1] for x in w]) / n,
        ]
    return out


def test_scores_by_plain_loops(spark, sf):
    """Scores of whole texts under a fixed model, computed value by value."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 800").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, " \n")], "doc_id long, text string"))
    rng = np.random.default_rng(5)
    n = pu_quality.N_FEATURES
    m = {"mean": rng.random(n), "sd": rng.random(n) + 0.5, "w1": rng.normal(0, 0.1, (n, 3)), "b1": rng.random(3), "w2": rng.random(3), "b2": rng.random(1)}
    rows = d.collect()
    got = {r["id"]: r["score"] for r in pu_quality.score(d, m).collect()}
    assert len(got) == len(rows) > 40
    for i, t in rows:
        x = [(v - a) / s for v, a, s in zip(plain_features(t), m["mean"], m["sd"])]
        z = m["b2"][0] + sum(m["w2"][k] * np.tanh(m["b1"][k] + sum(v * w for v, w in zip(x, m["w1"][:, k]))) for k in range(3))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5


def test_the_prior_corrects_the_plain_risk():
    """Scores of the non-negative risk stand on the right side of the threshold where those of positives against unlabelled do not."""
    rng = np.random.default_rng(1)
    draw = lambda n, at: rng.normal(0, 1, (n, 10)) + at * (np.arange(10) < 4)
    xp, xu, good, bad = draw(800, 1.5), np.concatenate([draw(640, 1.5), draw(160, -1.5)]), draw(300, 1.5), draw(300, -1.5)
    right = {}
    for prior in (0.8, None):
        m = pu_quality.train(xp, xu, prior, epochs=40)
        right[prior] = ((pu_quality.forward(good, m) > 0).mean() + (pu_quality.forward(bad, m) < 0).mean()) / 2
    assert right[0.8] > 0.9 and right[0.8] > right[None]


def test_clashing_columns_ties_and_shared_ids(spark):
    d = spark.createDataFrame([(i, f"text number {i % 3} with words", "x", 0.5) for i in range(30)] + [(3, "another text", "x", 0.5)], "doc_id long, text string, quality string, id double")
    labels = spark.createDataFrame([(i, 1 if i % 2 else None, "other", 0.1) for i in range(12)], "doc_id long, quality int, text string, score double")
    got = pu_quality.quality(d, labels).collect()
    assert len(got) == 31 and len({r["score"] for r in got if r["id"] % 3 == 0 and r["id"] != 3}) == 1


def test_settings_are_chosen_without_held_out_or_negative_labels(spark):
    """Held-out labels turned round, and all negative ones taken away or given at random, leave the choice and its risks as they are."""
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    grid = ((0.05, 1e-3, 4), (1.0, 1e-3, 4), (0.05, 1e-2, 2))
    held = pu_quality.held_out(F.col("doc_id"))
    base = pu_quality.choose_settings(d, labels, 200, 400, grid)
    assert set(base[1]) == set(grid) and base[0] == min(base[1], key=base[1].get)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert pu_quality.choose_settings(d, turned, 200, 400, grid) == base
    assert pu_quality.CONTENT in {s[0] for s in pu_quality.GRID} and (pu_quality.CONTENT, pu_quality.DECAY, pu_quality.EPOCHS) in pu_quality.GRID
