import random

import numpy as np
import xxhash

from barloom.llm import simhash


def plain(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "f") for i, t in rows], "doc_id long, text string, fp long, component string")


def test_fingerprints(spark):
    rows = [(1, "The quick brown fox"), (2, "the QUICK brown fox"), (3, "one two"), (4, ""), (5, None), (6, " \n"), (7, "É a b c d"), (8, "a b c " * 3000)]
    got = {r["id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs(spark, rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_classes_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, "")]
    fp = {i: plain(t) for i, t in rows}
    ids = sorted(fp)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r["id"]: r["component"] for r in simhash.simhash_classes(docs(spark, rows)).collect()} == want


def test_links_of_any_radius_and_cut_shards(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(12)})
    signed = [simhash.signed(x) for x in fps]
    points = spark.createDataFrame(list(enumerate(signed)), "id long, fp long").cache()
    for radius, shard in ((3, 1 << 15), (5, 40), (8, 25)):
        links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
        got = [tuple(r) for r in simhash.near_links(points, radius, shard=shard).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in got)
        assert components(range(len(fps)), got) == components(range(len(fps)), links)


def test_thresholds_add_up():
    fp = np.random.default_rng(1).integers(0, 1 << 63, 50).astype("<u8")
    shares = simhash.distance_shares(np.random.default_rng(2).random((8, 256)))
    for parts in (simhash.parts_for(10), simhash.parts_for(1 << 25), simhash.parts_for(1 << 30)):
        for r in (0, 3, 10):
            t = simhash.thresholds(fp, parts, shares, 10_000, r)
            assert (t.astype(int) + 1).sum(1).tolist() == [r + 1] * 50 and t.min() >= -1


def test_near_copies(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    text = [rng.choice(words) for _ in range(200)]
    near, far = list(text), list(text)
    near[50] = near[120] = "changed"
    for k in range(0, 200, 12):
        far[k] = f"new{k}"
    rows = [(5, " ".join(text)), (3, " ".join(near)), (4, " ".join(far)), (9, " ".join(rng.choice(words) for _ in range(200))), (10, None), (11, "")]
    got = {r["id"]: r["component"] for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert got[5] == got[3] == 3 and got.get(4, 4) == 4 and got.get(9, 9) == 9 and 10 not in got
    assert simhash.near_copies(docs(spark, [])).count() == 0 and simhash.simhash_classes(docs(spark, [])).count() == 0


def test_cut_groups_agree(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(40) for _ in range(60)]
    rows = []
    for i in range(80):
        s = list(base)
        for _ in range(rng.randint(0, 9)):
            s[rng.randrange(60)] = rng.getrandbits(40)
        rows.append((i, 7, 0, sorted(set(s))))
    points = spark.createDataFrame(rows, "id long, component long, fp long, sh array<long>").cache()
    want = components(range(80), [(a, b) for a in range(80) for b in range(a) if len(set(rows[a][3]) & set(rows[b][3])) >= 0.8 * len(set(rows[a][3]) | set(rows[b][3]))])
    for block in (1000, 15, 4):
        assert components(range(80), [tuple(r) for r in simhash.verified_links(points, 0.8, block).collect()]) == want


def edited(rng, text, kind):
    """A near copy of some degree: a fifth of the words or less differs."""
    n, new = len(text), lambda k: [f"w{rng.getrandbits(30)}" for _ in range(k)]
    k = int(n * rng.choice((0.05, 0.1, 0.15, 0.19)))
    if kind == "appended":
        return text + new(k)
    if kind == "put before":
        return new(k) + text
    if kind == "cut":
        return text[: n - k]
    if kind == "tail rewritten":
        return text[: n - k // 2] + new(k // 2)
    if kind == "parts exchanged":
        return text[n // 3 :] + text[: n // 3]
    out = list(text)
    for i in rng.sample(range(n), max(1, n // 50)):
        out[i] = new(1)[0]
    return out


def test_near_copies_by_length_and_edit(spark):
    """Of the pairs of similarity 0.8 or more, of each length and each kind of edit, at least 0.95 are found, and no others."""
    rng = random.Random(11)
    rows, want, of = [], set(), {}
    for length in (12, 40, 120, 400, 1500):
        for kind in ("appended", "put before", "cut", "tail rewritten", "parts exchanged", "scattered"):
            for _ in range(25):
                text = [f"w{rng.getrandbits(30)}" for _ in range(length)]
                other = edited(rng, text, kind)
                x, y = (set(zip(*(t[j:] for j in range(5)))) for t in (text, other))
                k = len(rows) // 2
                rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
                of[2 * k + 1] = length, kind
                if len(x & y) >= 0.8 * len(x | y):
                    want.add(2 * k + 1)
    got = {r["id"] for r in simhash.near_copies(docs(spark, rows)).collect() if r["id"] != r["component"]}
    assert got <= want and len(want) > 500
    for cell in set(of.values()):
        own = {i for i in want if of[i] == cell}
        assert len(own & got) >= 0.95 * len(own), (cell, len(own & got), len(own))


def test_near_copies_of_a_large_group(spark, monkeypatch):
    """A group of near copies far over the block size, with a few classes that only its members link, equals brute force; the
    buckets over their block size only add candidates."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        t = list(base)
        for k in range(rng.choice((1, 1, 2, 3))):
            t[rng.randrange(80)] = f"v{rng.getrandbits(20)}"
        rows.append((i, " ".join(t[: rng.choice((80, 75, 70, 64, 60))])))
    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for _, t in rows]
    want = components(range(300), [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    whole, links = simhash.verified_links, simhash.band_links
    monkeypatch.setattr(simhash, "verified_links", lambda p, least: whole(p, least, 30))
    monkeypatch.setattr(simhash, "band_links", lambda p, radius: links(p, radius, 20))
    got = {r["id"]: r["component"] for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert {i: got.get(i, i) for i in range(300)} == want and len(set(want.values())) > 1


def test_near_copies_of_rows_that_share_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (7, "another text altogether with some words of its own"), (4, text + " more"), (None, text), (None, text.upper()), (8, "x"), (8, "x")]
    got = sorted(((r["id"], r["component"]) for r in simhash.near_copies(docs(spark, rows)).collect()), key=str)
    assert got == [(4, 4), (7, 4), (8, 8), (8, 8), (None, 4), (None, 4)]
