"""SimHash near-duplicate detection through the generalised pigeonhole principle.

The 64 bits of a fingerprint are dealt into parts, correlated bits together. If two fingerprints differ in
at most ``r`` bits and part ``i`` has the threshold ``t_i`` (-1: the part is not probed) with
``sum(t_i + 1) = r + 1``, then in at least one part they differ in at most ``t_i`` bits. Each fingerprint
gets its own thresholds: dynamic programming picks, under that sum, those with the fewest expected
candidates and probes, estimated from the frequencies of the parts' bytes over all fingerprints.

Fingerprints are dealt to shards of (part, some bits of the part); a query visits the shards that its
threshold can reach, and looks up every value within its threshold there. All candidates are verified on
the whole fingerprint. A shard returns a spanning forest of its verified links, which has the same
components as the links themselves and never more rows than documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batches, connected, id_in, joined, spent, stored

BITS = 64
#: Fingerprints that one shard indexes (about 10 MB of them), and queries that one task takes to it. The fewer the
#: shards, the fewer of them a query visits.
SHARD = 1 << 18


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included, of the text with A-Z in lower case; fewer
    words: the whole sequence; none: nothing."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, "<u8")
    n = max(1, len(w) - k + 1)
    parts = w if k == 1 else map(b" ".join, zip(*(w[j:] for j in range(k)))) if len(w) >= k else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8", count=n)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 where more than half of the hashes have it; nothing: zero."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distinct: bool = False) -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` the 64 bits as a signed long. ``distinct`` counts a repeated
    shingle once. Null and empty texts, and texts of white space, have fingerprint zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            h = (shingle_hashes(t, shingle) for t in f["text"])
            yield pd.DataFrame({"id": f["id"], "fp": np.array([signed(fingerprint(np.unique(x) if distinct else x)) for x in h], np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp long")


# --- Parts and thresholds ---------------------------------------------------------------------------


def bit_counts(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, ones per bit and joint ones per two bits: summed in tasks, 64 x 64 at the end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for f in frames:
            x = np.unpackbits(f["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pd.DataFrame({"n": [n], "both": [both.reshape(-1).astype(np.int64)]})

    parts = points.select("fp").mapInPandas(run, "n long, both array<long>")
    rows = parts.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # 4,096 rows
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["v"]
    both = both.reshape(BITS, BITS)
    return (int(rows[0]["n"]) if rows else 0), np.diag(both).copy(), both


def grouped_bits(n: int, ones: np.ndarray, both: np.ndarray) -> list[int]:
    """An order of the bits whose runs of eight hold correlated bits: from the strongest pair left, add the
    bit with the largest mean absolute correlation to the run."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, order = set(range(BITS)), []
    while left:
        own = sorted(left)
        a, b = np.unravel_index(np.argmax(corr[np.ix_(own, own)]), (len(own), len(own)))
        run = [own[a], own[b]] if a != b else own[:2]
        while len(run) < 8:
            rest = sorted(left - set(run))
            run.append(rest[int(np.argmax(corr[np.ix_(rest, run)].mean(1)))])
        order += run
        left -= set(run)
    return order


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, order], axis=1, bitorder="little").reshape(-1).view("<u8")


def parts_for(n: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of each part: parts wide enough that a value has few fingerprints at size n."""
    return [(0, 2), (2, 2), (4, 2), (6, 2)] if n <= 1 << 24 else [(0, 3), (3, 3), (6, 2)] if n <= 1 << 28 else [(0, 4), (4, 4)]


def byte_counts(points: DataFrame, order: list[int]) -> np.ndarray:
    """How often each value stands in each permuted byte: 8 x 256 counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((8, 256), np.int64)
        for f in frames:
            b = permuted(f["fp"].to_numpy(np.int64), order).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                c[j] += np.bincount(b[:, j], minlength=256)
        at = np.flatnonzero(c)
        yield pd.DataFrame({"at": at, "v": c.reshape(-1)[at]})

    out = np.zeros(8 * 256)
    for r in points.select("fp").mapInPandas(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():  # 2,048 rows
        out[r["at"]] = r["v"]
    return out.reshape(8, 256)


def distance_shares(counts: np.ndarray) -> np.ndarray:
    """[byte, value, d]: share of all fingerprints whose byte differs from the value in d bits."""
    v = np.arange(256)
    d = np.bitwise_count((v[:, None] ^ v[None, :]).astype(np.uint8))
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.stack([share @ (d == k) for k in range(9)], axis=2)


def binomial(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def thresholds(fp: np.ndarray, parts: list[tuple[int, int]], shares: np.ndarray, n: int, radius: int, probe_cost: float = 0.5) -> np.ndarray:
    """Per (permuted) fingerprint and part the threshold, -1 to ``radius``, with sum(t + 1) = radius + 1 and
    the least expected cost: candidates, by the bytes' frequencies taken as independent, plus probes."""
    b = fp.view(np.uint8).reshape(-1, 8)
    rows, most = len(fp), radius + 2
    best = np.full((rows, radius + 2), np.inf)
    best[:, 0] = 0
    back = np.zeros((len(parts), rows, radius + 2), np.int8)
    for i, (first, width) in enumerate(parts):
        dist = np.zeros((rows, radius + 1))
        dist[:, 0] = 1
        for j in range(first, first + width):
            s = shares[j, b[:, j]]
            new = np.zeros_like(dist)
            for d in range(min(8, radius) + 1):
                new[:, d:] += dist[:, : radius + 1 - d] * s[:, d : d + 1]
            dist = new
        probes = np.cumsum([binomial(8 * width, d) for d in range(radius + 1)])
        cost = np.concatenate([np.zeros((rows, 1)), n * np.cumsum(dist, 1) + probe_cost * probes], 1)  # by t + 1
        step = np.full((rows, radius + 2), np.inf)
        for have in range(most):
            for add in range(most - have):
                c = best[:, have] + cost[:, add]
                better = c < step[:, have + add]
                step[better, have + add] = c[better]
                back[i, better, have + add] = add
        best = step
    out, at, each = np.zeros((rows, len(parts)), np.int8), np.full(rows, radius + 1), np.arange(rows)
    for i in reversed(range(len(parts))):
        out[:, i] = back[i, each, at] - 1
        at = at - back[i, each, at]
    return out


def masks(bits: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << x for x in c) for c in combinations(range(bits), weight)], np.uint64) if weight else np.zeros(1, np.uint64)


# --- Search in one shard ----------------------------------------------------------------------------


class Forest:
    """Union by the smaller position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def within(ip: np.ndarray, iv: np.ndarray, qp: np.ndarray, qv: np.ndarray, qt: np.ndarray, bits: int, key_bits: int, shard: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, indexed) of all fingerprints within the radius whose part value in this shard the
    query's threshold reaches. ip, qp: fingerprints; iv, qv: the values of the part."""
    order = np.argsort(iv, kind="stable")
    values, starts = np.unique(iv[order], return_index=True)
    ends = np.append(starts[1:], len(iv))
    keys = np.uint64((1 << key_bits) - 1)
    of_key = qv & keys
    for key in np.unique(of_key):
        own = np.flatnonzero(of_key == key)
        flip = np.uint64(shard) ^ key
        for d in range(int(qt[own].max()) + 1):
            q = own[qt[own] >= d]
            for mask in (m for m in masks(bits, d) if m & keys == flip):
                v = qv[q] ^ mask
                at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                hit = np.flatnonzero(values[at] == v)
                if not len(hit):
                    continue
                lo, n = starts[at[hit]], (ends - starts)[at[hit]]
                step = max(1, int(4_000_000 * len(hit) / int(n.sum())))
                for a in range(0, len(hit), step):  # in blocks
                    z = slice(a, a + step)
                    m = n[z]
                    who = np.repeat(q[hit[z]], m)
                    idx = order[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[z], m)]
                    near = np.bitwise_count(qp[who] ^ ip[idx]) <= radius
                    if near.any():
                        yield who[near], idx[near]


def near_links(points: DataFrame, radius: int = 3, radius2: int | None = None, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)``, a < b, between the ids of ``points(id, fp[, fp2])`` whose fingerprints differ in at most
    ``radius`` bits, and their second ones, which are only verified, in at most ``radius2``: a spanning forest of each shard's links, repeated links removed. Its components are those
    of all links, and an id is in it if it has any link. ``points`` must be stored (it is read several
    times) with distinct ids."""
    n, ones, both = bit_counts(points)
    schema = "a long, b long"
    points = points.select("id", "fp", (F.col("fp2") if radius2 is not None else F.lit(0).cast("long")).alias("fp2"))
    if n == 0:
        return points.sparkSession.createDataFrame([], schema)
    order = grouped_bits(n, ones, both)
    parts = parts_for(n)
    shares = distance_shares(byte_counts(points, order))
    # A shard holds about n / 2^key_bits fingerprints; one that holds more (a hot group of near copies) is cut into blocks.
    key_bits = max(0, min(8 * min(w for _, w in parts) - 2, int(np.ceil(np.log2(max(n / shard, 1))))))

    def part_values(fp: np.ndarray, i: int) -> np.ndarray:
        first, width = parts[i]
        return (fp >> np.uint64(8 * first)) & np.uint64((1 << 8 * width) - 1)

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each fingerprint is indexed."""
        for f in frames:
            p = permuted(f["fp"].to_numpy(np.int64), order)
            for i in range(len(parts)):
                yield pd.DataFrame({"part": np.int32(i), "shard": (part_values(p, i) & np.uint64((1 << key_bits) - 1)).astype(np.int64), "id": f["id"], "fp": f["fp"], "fp2": f["fp2"]})

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which shards each fingerprint visits, and with what threshold."""
        flips = [masks(key_bits, d) for d in range(min(radius, key_bits) + 1)]
        for f in frames:
            p = permuted(f["fp"].to_numpy(np.int64), order)
            t = thresholds(p, parts, shares, n, radius)
            for i in range(len(parts)):
                own = (part_values(p, i) & np.uint64((1 << key_bits) - 1)).astype(np.int64)
                for d, ms in enumerate(flips):
                    go = np.flatnonzero(t[:, i] >= d)
                    if len(go):
                        for m in ms:
                            yield pd.DataFrame({"part": np.int32(i), "shard": own[go] ^ int(m), "id": f["id"].to_numpy()[go], "fp": f["fp"].to_numpy()[go], "fp2": f["fp2"].to_numpy()[go], "t": t[go, i].astype(np.int32)})

    keys = points.mapInPandas(held, "part int, shard long, id long, fp long, fp2 long")
    sizes = keys.groupBy("part", "shard").agg(F.ceil(F.count("*") / F.lit(2 * shard)).cast("int").alias("blocks"))
    sizes = stored(sizes, "shards")  # a row per shard
    index = keys.join(sizes, ["part", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    index = index.withColumn("role", F.lit(0)).withColumn("t", F.lit(0))
    queries = points.mapInPandas(asked, "part int, shard long, id long, fp long, fp2 long, t int")
    queries = queries.join(sizes, ["part", "shard"])
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Queries of a cut shard go to every block of the index, in blocks of their own.
    queries = queries.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).drop("blocks").withColumn("role", F.lit(1))
    index = index.join(sizes, ["part", "shard"]).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    cols = ["part", "shard", "block", "side", "role", "id", "fp", "fp2", "t"]
    rows = index.select(cols).unionByName(queries.select(cols))

    def search(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, own = int(key[0]), int(key[1])
        f = f.sort_values(["role", "id"], kind="stable")
        ix, q = f[f["role"] == 0], f[f["role"] == 1]
        if not len(ix) or not len(q):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        ids = np.unique(np.concatenate([ix["id"].to_numpy(), q["id"].to_numpy()]))
        ia, qa = np.searchsorted(ids, ix["id"].to_numpy()), np.searchsorted(ids, q["id"].to_numpy())
        ip, qp = permuted(ix["fp"].to_numpy(np.int64), order), permuted(q["fp"].to_numpy(np.int64), order)
        i2, q2 = (x["fp2"].to_numpy(np.int64).view(np.uint64) for x in (ix, q))
        forest, out = Forest(len(ids)), []
        for who, idx in within(ip, part_values(ip, i), qp, part_values(qp, i), q["t"].to_numpy(), 8 * parts[i][1], key_bits, own, radius):
            if radius2 is not None:
                near = np.bitwise_count(q2[who] ^ i2[idx]) <= radius2
                who, idx = who[near], idx[near]
            for x, y in zip(qa[who].tolist(), ia[idx].tolist()):
                if x != y and forest.join(x, y):
                    out.append((int(ids[min(x, y)]), int(ids[max(x, y)])))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("part", "shard", "block", "side").applyInPandas(search, schema).distinct()


# --- Candidates by shared bands ---------------------------------------------------------------------

#: Bands of minima of the shingles, and minima of a band: two texts of similarity s share no band with the chance
#: (1 - s^6)^40, which is 0.000005 at 0.8, whatever form their difference has.
BANDS, PER_BAND = 40, 6
_ODD, _FLIP, _JOIN, _OWN = (np.random.default_rng(17 + k).integers(0, 1 << 63, n, dtype=np.uint64) for k, n in enumerate((BANDS * PER_BAND, BANDS * PER_BAND, PER_BAND, BANDS)))
_ODD = _ODD * np.uint64(2) + np.uint64(1)
_JOIN = _JOIN * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """One key per band of a set of hashes; equal sets have equal keys."""
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 512):
        least = np.minimum(least, ((h[a : a + 512, None] ^ _FLIP) * _ODD).min(0))
    x = (least.reshape(BANDS, PER_BAND) * _JOIN).sum(1) + _OWN
    return ((x ^ (x >> np.uint64(31))) * _JOIN[0]).view(np.int64)


def close_pairs(ids: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of at most ``radius`` bits among a few documents: each one that is reached is
    compared with those not reached yet."""
    left, out = np.arange(len(ids)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            a = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[a]) <= radius
            for b in left[near].tolist():
                out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
                front.append(b)
            left = left[~near]
    return out


def band_links(points: DataFrame, radius: int, block: int = 1 << 14, shard: int = SHARD) -> DataFrame:
    """Candidate links ``(a, b)`` between the ids of ``points(id, fp2, keys)`` that share a key and whose fingerprints differ in at most
    ``radius`` bits: a spanning forest per bucket. Keys held once are dropped first, and small buckets are dealt together. All
    members of a bucket of more than ``block`` are linked with its smallest id, whatever their fingerprints: as candidates
    are decided later, that only adds some, and no two parts of a bucket need to meet."""
    rows = points.select("id", "fp2", F.explode("keys").alias("key"))
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("first")).where("k > 1"), "buckets")
    few = sizes.where(F.col("k") <= block)
    n = few.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    rows = joined(rows, stored(sizes.where(F.col("k") > block).select("key", "first"), "large-buckets"), ["key"])
    stars = rows.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    rows = rows.where("first is null").drop("first").join(few.select("key"), "key").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // shard)))))

    def search(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["key", "id"])
        ids, fp, keys = f["id"].to_numpy(), f["fp2"].to_numpy(np.int64).view(np.uint64), f["key"].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(f)]
        out: set[tuple[int, int]] = set()
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                out.update(close_pairs(ids[a:b], fp[a:b], radius))
        return pd.DataFrame(np.array(sorted(out), np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("g").applyInPandas(search, "a long, b long").unionByName(stars).distinct()


# --- Verification by shingles -----------------------------------------------------------------------


def similar_links(ids: np.ndarray, sets: list[np.ndarray], least: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few documents: a Jaccard similarity of the sets of at least ``least``, from
    exact counts. Documents with equal ``known`` are linked already."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first, mark = np.cumsum(size) - size, np.zeros(len(flat) + 1, np.int64)
    group, out = np.arange(len(ids)) if known is None else np.unique(known, return_inverse=True)[1], []
    for a in range(len(ids) - 1):
        # What is linked already needs no other link.
        b = a + 1 + np.flatnonzero(group[a + 1 :] != group[a])
        b = b[(np.minimum(size[b], size[a]) >= least * np.maximum(size[b], size[a])) & (size[b] > 0)]
        if not len(b) or not size[a]:
            continue
        own = flat[first[a] : first[a] + size[a]]
        mark[own] = 1
        n = size[b]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[b], n)
        both = np.add.reduceat(mark[flat[at]], np.cumsum(n) - n)
        mark[own] = 0
        for k in b[both >= least * (size[a] + n - both)].tolist():
            if group[a] != group[k]:
                group[group == group[k]] = group[a]
                out.append((int(min(ids[a], ids[k])), int(max(ids[a], ids[k]))))
    return out


def _dealt(rows: DataFrame, verify, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).applyInPandas(verify, "a long, b long").distinct()


def verified_links(points: DataFrame, least: float, block: int = 1500, weight: int = 2_000_000) -> DataFrame:
    """Links ``(a, b)`` within candidate groups: ``points(id, component, sh)``, stored, to spanning forests. A task holds
    about ``block`` documents and ``weight`` shingles, or twice that.

    Small groups are dealt together. A larger group is cut into blocks. First each block is searched together with the group's
    smallest id, which links the parts of a group of real copies. Then only what is outside the group's largest class meets all its
    blocks: each of these documents with every document of another class, so no link between two classes is missed. The cost
    beyond one pass is that of the outsiders times the group; it is that of all pairs of blocks only for a large group
    without a large class."""
    size = F.size("sh")
    n, total = points.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    tasks = max(1, -(-n // block), -(-total // weight))
    cuts = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(size) / F.lit(weight))).cast("int")
    large = points.groupBy("component").agg(cuts.alias("blocks"), F.min("id").alias("first")).where("blocks > 1")
    large = stored(large, "large-groups")
    rows = joined(points, large, ["component"])
    small = rows.where("blocks is null").select("component", "id", "sh").withColumn("g", F.pmod(F.xxhash64("component"), F.lit(tasks)))

    def verify(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, own in f.sort_values(["component", "id"]).groupby("component", sort=False):
            out += similar_links(own["id"].to_numpy(), list(own["sh"]), least)
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    links = _dealt(small, verify, ["g"])
    if large.isEmpty():
        return links
    own = rows.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    heads = own.where("id = first").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["component", "block", "id", "sh"]
    first = own.where("id <> first").select(cols).unionByName(heads.select(cols))
    links = stored(links.unionByName(_dealt(first, verify, ["component", "block"])), "links")

    # Classes so far within the large groups, and what lies outside the largest class of each.
    members = stored(own.select("component", "id", "blocks"), "members")
    classes = connected(members.select("id"), links.join(members.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b"))
    classes = stored(members.join(classes.select("id", F.col("component").alias("class")), "id"), "classes")
    sizes = classes.groupBy("component", "class").agg(F.count("*").alias("k"))
    main = stored(sizes.groupBy("component").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most")).where("n > most"), "main-classes")
    if main.isEmpty():
        return links
    main = main.withColumn("askers", F.ceil((F.col("n") - F.col("most")) / F.lit(block)).cast("int"))
    left = joined(classes, main.select("component", "main", "askers"), ["component"]).where("main is not null").join(points.select("id", "sh"), "id")
    left = left.withColumn("i", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("askers").cast("long")).cast("int")).withColumn("j", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    cols = ["component", "i", "j", "id", "class", "sh"]
    asked = left.where("class <> main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cols)
    met = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).select(cols)

    def across(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("id").sort_values("id")
        out = similar_links(f["id"].to_numpy(), list(f["sh"]), least, f["class"].to_numpy())
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return links.unionByName(_dealt(asked.unionByName(met), across, ["component", "i", "j"]))


# --- Operators --------------------------------------------------------------------------------------


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fp, component)`` per row: the smallest id reachable over links of at most ``radius`` bits.

    The nodes are the distinct fingerprints, so rows of one fingerprint are linked whatever their ids.
    Null, empty and white-space
    texts have fingerprint zero and are linked like any other; very long texts are read whole; rows that share an id are rows of their own, each in the
    class of its text; a row with a null id belongs to the class of its fingerprint too, but gives it no name (a class of null
    ids alone has a null one); an empty table gives an empty result; other columns are ignored."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = stored(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("k")), "points")
    nodes = points.select(F.col("fp").alias("id"), "fp")
    links = stored(near_links(nodes, radius), "links")
    touched = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    labels = connected(touched, links).join(points.select(F.col("fp").alias("id"), "first"), "id")
    names = labels.groupBy("component").agg(F.min("first").alias("least"))
    linked = stored(labels.join(names, "component").select(F.col("id").alias("fp"), "least"), "linked")
    # A row whose fingerprint no other row has or is linked with is its own class.
    shared = points.where("k > 1").select("fp", "first").join(linked, "fp", "full").select("fp", F.coalesce("least", "first").alias("least"), F.lit(True).alias("some"))
    return joined(fps, stored(shared, "shared"), ["fp"]).select("id", "fp", F.when(F.col("some"), F.col("least")).otherwise(F.col("id")).alias("component"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, min_jaccard: float = 0.8, radius: int = 10, radius2: int = 18, band_radius: int = 26) -> DataFrame:
    """``(id, component)`` per row for rows linked with another: a Jaccard similarity of the distinct ``shingle``-word
    shingles of at least ``min_jaccard``; ``component`` is the smallest id of the class.

    The nodes are the distinct sets of shingles, so equal texts are one node whatever their number. Candidates are found in two
    ways and united. The fingerprint of the distinct words is probed within ``radius``
    bits and verified on that of the distinct shingles (``radius2``): this finds scattered edits of single words, not
    every passage added or cut, which moves the words' fingerprint by more. So texts that share a band of
    minima of their shingles are candidates too, whatever form their difference has, if the fingerprints of the
    shingles lie within ``band_radius`` bits (at similarity 0.8 the distance is 9.7 bits with deviation 2.9; of texts
    of five shingles 12 with 3.1). All are decided on the shingles alone. A node is named by a 64-bit hash of its set.

    Defined cases: null and empty texts, and texts without words, are never near copies of anything; very long texts are read
    whole; rows that share an id are rows of their own, each in the class of its text; a null id is a row like others, but names no class (a class of null ids alone has
    the name null); an empty table gives an empty result; other columns are ignored."""

    def prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in f["text"]]
            some = [i for i, x in enumerate(sets) if len(x)]
            text, sets = f["text"].to_numpy(), [sets[i] for i in some]
            yield pd.DataFrame({
                "id": f["id"].to_numpy()[some], "node": np.array([signed(xxhash.xxh64_intdigest(x.tobytes(), 7)) for x in sets], np.int64),
                "fp": np.array([signed(fingerprint(np.unique(shingle_hashes(text[i], 1)))) for i in some], np.int64),
                "fp2": np.array([signed(fingerprint(x)) for x in sets], np.int64), "keys": pd.Series([bands(x) for x in sets], dtype=object),
            })

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = stored(rows.mapInPandas(prints, "id long, node long, fp long, fp2 long, keys array<long>"), "fingerprints")
    nodes = fps.groupBy(F.col("node").alias("id")).agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.first("keys").alias("keys"), F.max("id").alias("row"), F.count("*").alias("k"))
    nodes = stored(nodes, "nodes")
    # Candidate groups: nodes without any candidate are out, the others meet only within their group.
    links = stored(near_links(nodes.select("id", "fp", "fp2"), radius, radius2).unionByName(band_links(nodes, band_radius)), "candidates")
    touched = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    groups = stored(connected(touched, links), "candidate-groups")
    read = stored(nodes.join(groups, "id").select(F.col("row").alias("id")).distinct(), "candidate-rows")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            own = [np.unique(shingle_hashes(t, shingle)) for t in f["text"]]
            yield pd.DataFrame({"id": np.array([signed(xxhash.xxh64_intdigest(x.tobytes(), 7)) for x in own], np.int64), "sh": [x.view(np.int64) for x in own]})

    found = joined(rows, read, ["id"], "left_semi").mapInPandas(sets, "id long, sh array<long>").dropDuplicates(["id"])
    points = stored(found.join(groups, "id"), "points")
    sure = stored(verified_links(points, min_jaccard), "links")
    touched = sure.select(F.col("a").alias("id")).unionByName(sure.select(F.col("b").alias("id"))).distinct()
    labels = stored(connected(touched, sure).withColumnRenamed("id", "node").withColumnRenamed("component", "class"), "labels")
    some = nodes.where("k > 1").select(F.col("id").alias("node")).join(labels, "node", "full").select("node", F.coalesce("class", "node").alias("class"))
    out = joined(fps.select("id", "node"), stored(some, "classes"), ["node"]).where("class is not null")
    names = out.groupBy("class").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("component"))
    out = stored(out.select("id", "class"), "rows")
    spent(points, read)
    return joined(out, stored(names, "names"), ["class"]).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "component")
