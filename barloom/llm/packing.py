"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces go to groups of bounded size by a hash of their identity and, where rows are equal, of a number within
them, so no key, however frequent, makes a group large. A group is packed by best fit on falling lengths; the local search then moves, exchanges
one for one and two for one between underfull sequences whenever that raises the sum of squared fills, until
sequences become empty. What groups leave in sequences that are not nearly full is packed again together, in groups of
the same bounded size, until one group holds it or it becomes no fewer sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import batches, id_in, id_out, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``most`` tokens of every text and its end id; only longer texts are cut, and of
    their pieces only the first is shorter. Null text: empty, one piece with the end id alone. A null id is
    ``NO_ID`` here, for ``pack_documents`` to turn back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text", 8_000_000):
            e = encode(f["text"].tolist(), tokenizer)
            rows = []
            for i, doc in enumerate(f["id"]):
                ids = np.append(e.ids[e.bounds[i] : e.bounds[i + 1]], end_id).astype("<u4")
                head = len(ids) % most or most
                cuts = [0, *range(head, len(ids) + 1, most)] if head < len(ids) else [0, len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_in(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Positions of the pieces of each bin, each piece put into the fullest bin that can take it."""
    by_room: dict[int, list[int]] = defaultdict(list)
    bins: list[list[int]] = []
    room_mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = room_mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                room_mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = most, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            room_mask |= 1 << (room - n)
    return bins


class Places:
    """The underfull bins by what they can take: ``mask[room]`` has bit y set where some bin with that room holds a piece of
    length y to give back, and bit 0 for a bin that need give none. Entries whose bin has changed since are dropped when met."""

    def __init__(self, count: int) -> None:
        self.mask: dict[int, int] = {}
        self.held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.version = [0] * count

    def put(self, k: int, room: int, pieces: list[int], size: list[int]) -> None:
        self.version[k] += 1
        if room > 0:
            for i, y in [(-1, 0), *((i, size[i]) for i in pieces)]:
                self.held.setdefault((room, y), []).append((k, self.version[k], i))
                self.mask[room] = self.mask.get(room, 0) | 1 << y

    def take(self, k: int) -> None:
        self.version[k] += 1

    def best(self, n: int, most_room: int, above: int) -> tuple[int, int, int]:
        """(gain, bin, piece to give back or -1) of the largest gain over ``above`` of putting ``n`` tokens into a bin of at most
        ``most_room``; gain ``above`` where there is none."""
        out = (above, -1, -1)
        for room in list(self.mask):
            if room > most_room or min(room, n) <= out[0]:
                continue
            low = max(0, n - room)
            while fits := self.mask[room] >> low:
                y = low + (fits & -fits).bit_length() - 1
                if n - y <= out[0]:
                    break
                own = self.held[room, y]
                while own and self.version[own[-1][0]] != own[-1][1]:
                    own.pop()
                if own:
                    out = (n - y, own[-1][0], own[-1][2])
                    break
                self.mask[room] &= ~(1 << y)
        return out


def local_search(bins: list[list[int]], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Empties bins: takes the emptiest one and passes its pieces to fuller underfull bins, moving a piece or two
    that fit, or exchanging one or two of its pieces for one smaller piece there, the exchange that fills most first, so that the sum of squared
    fills rises with each step. Ends when the bins are as few as their contents allow, or a round over all bins finds no step; as the sum rises with each, that comes."""
    size = [int(x) for x in lengths]
    bins = [list(b) for b in bins if b]
    fill = [sum(size[i] for i in b) for b in bins]
    least, live = -(-sum(fill) // most), len(bins)
    places = Places(len(bins))
    for k, b in enumerate(bins):
        places.put(k, most - fill[k], b, size)
    changed = True
    while changed and live > least:
        changed = False
        for src in sorted((k for k in range(len(bins)) if bins[k] and fill[k] < most), key=lambda k: fill[k]):
            places.take(src)
            while bins[src] and live > least:
                own = sorted(bins[src], key=lambda i: -size[i])
                gain, t, back, out = 0, -1, -1, ()
                tried = set()
                for x, i in enumerate(own):
                    for give in ((i,), *((i, j) for j in own[x + 1 :])):
                        n = sum(size[g] for g in give)
                        if n <= most and n not in tried:
                            tried.add(n)
                            got = places.best(n, most - fill[src], gain)
                            if got[0] > gain:
                                (gain, t, back), out = got, give
                if t < 0:
                    break
                for i in out:
                    bins[src].remove(i)
                    bins[t].append(i)
                if back >= 0:
                    bins[t].remove(back)
                    bins[src].append(back)
                fill[src] -= gain
                fill[t] += gain
                places.put(t, most - fill[t], bins[t], size)
                live -= not bins[src]
                changed = True
            if live <= least:
                break
            if bins[src]:
                places.put(src, most - fill[src], bins[src], size)
    return [b for b in bins if b]


def dealt(rows: DataFrame, level: int, group: int) -> DataFrame:
    """Adds the group ``g`` to pieces. Equal rows are counted and numbered again, so that they spread over all groups
    whichever tasks hold them; rows that only share ``doc_id`` and ``piece`` differ in their checksums."""
    n = rows.count()
    base = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Two steps, so that no array grows with the number of equal rows.
    rows = rows.groupBy(*base).agg(F.count("*").alias("k")).withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("k") - 1, 12))))
    rows = rows.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), F.col("k") - 1 - F.col("high") * 4096))))
    return rows.select(*base, F.pmod(F.xxhash64(*base, "high", "low", F.lit(level)), F.lit(max(1, -(-n // group)))).alias("g"))


def pack_pieces(pieces: DataFrame, most: int = 1024, group: int = 16384, good: float = 0.995) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0) to ``pieces`` (stored; see ``token_pieces``). What lies in sequences
    less than ``good`` full is dealt and packed again, as long as it fills several groups and becomes fewer sequences."""
    base = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pieces.select(base).schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long, fill long"

    def packer(level: int):
        def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(base).reset_index(drop=True)
            lengths = f["length"].to_numpy(np.int64)
            bins = local_search(best_fit(lengths, most), lengths, most)
            at = np.concatenate([np.array(b, np.int64) for b in bins])
            n = np.array([len(b) for b in bins])
            f = f.iloc[at].drop(columns=["g"]).reset_index(drop=True)
            of = np.repeat(np.arange(len(bins)), n)
            run_ = np.cumsum(f["length"].to_numpy()) - f["length"].to_numpy()
            fills = np.bincount(of, weights=f["length"]).astype(np.int64)
            starts = np.cumsum(fills) - fills
            # Groups have about `group` pieces, so their sequences never come near 2^24; there are fewer than 2^32 groups.
            f["sequence_id"] = ((level << 56) + (int(key[0]) << 24) + of).astype(np.int64)
            f["offset"], f["fill"] = run_ - starts[of], fills[of]
            return f

        return run

    def packed(rows: DataFrame, level: int) -> DataFrame:
        rows = dealt(rows, level, group)
        # Groups are dealt by number, several to a task; a group has about `group` pieces at every size.
        return stored(rows.groupBy("g").applyInPandas(packer(level), schema), f"packed{level}")

    def poor(df: DataFrame) -> DataFrame:
        return df.where(F.col("fill") < int(good * most))

    out, now, level = [], packed(pieces, 0), 0
    while True:
        # Offset 0 stands once in each sequence.
        rows, bins = poor(now).agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).first()
        if level and (few or bins >= 0.9 * last):
            break
        few, last = rows <= group, bins or 0
        if not rows:
            break
        out.append(now.where(F.col("fill") >= int(good * most)))
        level += 1
        now = packed(poor(now).select(base), level)
    for df in out:
        now = now.unionByName(df)
    return now.select(*base, "sequence_id", "offset", "fill")


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in as few sequences of at most ``most`` tokens as the search finds: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, fill``.

    Defined cases: null and empty texts are one piece of one token (the end id); very long texts are encoded whole and cut into pieces; repeated rows are packed
    once each (with equal doc_id and piece), rows that share an id with their own pieces each; of bins that would fill equally, any may be taken; a null id is packed with a null id; an empty table gives an empty
    result; other columns are ignored, whatever their names."""
    return id_out(pack_pieces(stored(token_pieces(docs, tokenizer, most, end_id, id_col, text_col), "pieces"), most), "doc_id")
