"""Token-id files: each document's ids compressed by itself with a zstandard dictionary that all share.

A folder holds the dictionary, named by its hash, and files in ascending order of ids. A file is a header with the hash of its
dictionary, one frame per document, an index (id, offset, tokens of each document) and a footer that tells where the index is; so a single short document
is read by two small ranges, and a file tells by itself what it holds. All numbers are little-endian.

Documents are sorted by id in range partitions; equal ids are told apart by the hash of their text and a number, so a hot id is cut like any other.
Each task writes files of its own, named anew by each attempt; what counts is the table of files that the attempts that succeeded return.
Files are opened through pyarrow's file systems, by the folder's own scheme.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _byte_of
from .common import NO_ID, batches, id_in, id_out, stored
from .warc import open_store

MAGIC, END = b"IDFILE01", b"IDFILEIX"
HEADER, FOOTER = struct.Struct("<8sB32s"), struct.Struct("<QQQQI8s")
#: Bytes of the dictionary at most, bytes at which a file is closed, and bytes of frames that one task reads.
DICTIONARY, FILE_BYTES, SLICE = 112_640, 64 << 20, 8 << 20
FILES = "file string, first struct<id:bigint,h:bigint,r:bigint>, bytes long, docs long, tokens long"


class WordEncoder:
    """Ids of whole texts by the ``tokenizers`` library, for files that normalise by NFC, one space for white space and lower case, and split off
    words before they merge within them. White space of ASCII then ends a word whatever surrounds it, so a text's ids are those of its pieces
    between such white space, each looked up once. A piece of ASCII and letters up to U+00FF is its own normal form but for case, and is split
    by the file's pattern here; the library's model merges its words. Any other piece, and a text with an added token, goes through the whole library.

    Other files are used as they are, text by text."""

    #: Pieces and words that are remembered, and the longest of them in bytes.
    KEPT, LONGEST = 700_000, 64

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])])
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.by_piece = (spec.get("normalizer") or {}).get("normalizers") == normal and split[0].get("type") == "Split" and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and split[1:] == [bytewise] and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.by_piece = self.by_piece and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or [])
        if self.by_piece:
            self.words = regex.compile(split[0]["pattern"]["Regex"])
            self.plain = regex.compile("[!-~À-ÖØ-öø-ÿ]+")
            # Letters, and marks after them other than apostrophes: two words by the pattern, whatever they are.
            self.simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
            self.simple_ok = all(self.words.findall(t) == [t[:-2], t[-2:]] for t in ("ab.,", "éÿ$]"))
            self.letter = {b: c for c, b in _byte_of().items()}
            self.merge = self.whole.model.tokenize
            self.word_ids: dict[str, bytes] = {}
            self.piece_ids: dict[bytes, bytes] = {}

    def _word(self, w: str) -> bytes:
        out = self.word_ids.get(w)
        if out is None:
            # Printable ASCII stands for itself in such files.
            out = array("I", [t.id for t in self.merge(w if w.isascii() else "".join(map(self.letter.__getitem__, w.encode())))]).tobytes()
            if len(w) <= self.LONGEST:
                self.word_ids[w] = out
        return out

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.simple_ok and (m := self.simple.fullmatch(text)):
            out = self._word(m[1].lower()) + (self._word(m[2]) if m[2] else b"")
        elif self.plain.fullmatch(text):
            out = b"".join(map(self._word, self.words.findall(text.lower())))
        else:
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(piece) <= self.LONGEST:
            self.piece_ids[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not self.by_piece or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.piece_ids) > self.KEPT or len(self.word_ids) > self.KEPT:
            self.piece_ids.clear()
            self.word_ids.clear()
        pieces = text.encode("utf-8", "replace").split()
        known = self.piece_ids.get
        parts = list(map(known, pieces))
        if None in parts:
            parts = [p if p is not None else known(w) or self._piece(w) for w, p in zip(pieces, parts)]
        return b"".join(parts)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, once per process, with the words it knows by then."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str, sample_rows: int, sample_chars: int) -> bytes:
    """The dictionary, from at most ``sample_rows`` documents with the smallest hashes and of each at most its first ``sample_chars`` characters:
    it changes the size of the frames, not what they hold. Empty where there are too few to train on."""
    share, n = 1 << 20, docs.count()
    most = share if n <= 4 * sample_rows else -(-share * 3 * sample_rows // n)
    h = F.xxhash64(id_in(id_col), text_col)
    few = docs.select(h.alias("h"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, sample_chars).alias("text")).where(F.pmod("h", F.lit(share)) < most)
    few = few.dropDuplicates(["h"]).orderBy("h").limit(sample_rows)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        held = [narrow(enc.ids(t) + end, width) for f in frames for t in f["text"]]
        try:
            made = zstandard.train_dictionary(DICTIONARY, held).as_bytes() if held else b""
        except zstandard.ZstdError:
            made = b""
        yield pd.DataFrame({"made": [made]})

    # A sample of bounded size, in one task.
    found = few.coalesce(1).mapInPandas(fit, "made binary").head(1)
    return bytes(found[0]["made"]) if found else b""


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widen(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _frames(made: bytes, compress: bool):
    import zstandard

    kept = zstandard.ZstdCompressionDict(made) if made else None
    return (zstandard.ZstdCompressor(level=3, dict_data=kept, write_content_size=True) if compress else zstandard.ZstdDecompressor(dict_data=kept))


class _Writer:
    """One file in the making."""

    def __init__(self, store, top: str, made: bytes, width: int, first: tuple) -> None:
        store.create_dir(top, recursive=True)
        self.name, self.first = f"{uuid.uuid4().hex}.ids", first
        self.out = store.open_output_stream(f"{top}/{self.name}", compression=None)
        self.pack, self.width, self.at, self.tokens = _frames(made, True), width, HEADER.size, 0
        self.rows: list[tuple[int, int, int]] = []
        self.out.write(HEADER.pack(MAGIC, width, hashlib.sha256(made).digest()))

    def add(self, doc: int, ids: bytes) -> None:
        frame = self.pack.compress(narrow(ids, self.width))
        self.out.write(frame)
        self.rows.append((doc, self.at, len(ids) // 4))
        self.at += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> dict:
        import zstandard

        index = zstandard.ZstdCompressor(level=3).compress(np.array(self.rows, "<i8").T.tobytes())
        self.out.write(index + FOOTER.pack(self.at, len(index), len(self.rows), self.tokens, zlib.crc32(index), END))
        self.out.close()
        id_, h, r = self.first
        return {"file": self.name, "first": {"id": id_, "h": h, "r": r}, "bytes": self.at, "docs": len(self.rows), "tokens": self.tokens}


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, sample_chars: int = 8000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all documents, each with ``end_id`` after it, under ``path`` in ascending order of their ids, and returns the table of files:
    ``FILES`` and ``start``, the tokens before each file, stored. ``docs`` is read three times.

    Defined cases: null and empty texts have the end id alone; very long texts are one frame; rows that share an id stand side by side, in the order of the
    hashes of their texts; null ids come first; an empty table has no file; other columns are ignored, whatever their names."""
    width = 2 if max(encoder(tokenizer).top, end_id) < 1 << 16 else 4
    made = train(docs, tokenizer, end_id, width, id_col, text_col, sample_rows, sample_chars)
    store, top = open_store(path)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/{hashlib.sha256(made).hexdigest()}.dictionary", compression=None) as out:
        out.write(made)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        store, top = open_store(path)
        now, done = None, []
        for f in batches(frames, "text"):
            for doc, h, r, text in zip(f["id"].tolist(), f["h"].tolist(), f["r"].tolist(), f["text"]):
                if now is not None and now.at >= file_bytes:
                    done.append(now.close())
                    now = None
                if now is None:
                    now = _Writer(store, top, made, width, (doc, h, r))
                now.add(doc, enc.ids(text) + end)
        if now is not None:
            done.append(now.close())
        if done:
            yield pd.DataFrame(done)

    rows = docs.select(id_in(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "h", "r").sortWithinPartitions("id", "h", "r")
    files = stored(rows.mapInPandas(write, FILES), "id-files")
    # One row a file, so their sums are a small table.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    return stored(files.select("*", before), "id-files")


class Opened:
    """A file that is read by ranges."""

    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name
        store, top = open_store(path)
        self.file = store.open_input_file(f"{top}/{name}")
        size = self.file.size()
        magic, self.width, own = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        self.end, n, docs, self.tokens, crc, end = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        packed = self.file.read_at(n, self.end)
        if magic != MAGIC or end != END or zlib.crc32(packed) != crc:
            raise ValueError(f"{name}: no file of ids, or a broken one")
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(packed)
        self.ids, self.offsets, self.counts = np.frombuffer(raw, "<i8").reshape(3, docs)
        with store.open_input_stream(f"{top}/{own.hex()}.dictionary", compression=None) as f:
            made = f.read()
        if hashlib.sha256(made).digest() != own:
            raise ValueError(f"{name}: its dictionary is another one")
        self.unpack = _frames(made, False)

    def read(self, first: int, last: int) -> list[bytes]:
        """Ids of the documents from place ``first`` to before ``last``, as 32-bit integers, by one range."""
        if first == last:
            return []
        edges = [*self.offsets[first:last].tolist(), int(self.offsets[last]) if last < len(self.offsets) else self.end]
        block = self.file.read_at(edges[-1] - edges[0], edges[0])
        out = []
        for a, b, n in zip(edges, edges[1:], self.counts[first:last].tolist()):
            ids = widen(self.unpack.decompress(block[a - edges[0] : b - edges[0]]), self.width)
            if len(ids) != 4 * n:
                raise ValueError(f"{self.name}: {len(ids) // 4} ids of {n} at {a}")
            out.append(ids)
        return out

    def close(self) -> None:
        self.file.close()


def read_files(files: DataFrame, path: str) -> DataFrame:
    """All documents of ``files`` (any rows of what ``write_files`` returned): ``id, start, n_tokens, ids``, ``ids`` as little-endian unsigned 32-bit integers,
    ``start`` the tokens of all documents before. A task reads about ``SLICE`` bytes of a file and its index."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor(F.col("bytes") / F.lit(SLICE)))
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum(F.floor(F.col("bytes") / F.lit(SLICE)) + 1), F.lit(1))).first()[0]
    slices = files.select("file", "start", F.explode(parts).alias("part")).repartition(int(min(total, max(4 * spark.sparkContext.defaultParallelism, total // 8))), "file", "part")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, start, part in f[["file", "start", "part"]].itertuples(index=False):
                one = Opened(path, name)
                a, b = np.searchsorted(one.offsets, [part * SLICE, (part + 1) * SLICE]).tolist()
                begins = int(start) + np.cumsum(one.counts) - one.counts
                while a < b:
                    # As many as hold a bounded number of ids; one long document stands alone.
                    size = np.cumsum(one.counts[a:b])
                    z = a + max(1, int(np.searchsorted(size, 2_000_000, "right")))
                    yield pd.DataFrame({"id": one.ids[a:z], "start": begins[a:z], "n_tokens": one.counts[a:z], "ids": one.read(a, z)})
                    a = z
                one.close()

    return id_out(slices.mapInPandas(read, "id long, start long, n_tokens long, ids binary"))


def lookup(files: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """The documents whose id is one of ``wanted(id)``, distinct and not null: as ``read_files``, by the ranges of their frames alone. Files outside the wanted
    ids are not opened; an opened one gives its index and the frames asked for."""
    spans = files.select("file", "start", F.col("first.id").alias("low"), F.lead("first.id").over(Window.orderBy("first")).alias("next"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, start in f[["file", "start"]].itertuples(index=False):
                one = Opened(path, name)
                begins = int(start) + np.cumsum(one.counts) - one.counts
                for a in range(0, len(one.ids), 100_000):
                    z = slice(a, a + 100_000)
                    yield pd.DataFrame({"id": one.ids[z], "file": name, "place": np.arange(a, a + len(one.ids[z])), "start": begins[z]})
                one.close()

    def fetch(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        one, f = Opened(path, key[0]), f.sort_values("place")
        ids = [x for p in f["place"].tolist() for x in one.read(p, p + 1)]
        one.close()
        return pd.DataFrame({"id": f["id"].to_numpy(), "start": f["start"].to_numpy(), "n_tokens": np.array([len(x) // 4 for x in ids], np.int64), "ids": ids})

    bounds = wanted.agg(F.min("id"), F.max("id")).first()
    if bounds[0] is None:
        return read_files(files.limit(0), path)
    near = spans.where((F.col("low") <= int(bounds[1])) & (F.col("next").isNull() | (F.col("next") >= int(bounds[0]))))
    places = near.repartition("file").mapInPandas(find, "id long, file string, place long, start long").where(F.col("id") != NO_ID)
    places = places.join(wanted.select("id"), "id", "left_semi").withColumn("part", F.floor(F.col("place") / 1000))
    return places.groupBy("file", "part").applyInPandas(fetch, "id long, start long, n_tokens long, ids binary")
