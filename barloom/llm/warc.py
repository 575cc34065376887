"""WARC archives with an index: every record's archive, offset, length, URL and digest, and reads by byte range.

A task writes its rows to archives of its own in the shared folder, each record a gzip member, and returns the
index rows of what it wrote. An archive's name is new for each attempt of a task, and only the index of
the attempt that succeeds is kept, so a lost executor leaves at worst a file that no index names. Reading
sorts the selected index rows by offset, coalesces ranges that touch or nearly touch, and reads only those
ranges. Files are opened through pyarrow's file systems, by the shared folder's own scheme.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, new_dir, stored

CRLF = "\r\n"
#: Compressed bytes that one task reads of a large selection.
TASK_BYTES = 256 << 20
INDEX = "archive string, offset long, length long, url string, payload_digest string, record_id string, record_type string"


def _header(*fields: tuple[str, object]) -> Column:
    parts = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedupe_from: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``(record_id, url, payload_digest, payload_bytes, record_type, refers_to, head, body)``, head and body the text of each
    record without the two line ends that close it. Of records with equal payloads of at least ``dedupe_from``
    bytes the one with the largest id is the response, the others revisit it. Several rows with that id and payload are
    responses all, and so are all rows of a payload that only null ids have: a revisit needs a record to name."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    digest, size = F.sha1(F.encode(body, "UTF-8")).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")
    keys = pages.select(F.col(id_col).cast("long").alias("id"), digest, size)
    first = keys.where(F.col("payload_bytes") >= dedupe_from).groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("top"), F.count("*").alias("k"))
    # One row per shared payload; the rows meet it by digest and length, whatever their ids.
    first = stored(first.where("k > 1 and top is not null").drop("k"), "warc-shared")
    rows = joined(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), digest, size), first, ["payload_digest", "payload_bytes"])
    rows = rows.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")
    rows = rows.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    rows = rows.withColumn("record_id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")))
    revisit = F.col("refers_to").isNotNull()
    content = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = _header(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", date),
        ("WARC-Target-URI", safe_url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("X-Payload-Length", F.col("payload_bytes")),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.octet_length(content)),
    )
    return rows.select("record_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", head.alias("head"), content.alias("body"))


def open_store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith(("/", "file:/")) and "://" not in path else path)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 256 << 20, **options) -> DataFrame:
    """Writes the archives under ``path`` and returns their index, stored: INDEX.

    ``pages`` as in ``records``; an archive is closed when it holds ``archive_bytes``. Defined cases: null html is an
    empty payload; a null URL is empty; rows with the same page id make records with the same name, each with its own payload, read back
    once each; a null id makes a record without a name, which no other can revisit; very long payloads are one record; an empty table writes no archive and gives an
    empty index; other columns are ignored."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(path)
        out, at, name = None, 0, ""
        try:
            for f in frames:
                rows = []
                for head, body, url, digest, name_, kind in zip(f["head"], f["body"], f["url"], f["payload_digest"], f["record_id"], f["record_type"]):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(top, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    member = gzip.compress(f"{head}{body}{CRLF}{CRLF}".encode(), 6, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, name_, kind))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "url", "payload_digest", "record_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stored(records(pages, **options).drop("refers_to", "payload_bytes").mapInPandas(write, INDEX), "warc-index")


def read_records(index: DataFrame, path: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Reads the records of ``index`` (any selection of its rows) back: ``(archive, offset, headers, payload)``.

    Ranges of an archive are sorted, and those closer than ``gap`` bytes are read in one request of at
    most ``most`` bytes (a longer record is one request). ``index`` is read twice."""
    # Slices of an archive are groups of their own, so a large archive is not one task. The tasks are counted by the bytes to be
    # read: the index rows that are shuffled are too small to tell how many are needed.
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-total // most), max(4 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
    wanted = index.select("archive", "offset", "length", F.floor(F.col("offset") / F.lit(most)).alias("slice")).repartition(tasks, "archive", "slice")

    def fetch(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        store, top = open_store(path)
        name = f"{top}/{key[0]}"
        ranges: list = []
        for o, n in f.sort_values("offset")[["offset", "length"]].itertuples(index=False):
            if ranges and o - ranges[-1][1] <= gap and o + n - ranges[-1][0] <= max(most, n):
                ranges[-1][1] = o + n
                ranges[-1][2].append((o, n))
            else:
                ranges.append([o, o + n, [(o, n)]])
        out = []
        with store.open_input_file(name) as file:
            for a, b, held in ranges:
                block = file.read_at(b - a, a)
                for o, n in held:
                    raw = gzip.decompress(block[o - a : o - a + n])
                    head, _, rest = raw.partition(b"\r\n\r\n")
                    if not raw.startswith(b"WARC/1.1\r\n") or not raw.endswith(b"\r\n\r\n"):
                        raise ValueError(f"no record at {o} of {name}")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    if len(rest) - 4 != int(fields["Content-Length"]):
                        raise ValueError(f"record at {o} of {name}: {len(rest) - 4} bytes of {fields['Content-Length']}")
                    out.append((key[0], o, fields, rest[:-4]))
        return pd.DataFrame(out, columns=["archive", "offset", "headers", "payload"])

    return wanted.groupBy("archive", "slice").applyInPandas(fetch, "archive string, offset long, headers map<string,string>, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages as archives in the shared folder and tells what is read back from them, per record:
    ``id, payload_bytes, payload_digest, record_type, refers_to``. The digest and the length of a response are those
    of the payload read; a revisit, which holds no payload, has those of its own header, counted when it was written."""
    path = new_dir(pages.sparkSession, "warc")
    back = read_records(write_archives(pages, path, **options), path)
    of = lambda name: F.regexp_extract(F.col("headers")[name], r"<urn:page:(-?\d+)>", 1).try_cast("long")
    kind = F.col("headers")["WARC-Type"]
    return back.select(
        of("WARC-Record-ID").alias("id"),
        F.when(kind == "response", F.octet_length("payload").cast("long")).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).alias("payload_bytes"),
        F.when(kind == "response", F.sha1("payload")).otherwise(F.regexp_extract(F.col("headers")["WARC-Payload-Digest"], "sha1:(.*)", 1)).alias("payload_digest"),
        kind.alias("record_type"), of("WARC-Refers-To").alias("refers_to"),
    )
