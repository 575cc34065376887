import gzip
import hashlib

from pyspark.sql import functions as F

from barloom.llm import warc
from barloom.llm.common import new_dir

BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u\r\nX: y", ""), (8, "u", "z" * 2_000_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, length int, archive string")


def test_round_trip(spark):
    got = {r["id"]: r for r in warc.round_trip(pages(spark, ROWS)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for i, _, h in ROWS:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 7), 2: ("revisit", 7)}


def test_index_points_at_records(spark):
    path = new_dir(spark, "warc")
    index = warc.write_archives(pages(spark, ROWS).repartition(1), path, archive_bytes=600)
    rows = index.collect()
    assert len({r["archive"] for r in rows}) > 1
    for r in rows:
        with open(f"{path.removeprefix('file://')}/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\n")
    some = warc.read_records(index.where(F.col("record_id").isin("<urn:page:3>", "<urn:page:8>")), path).collect()
    assert sorted(len(r["payload"]) for r in some) == [5, 2_000_000]


def test_empty_and_repeated(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    assert warc.round_trip(pages(spark, [ROWS[3], ROWS[3]])).count() == 2
