"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

Tokens are the runs of letters and digits of the lower-cased text. A mask names the token positions that a
seed reads; the tokens between them may differ. The three masks below were chosen by search so that in any
13 aligned tokens of which at most two differ, at least one mask fits at some place without touching a
difference: with the default window and tolerance the seeds lose nothing (``tests/llm/test_decontam.py``
tries all placements). Seeds of the benchmark are joined with seeds of the documents; each hit gives an alignment
(document, item, shift), on which the overlap around it is counted token by token. A hit is a few numbers; the tokens that face
an item are fetched for documents with hits alone, so no row grows with the length of a document times its hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, salted_join, stored, text_or_empty

#: Token positions that each seed reads.
MASKS = ((0, 2, 5, 6, 7, 8, 9), (0, 1, 2, 4, 6, 9, 10), (0, 1, 2, 3, 4, 6, 7))
#: Most benchmark seeds that are broadcast (24 bytes each: under 100 MB); beyond it the join is shuffled.
BROADCAST_SEEDS = 4_000_000


def token_hashes(text: Column) -> Column:
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def seed_keys(h: Column, pos: Column) -> Column:
    """The seeds that begin at ``pos``: one hash per mask that fits within the tokens."""
    keys = [F.when(pos + m[-1] < F.size(h), F.xxhash64(F.lit(k), *(F.get(h, pos + o) for o in m))) for k, m in enumerate(MASKS)]
    return F.array(*keys)


def _positions(rows: DataFrame, h: str, *keep: str) -> DataFrame:
    """A row per mask and position: ``keep``, pos, key (its hash tells the mask)."""
    # The outer form: the plain one infers a filter on the array's size, which would compute the array twice.
    at = rows.select(*keep, h, F.posexplode_outer(h).alias("pos", "_w")).drop("_w").where("pos is not null")
    return at.select(*keep, "pos", F.explode(seed_keys(F.col(h), F.col("pos"))).alias("key")).where("key is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, differ: int = 2) -> DataFrame:
    """``(id, item_id, matched, longest)`` for each document and item with an alignment on which some ``window``
    consecutive tokens differ in at most ``differ`` places: the most such equal tokens on one alignment, and
    the most tokens that one alignment compares.

    Defined cases: null and empty texts match nothing; very long texts are read whole; items of fewer than ``window`` tokens are too short to
    be evidence and match nothing; repeated documents and items give one row per distinct pair, and of rows that share an id each
    counts; of alignments that match equally well any may be told, as their figures are the same; null ids
    are values like others; an empty table on either side gives an empty result; other columns are ignored. The masks lose nothing for windows of 13 or more
    tokens with at most two differences; other values are refused.
    """
    if window < 13 or differ > 2:
        raise ValueError("the masks cover windows of 13 tokens or more with at most two differences")
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(text_or_empty(item_text)).alias("it")).where(F.size("it") >= window)
    items = stored(items.withColumn("item", F.xxhash64("item_id", "it")), "decontam-items")  # named by what it holds
    seeds = _positions(items.withColumn("length", F.size("it")), "it", "item", "length").select("item", "length", F.col("pos").alias("at"), "key").distinct()
    small = seeds.count() <= BROADCAST_SEEDS
    rows = docs.select(F.col(id_col).alias("id"), token_hashes(text_or_empty(text_col)).alias("h"))
    # A text is named by two hashes of its tokens; equal texts are looked at once. Hits are narrow rows, however long the text.
    name = [F.xxhash64("h").alias("c1"), F.xxhash64(F.lit(7), "h").alias("c2")]
    at = _positions(rows.select("id", *name, "h"), "h", "id", "c1", "c2")
    at = at.join(F.broadcast(seeds), "key") if small else salted_join(at, seeds, ["key"], "inner")
    hits = stored(at.select("id", "c1", "c2", "item", "length", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "decontam-hits")

    # The tokens of each text with hits, read again for these alone, and of them what faces an item.
    wanted = stored(hits.select(F.xxhash64("id").alias("w")).distinct(), "decontam-rows")
    again = joined(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("w"), F.col(text_col).alias("text")), wanted, ["w"], "left_semi")
    texts = again.select(token_hashes(text_or_empty("text")).alias("h")).select(*name, "h").dropDuplicates(["c1", "c2"])
    lists = hits.groupBy("c1", "c2").agg(F.collect_set(F.struct("item", "length", "shift")).alias("own"))
    h, a = F.col("h"), lambda x: F.greatest(F.lit(0), -x["shift"])
    n = lambda x: F.least(x["length"], F.size(h) - x["shift"]) - a(x)
    part = lambda x: F.struct(x["item"].alias("item"), a(x).alias("from"), F.slice(h, a(x) + x["shift"] + 1, n(x)).alias("part"))
    facing = texts.join(lists, ["c1", "c2"]).select("c1", "c2", F.explode(F.transform(F.filter("own", lambda x: n(x) >= window), part)).alias("f"))
    known = items.select("item", "item_id", "it").distinct()
    facing = facing.select("c1", "c2", "f.*").join(F.broadcast(known) if small else known, "item")
    equal = F.zip_with(F.slice("it", F.col("from") + 1, F.size("part")), F.col("part"), lambda x, y: (x == y).cast("int"))

    def verdict(run: Column) -> Column:
        """From the equal tokens on an alignment, 1 or 0 each: the windows are counted one by one."""
        starts = F.sequence(F.lit(1), F.size(run) - window + 1)
        count = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y)
        near = F.exists(starts, lambda k: count(F.slice(run, k, window)) >= window - differ)
        return F.struct(near.alias("near"), count(run).alias("matched"), F.size(run).alias("longest"))

    # An array of one binds a value once; by name the optimizer would put its whole expression at each use.
    found = facing.select("c1", "c2", "item_id", F.explode(F.transform(F.array(equal), verdict)).alias("v")).where("v.near")
    found = stored(found.groupBy("c1", "c2", "item_id").agg(F.max("v.matched").alias("matched"), F.max("v.longest").alias("longest")), "decontam-found")
    out = joined(hits.select("id", "c1", "c2").distinct(), found, ["c1", "c2"], "inner")
    return out.groupBy("id", "item_id").agg(F.max("matched").alias("matched"), F.max("longest").alias("longest"))
