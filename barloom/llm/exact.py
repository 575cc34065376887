"""Exact dedup by progressive refinement, with DataFrame operations only.

Texts are equal when they agree after deleting every white-space character (space and U+0009 to U+000D).
Three passes narrow the candidates: by normalised length, then by the hash of a normalised prefix, and
only what still has company there is grouped by the hash of its whole content. The pairs of length and prefix hash that several rows share are kept as a
bitmap of fixed size, which is broadcast: each row tells in its scan whether it may have company, and no text moves however many pairs there are. A
row that only seems to have company is hashed and found to be alone. Grouping moves ids, lengths and hashes,
never texts; counts are summed before they are shuffled, and rows meet their group's few values by a broadcast of
counted size or by salted keys, so a group of copies that holds a third of all rows is a few partial rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, id_in, id_out, joined, spent, stored, text_or_empty


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


#: Bits of the bitmap of shared pairs, as a power of two: at most 2^(BITS - 6) rows of 64 bits.
BITS = 27


def _bit(n: Column, p: Column) -> Column:
    return F.pmod(F.xxhash64(n, p), F.lit(1 << BITS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digests: str = "survivors", rank_col: str | None = None) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then the smallest ``rank_col`` (the
    id if there is none), then the smallest id. ``digests="survivors"`` hashes in full only the texts that may share length and prefix hash with another
    (``text_sha256`` is null for the rest, which are unique); ``"all"`` also gives the digests of the unique ones, for
    callers that need them. Groups are decided among the survivors either way.

    Defined cases: a null text counts as empty, empty and white-space-only texts are equal to each other;
    very long texts are compared whole; rows that share an id, with equal or different texts, are separate rows of their groups (all rows with the
    id of the one that stays are ``kept`` there); a null id is kept as a value of its own and
    loses ties to any id; an empty table gives an empty result; further columns are ignored.
    """
    text = text_or_empty(text_col)
    body = normalised(text)
    n, p = F.length(body).alias("n"), F.xxhash64(F.substring(body, 1, prefix)).alias("p")

    # Pass 1 and 2: lengths, then pairs of length and prefix hash, that more than one row has.
    keys = stored(docs.select(n, p), "exact-keys")
    shared_n = stored(keys.groupBy("n").agg(F.count("*").alias("k")).where("k > 1").select("n"), "exact-lengths")
    shared = joined(keys, shared_n, ["n"], "left_semi").groupBy("n", "p").agg(F.count("*").alias("k")).where("k > 1")
    at = _bit(F.col("n"), F.col("p"))
    bitmap = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits"))
    bitmap = stored(bitmap, "exact-prefixes")

    # Pass 3: the whole content of what is left.
    scan = docs.select(id_in(id_col).alias("id"), id_in(rank_col or id_col).alias("rank"), n, p, F.length(text).alias("points"), body.alias("body"))
    scan = scan.withColumn("at", _bit(F.col("n"), F.col("p"))).withColumn("word", F.shiftright("at", 6))
    flagged = scan.join(F.broadcast(bitmap), "word", "left")
    set_ = F.call_function("shiftrightunsigned", F.col("bits"), F.col("at").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    flagged = flagged.withColumn("more", F.when(F.coalesce(set_, F.lit(False)), 1))
    full = F.sha2(F.encode("body", "UTF-8"), 256)
    flagged = flagged.withColumn("sha", full if digests == "all" else F.when(F.col("more").isNotNull(), full))
    flagged = stored(flagged.select("id", "rank", "points", "n", "sha", "more"), "exact-rows")
    spent(keys, shared_n)
    best = F.max_by("id", F.struct("points", (F.col("rank") != NO_ID).alias("named"), F.bitwise_not("rank").alias("first"), F.bitwise_not("id").alias("then")))
    groups = flagged.where("more is not null").groupBy("n", "sha").agg(F.count("*").alias("size"), best.alias("keep")).where("size > 1")
    rows = joined(flagged, stored(groups, "exact-groups"), ["n", "sha"])
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    out = rows.select(
        "id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return id_out(id_out(out), "keep_id")
