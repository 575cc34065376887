"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that word and text rules use: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a session on one machine (a local master, as
    in tests) may do without one and gets a temporary folder; on a cluster a missing setting is an error, since
    what executors write to folders of their own is lost to the others."""
    kept = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = "file://" + tempfile.mkdtemp(prefix="spark-barloom-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set("spark.checkpoint.dir", kept)
    return kept.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex[:12]}/{what}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage, and survives
    the loss of any executor."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Adds a number of its own to each row, whatever ids the rows have: that of its file, files taken in the order of their paths, and its place in it. So it is the
    same in every plan, however the files are split, and nothing is written but a table of files. Rows that do not come straight from files are
    stored with their numbers."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_numbered_file"), F.col("_metadata.row_index").alias("_numbered_at"))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    order = Window.orderBy("_numbered_file")  # one row a file
    files = stored(placed.select("_numbered_file").distinct().withColumn("_numbered_of", F.row_number().over(order).cast("long")), "numbered-files")
    out = joined(placed, files, ["_numbered_file"], "inner")
    return out.select(*docs.columns, (F.shiftleft("_numbered_of", 40) + F.col("_numbered_at")).alias(name))


#: Rows of a stored table of keys that are broadcast (about 100 bytes each), and rows of one whole number alone (16 bytes each).
BROADCAST_ROWS, BROADCAST_NUMBERS = 400_000, 2_000_000
#: Parts into which a row of the smaller side is copied where it is too large to be broadcast.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A shuffled join in which each row of ``few`` stands once in each of SALTS parts, so that a key that many ``rows`` hold is
    spread. The part of a row is that of its task's number, which is the same when the task runs again. The hint keeps Spark from broadcasting the
    copies, which it takes for no larger than the file of ``few``."""
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``few``, a stored table with one row per key: broadcast where its counted rows are few enough,
    else by ``salted_join``."""
    number = len(few.dtypes) == 1 and few.dtypes[0][1] in ("int", "bigint")
    if few.count() <= (BROADCAST_NUMBERS if number else BROADCAST_ROWS):
        return rows.join(F.broadcast(few), keys, how)
    return salted_join(rows, few, keys, how)


#: Stands for a null id inside Python functions, where a column of whole numbers with nulls would turn to floats.
NO_ID = -(1 << 63)


def id_in(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_out(df: DataFrame, column: str = "id") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != NO_ID, F.col(column)))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: str | None) -> list[str]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text, unchanged; no other white space separates."""
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def batches(frames: Iterator[pd.DataFrame], column: str, most_chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cuts frames so that the texts of each piece stay within ``most_chars`` (one longer text stays
    alone): what a task holds does not depend on how long the texts of a batch happen to be. A frame is let go before the next one is
    asked for, and what Arrow keeps of it is given back."""
    import pyarrow as pa

    frames = iter(frames)
    while True:
        frame = next(frames, None)
        if frame is None:
            return
        if len(frame):
            size = np.array([len(t) if t is not None else 0 for t in frame[column]], np.int64)
            part = np.maximum.accumulate((np.cumsum(size) - size) // most_chars)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(frame)]
            # Copies hold the texts of their own rows alone.
            pieces = [frame.iloc[a:b].copy() for a, b in zip(edges, edges[1:])][::-1]
            del frame
            while pieces:
                yield pieces.pop()
        pa.default_memory_pool().release_unused()


def hash_sample(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` distinct values of ``ids(id)`` with the smallest hashes, or all where there are fewer. A bound on
    the hash, from a count, is applied first, so that what tasks pass on does not grow with their number."""
    ids = ids.select("id").distinct()
    n = ids.count()
    share = 1 << 20
    most = share if n <= 4 * rows else -(-share * 3 * rows // n)
    return ids.where(F.pmod(F.xxhash64("id"), F.lit(share)) < most).orderBy(F.pmod(F.xxhash64("id"), F.lit(share)), "id").limit(rows)


def connected(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest reachable id of every node: ``nodes(id)``, ``edges(a, b)`` to ``(id, component)``.

    Alternates the large-star and small-star steps of the map-reduce method for connected components:
    each step only aggregates and joins, its edges never outnumber the input's, and the number of rounds
    grows with the logarithm of the longest path. Each round is written to the shared folder, and the one before it deleted. Nodes
    without edges are their own component; edges of a node with itself and repeated edges count for nothing.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stored(hang.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        spent(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
