"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, packing.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

Stages decide row by row, not by ``doc_id``: each row has a number by its file and place, by which what a stage removes is named. Defined cases: a null id, or one that other rows share, is judged by its own text;
of equal rows one stays; null and empty texts have no language and go in the first stage; very long texts are read whole; of copies with equal
lengths the smallest id stays; an empty table stays empty through all stages; further columns, whatever
their names, are passed on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, exact, langid, packing, simhash
from barloom.llm.common import joined, numbered, stored, table

#: The number of a row within a stage. A column of that name is carried under another one.
ROW = "_row"
_KEPT = "_row_of_docs"


#: Rows that pass between Spark and a Python task at a time: whole texts are long, and each side holds a batch twice.
BATCH = 1000


def rows_of(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return numbered(docs.withColumnRenamed(ROW, _KEPT), ROW)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs``, numbered, less the rows that ``gone`` names."""
    return joined(docs, stored(gone.select(ROW), "gone"), [ROW], "left_anti").drop(ROW).withColumnRenamed(_KEPT, ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known."""
    docs = rows_of(docs)
    found = langid.identify(langid.document_evidence(docs, ROW), langid.fit(docs))
    return without(docs, found.where(~F.col("kept")).withColumnRenamed("id", ROW))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    docs = rows_of(docs)
    found = exact.exact_dedup(docs, ROW, rank_col="doc_id")
    return without(docs, found.where(~F.col("kept")).withColumnRenamed("id", ROW))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word shingles, similarity 0.8."""
    docs = rows_of(docs)
    found = stored(simhash.near_copies(docs, ROW).withColumnRenamed("id", ROW), "near")
    found = stored(joined(docs.select(ROW, "doc_id"), found, [ROW], "inner"), "near-ids")
    stays = found.groupBy("component").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW))
    return without(docs, found.select(ROW).join(stays.select(ROW), ROW, "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of a benchmark item."""
    docs = rows_of(docs)
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), ROW)
    return without(docs, found.select(F.col("id").alias(ROW)).distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


#: SQL cannot express fingerprints or the packing; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
