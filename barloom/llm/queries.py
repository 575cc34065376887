"""The registered queries of the corpus operators, and their SQL where it can express them.

Each query applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, html_blocks, langid, packing, periodic, pu_quality, simhash, spelling, substring, token_files, tokens, warc
from .common import new_dir, table

TOKENIZER = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digests="all").withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").drop("n_blocks")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each page, from its text, declared language, address suffix, domain and host, and of each document, from
    its text and source; fitted on labelled documents. A row has ``page_id`` or ``doc_id``."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = langid.page_evidence(pages).withColumn("page", F.lit(True)).unionByName(langid.document_evidence(docs).withColumn("page", F.lit(False)))
    out = langid.identify(rows, langid.fit(docs), carry=("page",))
    return out.select(F.when(~F.col("page"), F.col("id")).alias("doc_id"), F.when(F.col("page"), F.col("id")).alias("page_id"), "language", "probability", "text_language", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each page, weighed among pages alone; fitted on the documents."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify(langid.page_evidence(table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items that each holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    out = tokens.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select(F.col("id").alias("doc_id"), "section", "start", "length", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, of which one in 97 loses a letter, as the contract asks."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), change=spelling.slipped)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document, after every word of a tail of one in ten documents (by the crc32 of its id) is replaced by one a period
    before, as the contract asks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = F.filter(F.split(F.coalesce("body", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, g = F.size("own").cast("long"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, F.pmod(g, F.greatest(n, F.lit(1))))
    p = F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8)))) + 1
    copied = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("own", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    docs = docs.withColumn("h", h).withColumn("own", F.when(F.pmod("h", F.lit(10)) == 0, own))
    docs = docs.withColumn("a", a).withColumn("p", p).select("doc_id", F.when(n > 0, F.array_join(copied, " ")).otherwise(F.col("body")).alias("text"))
    out = periodic.period_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", best)
    start, length, period = F.col("best.start"), -F.col("best.col1"), F.col("best.period")
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of all documents' ids hold, read back from them."""
    path = new_dir(spark, "ids")
    files = token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_files(files, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_decontamination": op4_decontamination,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": r"""
        WITH it AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM benchmark),
        dt AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM documents),
        i AS (SELECT item_id, w, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM it WHERE len(w) >= 13),
        d AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dt WHERE len(w) >= 13),
        -- Alignments with at least eleven equal tokens, whatever their places.
        m AS (
            SELECT d.doc_id, i.item_id, d.p - i.p AS shift, i.p AS q
            FROM d JOIN i ON d.t = i.t),
        g AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING count(DISTINCT q) >= 11),
        e AS (
            SELECT g.*, count(*) OVER (PARTITION BY g.doc_id, g.item_id, g.shift ORDER BY m.q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n, m.q,
                   greatest(0, -g.shift) AS a, least(len(it.w), len(dt.w) - g.shift) AS z
            FROM g JOIN m USING (doc_id, item_id, shift) JOIN it USING (item_id) JOIN dt USING (doc_id)),
        f AS (
            SELECT doc_id, item_id, shift, count(*) AS matched, max(z - a) AS longest,
                   max(n) >= 11 AND max(z - a) >= 13 AS near
            FROM e GROUP BY ALL)
        SELECT doc_id, item_id, max(matched)::INTEGER AS matched, max(longest)::INTEGER AS longest FROM f WHERE near GROUP BY ALL""",
    "op9_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM t""",
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept,
               text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
}
