"""Spelling variants by permuterm rotations.

Each word gets a terminator, and its rotations are sorted. A word A c B that loses c has the rotation B $ A, and so has every word that
has another letter in the place of c, once that letter is skipped: rotations that agree in B $ A are one prefix range. In the range of a
prefix stand the words that have one letter more, one for each letter, and the word AB itself, if it is one. So words that differ by a
replaced letter meet there once, at the letter's place, and a word meets the one with a letter less at the first of equal letters in a row (the
others of the row give the same pair and are not counted again). A range holds at most one word a letter of the alphabet, and one.

Ranges are scanned in their sorted order; of each word there is told how many neighbours it has in the range and which is the most frequent, so that
no pairs are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, joined, spent, stored

#: Letters of a word, after A to Z are lowered: a to z and U+00C0 to U+00FF.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Sorts below all letters and is none.
END = "$"
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slipped(doc_id: str, words: Counter) -> Iterator[tuple[str, int]]:
    """Words of a document with their counts; of those whose checksum with the document's id is a multiple of 97, one letter is left out."""
    base = zlib.crc32(f"{doc_id}:".encode())
    for w, n in words.items():
        h = zlib.crc32(w.encode(), base)
        if h % 97 == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        yield w, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[str, Counter], Iterator[tuple[str, int]]] | None = None) -> DataFrame:
    """``word, n`` over all documents. ``change`` may replace the words of a document, given its id as text (empty if null)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        get = total.get
        for f in batches(frames, "text"):
            for i, t in zip(f["id"], f["text"]):
                own = Counter(LETTERS.findall((t or "").translate(_LOWER)))
                for w, n in change(i, own) if change else own.items():
                    total[w] = get(w, 0) + n
            if len(total) > HELD:
                yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                total.clear()
        if total:  # a frame of empty lists has columns of floats, which Spark cannot send as words
            yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: of each word of ``words(word, n)``, one row each, that has words at one inserted, deleted or replaced letter, how many,
    and the most frequent as ``(less, word)`` with ``less`` = -n, the smallest word on ties."""
    at, size = F.col("at"), F.length("word")
    end = F.lit(END)
    less = (-F.col("n")).alias("less")
    # Without one letter, and whole.
    cut = words.select("word", less, F.explode(F.sequence(F.lit(1), size)).alias("at"))
    head = F.substring("word", F.lit(1), at - 1)
    fresh = (at == 1) | (F.substring("word", at, F.lit(1)) != F.substring("word", at - 1, F.lit(1)))
    cut = cut.select(F.concat(F.substring("word", at + 1, size), end, head).alias("range"), F.substring("word", at, F.lit(1)).alias("letter"), "less", fresh.alias("fresh"))
    whole = words.select("word", less, F.explode(F.sequence(F.lit(0), size)).alias("at"))
    whole = whole.select(F.concat(F.substring("word", at + 1, size), end, F.substring("word", F.lit(1), at)).alias("range"), F.lit("").alias("letter"), "less", F.lit(False).alias("fresh"))
    rows = cut.unionByName(whole)
    # One sort for all: ranges, in each the word itself and then the longer ones, the most frequent first.
    over = Window.partitionBy("range").orderBy("longer", "less", "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("longer", F.col("letter") != "")
    one = F.struct("less", "letter")
    when_long, when_fresh = F.when(F.col("longer"), one), F.when(F.col("fresh"), one)
    rows = rows.select(
        "range", "letter", "less", "fresh", "longer", F.row_number().over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("k"), F.count_if("longer").over(over).alias("n_longer"), F.count_if("fresh").over(over).alias("n_fresh"),
        F.min(F.when(~F.col("longer"), F.col("less"))).over(over).alias("whole"), F.first(when_long, ignorenulls=True).over(over).alias("first"),
        F.nth_value(when_long, 2, ignoreNulls=True).over(over).alias("second"), F.first(when_fresh, ignorenulls=True).over(over).alias("first_fresh"),
    )
    has = F.col("whole").isNotNull()
    n_near = F.when(F.col("longer"), F.col("n_longer") - 1 + (has & F.col("fresh")).cast("long")).otherwise(F.col("n_fresh"))
    b, a = F.substring_index("range", END, 1), F.substring_index("range", END, -1)
    spelled = lambda c: F.concat(a, c, b)
    word_of = lambda s: F.when(s.isNotNull(), F.struct(s["less"].alias("less"), spelled(s["letter"]).alias("word")))
    itself = F.when(has & F.col("fresh"), F.struct(F.col("whole").alias("less"), spelled(F.lit("")).alias("word")))
    top = F.col("k") == F.when(has, 2).otherwise(1)
    other = F.when(F.col("longer"), F.least(word_of(F.when(top, F.col("second")).otherwise(F.col("first"))), itself)).otherwise(word_of(F.col("first_fresh")))
    rows = rows.select(spelled(F.col("letter")).alias("word"), n_near.alias("near"), other.alias("other")).where("near > 0")
    return rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)`` (one row a word): the last word that following forms leads to. Every round doubles the way, so their number
    is the logarithm of the longest one."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = joined(now, now.select(F.col("word").alias("root"), F.col("root").alias("on")), ["root"])
        step = stored(step.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "spelling-roots")
        spent(now)
        if not step.where("moved").head(1):
            return step.drop("moved")
        now = step.drop("moved")
        now.stored_at = step.stored_at


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Groups of ``words(word, n)``: ``word, form, root, n, n_near, form_n``. Two words are near if they differ by exactly one inserted, deleted or
    replaced code point; the form of a word is its near word of largest n, the smallest in code-point order on ties, if that n is at least ``ratio``
    times its own; the root is where forms lead in the end, the word itself without one. ``ratio`` is 2 or more, so no word leads back.

    Defined cases: a word without near words has no form and is its own root; words must be distinct and made of letters (no ``$``); an empty
    table gives an empty result."""
    if ratio < 2:
        raise ValueError("forms could lead back with a ratio under 2")
    words = stored(words.select("word", "n"), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "spelling-near")
    spent(words)
    root = roots(near.where("form is not null").select("word", "form"))
    out = joined(near, root, ["word"])
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text", change: Callable[[str, Counter], Iterator[tuple[str, int]]] | None = None) -> DataFrame:
    """``variants`` of the words of whole texts: maximal runs of letters A to Z, a to z and U+00C0 to U+00FF, A to Z lowered, of at least
    ``least_letters`` code points and ``least_count`` occurrences over all documents.

    Defined cases: a null text has no words; very long texts are read whole; repeated rows, and rows that share an id, count once each; a null id counts
    as the empty text where ``change`` asks for it; an empty table gives an empty result; other columns are ignored, whatever their names."""
    counts = word_counts(docs, id_col, text_col, change)
    return variants(counts.where((F.length("word") >= least_letters) & (F.col("n") >= least_count)), ratio)
