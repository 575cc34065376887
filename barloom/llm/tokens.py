"""Token counts by section, attributed through the offsets of whole-document encodings.

A document is encoded once and whole, so no token is lost or made at a boundary. Its tokens are character
spans, its sections are character spans, and both are sorted: the join of the two is a search in sorted ends. A
token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import batches, id_in, id_out

RULES = ("first", "last", "most", "share")
_LINE = re.compile(r"\n")


def line_sections(text: str) -> tuple[list[str], list[int]]:
    """Sections of a text: its lines, each with its line feed, named ``line``. The empty text has one."""
    ends = [m.end() for m in _LINE.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ["line"] * len(ends), ends


def attribute(first: np.ndarray, end: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross into another section.

    ``first``/``end``: span of each token; ``ends``: end of each section, rising, the first begins at 0.
    Rules: ``first``: the section of the token's first character; ``last``: of its last; ``most``: of most of
    its characters, the earlier on ties; ``share``: each section gets the share of its characters."""
    k = len(ends)
    a = np.minimum(np.searchsorted(ends, first, "right"), k - 1)
    z = np.minimum(np.searchsorted(ends, np.maximum(end - 1, first), "right"), k - 1)
    count, cross = np.bincount(a[a == z], minlength=k).astype(np.float64), np.zeros(k, np.int64)
    for i in np.flatnonzero(a != z):
        span = range(int(a[i]), int(z[i]) + 1)
        parts = [min(int(end[i]), int(ends[s])) - max(int(first[i]), int(ends[s - 1]) if s else 0) for s in span]
        own = {"first": a[i], "last": z[i], "most": a[i] + int(np.argmax(parts))}.get(rule)
        if own is None:
            for s, p in zip(span, parts):
                count[s] += p / (end[i] - first[i])
        else:
            count[own] += 1
        cross[int(a[i]) : int(z[i]) + 1] += 1
    return count, cross


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections: Callable[[str], tuple[list[str], list[int]]] = line_sections, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and section: ``id, section, name, start, length, n_tokens, n_crossing``; lengths and starts
    in characters, ``n_tokens`` a whole number unless the rule is ``share``. The counts of a document's sections
    add up to the tokens of the whole document, whatever the rule.

    Defined cases: null and empty texts have one empty section without tokens; very long texts are encoded whole; a token with equal
    parts in two sections is the earlier one's under ``most``; repeated rows, and rows that share an id, are counted
    once each; a null id stays null; an empty table gives an empty result; other columns are ignored."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "text"):
            texts = [t or "" for t in f["text"]]
            e = encode(texts, tokenizer, spans=True)
            ids, cols = f["id"].tolist(), [[] for _ in range(7)]
            for i, t in enumerate(texts):
                names, ends = sections(t)
                z = slice(e.bounds[i], e.bounds[i + 1])
                ends_ = np.asarray(ends, np.int64)
                count, cross = attribute(e.first[z], e.end[z], ends_, rule)
                starts = np.concatenate([[0], ends_[:-1]])
                for c, v in zip(cols, ([ids[i]] * len(ends), range(len(ends)), names, starts, ends_ - starts, count, cross)):
                    c.extend(v)
            yield pd.DataFrame(dict(zip(("id", "section", "name", "start", "length", "n_tokens", "n_crossing"), cols)))

    return id_out(docs.select(id_in(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, section int, name string, start long, length long, n_tokens double, n_crossing long"))
