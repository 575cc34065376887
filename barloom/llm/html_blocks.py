"""Main-text extraction: pages are cut into blocks, and a recurrent network labels every block of a page.

The scanner turns a page into its leaf blocks in page order: the text between block-level tags, with the
path of open tags above it. A bidirectional LSTM in numpy reads one vector per block (hashed names, classes, ids
and roles of the tag path, hashed words, and shape counts) and labels each block with the whole page as context.
It is trained here, by ``train`` on layouts drawn at random by ``layout`` (see html_model.py for the kept
weights); pages of one batch run together, padded to their longest.
"""

from __future__ import annotations

import functools
import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_in, id_out
from .html_scan import CLOSE, TEXT, scan

#: Elements without content, elements whose content is no text, and elements that do not end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe canvas object math select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the key's kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Each known tag has a slot of its own, and all others share one.
TAG_SLOTS = {t: i for i, t in enumerate(sorted(VOID | INLINE | ENDS_P | {"body", "caption", "dd", "dt", "html", "li", "search", "tbody", "td", "tfoot", "th", "thead", "tr"}))}
TAGS = len(TAG_SLOTS) + 1
#: Slots of tag names and of the hashed parts of classes, ids and roles together, of hashed words, and shape counts.
PATH, WORDS, SHAPE = TAGS + 192, 96, 12
N_IN = PATH + WORDS + SHAPE

#: An attribute inside a tag; a quote opens a value only after ``=``.
_ATTR = re.compile(r"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r >]*+)))?+")
_NAMED = frozenset("class id role itemprop hidden aria-label".split())
_PART = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class _WordSlots(dict):
    """Slots of words as they stand; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = slot = _slot(word.lower().strip(".,:;!?()"), WORDS)
        return slot


_WORD_SLOTS = _WordSlots()


def path_slots(tag: str, attrs: str) -> list[int]:
    """Features of one tag: its name, and the hashed parts, in letters, of its class, id and role."""
    out, own = [TAG_SLOTS.get(tag, TAGS - 1)], lambda part: TAGS + _slot(part, PATH - TAGS)
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name in _NAMED:
                out.append(own("hidden=" if name == "hidden" else "="))
                out += map(own, _PART.findall(value))
    return out


class Blocks:
    """Texts of a page's blocks, and per block the slots of its path, its innermost tag that is not inline, its link share, and the
    number of tags open above it."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.paths: list[list[int]] = []
        self.tags: list[str] = []
        self.links: list[float] = []
        self.depths: list[int] = []


def blocks(page: str | None) -> Blocks:
    """The leaf blocks of a page in order. Raw elements, comments and declarations are no text; character
    references are decoded; white space within a block is one space; blocks without text are left out. Unclosed
    and misnested tags are closed as browsers close them: a paragraph ends at the next block-level tag."""
    out, stack, cache = Blocks(), [], {}
    held: dict[int, int] = {}  # slots of the open tags
    places: dict[str, list[int]] = {}  # places in the stack of the open tags of each name
    outer: list[int] = []  # and of those that are not inline
    text: list[str] = []
    linked = depth = total = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            t = "".join(text)
            t = " ".join((html.unescape(t) if "&" in t else t).split())
            if t:
                out.texts.append(t)
                out.paths.append(list(held))
                out.tags.append(stack[outer[-1]][0] if outer else "")
                out.links.append(linked / max(total, 1))
                out.depths.append(len(stack))
            text.clear()
        linked = total = 0

    def close_to(k: int) -> None:
        nonlocal depth
        while len(stack) > k:
            tag, slots = stack.pop()
            depth -= tag == "a"
            places[tag].pop()
            if tag not in INLINE:
                outer.pop()
            for s in slots:
                held[s] -= 1
                if not held[s]:
                    del held[s]

    def last(*tags: str) -> int:
        """The place of the innermost open tag of these names, or -1."""
        return max((own[-1] for t in tags if (own := places.get(t))), default=-1)

    for kind, tag, rest in scan(page or "", RAW, INLINE):
        if kind == TEXT:
            text.append(tag)
            n = len(tag.strip())
            total += n
            linked += n if depth else 0
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag not in INLINE
        if block:
            flush()
        if kind == CLOSE:
            k = last(tag)
            if k >= 0 and (block or not outer or outer[-1] < k):
                close_to(k)
            continue
        if block:
            # An open paragraph is closed unless another block stands inside it.
            if tag in ENDS_P and outer and outer[-1] == last("p"):
                close_to(outer[-1])
            if tag in CLOSES and (k := last(*CLOSES[tag])) > last(*STOPS[tag]):
                close_to(k)
        if tag in VOID:  # a closing slash says nothing of other elements
            continue
        key = (tag, "" if tag == "a" else rest)
        slots = cache.get(key)
        if slots is None:
            slots = path_slots(*key)
            cache[key] = slots
        places.setdefault(tag, []).append(len(stack))
        if block:
            outer.append(len(stack))
        stack.append((tag, slots))
        for i in slots:
            held[i] = held.get(i, 0) + 1
        depth += tag == "a"
    flush()
    return out


def vectors(b: Blocks) -> np.ndarray:
    """One row per block: path slots, hashed counts of all words (on a log scale), shape counts."""
    x = np.zeros((len(b.texts), N_IN), np.float32)
    slots: list[int] = []
    for i, (t, p, link, tag, deep) in enumerate(zip(b.texts, b.paths, b.links, b.tags, b.depths)):
        x[i, p] = 1
        k, n = t.count(" ") + 1, len(t)
        slots += [i * WORDS + v for v in map(_WORD_SLOTS.__getitem__, t.split(" "))]
        x[i, PATH + WORDS :] = (math.log1p(k) / 5, math.log1p(n / k) / 3, link, sum(map(t.count, ".!?")) / k, sum(map(t.count, "|©·»›•")) / k, i / len(b.texts), 1.0 if i == 0 else 0.0, 1.0 if t[-1] in ".!?" else 0.0,
            1.0 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0, 1.0 if tag in ("", "body", "div", "section", "td") else 0.0, 1.0 if tag == "li" else 0.0, math.log1p(deep) / 3)
    x[:, PATH : PATH + WORDS] = np.log1p(np.bincount(slots, minlength=len(x) * WORDS).reshape(len(x), WORDS)) / 2
    return x


# --- The network ------------------------------------------------------------------------------------


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction: x [pages, steps, N_IN], live [pages, steps]."""
    pages, steps, _ = x.shape
    n = u.shape[0]
    h, c, out = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32), np.zeros((pages, steps, n), np.float32)
    z_in = x @ w + b
    for t in range(steps):
        z = z_in[:, t] + h @ u
        i, f, o, g = _sig(z[:, :n]), _sig(z[:, n : 2 * n] + 1), _sig(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        m = live[:, t : t + 1]
        c_new = f * c + i * g
        h_new = o * np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, c_new, m))
        c, h = m * c_new + (1 - m) * c, m * h_new + (1 - m) * h
        out[:, t] = h
    return out


def logits(x: np.ndarray, live: np.ndarray, p: dict) -> np.ndarray:
    a = _lstm(x, live, p["wf"], p["uf"], p["bf"])
    z = _lstm(x[:, ::-1], live[:, ::-1], p["wb"], p["ub"], p["bb"])[:, ::-1]
    return a @ p["vf"] + z @ p["vb"] + x @ p["vx"] + p["c"]


def label(pages: list[np.ndarray], p: dict, most_cells: int = 1 << 16) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order, at = sorted(range(len(pages)), key=lambda i: len(pages[i])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= most_cells:
            end += 1
        own = order[at:end]
        steps = len(pages[own[-1]])
        if steps:
            x, live = np.zeros((len(own), steps, N_IN), np.float32), np.zeros((len(own), steps), np.float32)
            for k, i in enumerate(own):
                x[k, : len(pages[i])], live[k, : len(pages[i])] = pages[i], 1
            y = logits(x, live, p) > 0
            for k, i in enumerate(own):
                out[i] = y[k, : len(pages[i])]
        at = end
    return out


def extract(pages: DataFrame, params: dict | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars, n_blocks`` per row: the blocks labelled main text, in page order, joined by line feeds.

    Defined cases: null or empty html and pages without main text give the empty string; very long pages, attributes and paths of open
    tags are read whole; a block that is as likely main text as not is none; repeated rows, and rows that share an id, give a row each; null ids and URLs stay null; an empty table gives an empty result; other columns are ignored."""
    if params is None:
        from .html_model import load

        params = load()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, "html", 2_000_000):
            cut = [blocks(h) for h in f["html"]]
            main = label([vectors(b) for b in cut], params, 1 << 13)
            text = ["\n".join(t for t, y in zip(b.texts, m) if y) for b, m in zip(cut, main)]
            yield pd.DataFrame({"id": f["id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text], "n_blocks": [len(b.texts) for b in cut]})

    return id_out(pages.select(id_in(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, "id long, url string, text string, n_chars long, n_blocks long"))
