"""Whole-text encoding with the vocabulary of a ``tokenizers`` byte-level BPE file.

The file's vocabulary is run through tiktoken, whose merges go by the id of the merged token. For vocabularies
whose ids follow the order of their merges, which is checked when the file is loaded, the ids are those of the
``tokenizers`` library, at about four times its speed; ``tests/llm/test_packing.py`` compares the two
on texts with every kind of white space and with the file's added tokens, which both libraries cut out of a text before anything
else. A text with a run of white space too long for tiktoken's pattern, which backtracks, is encoded by the ``tokenizers`` library itself. Spans come from the lengths of the tokens' bytes, as both count them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Fixed value: the pre-tokenization pattern of the byte-level BPE family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself where printable, else the
    next character from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load(path: str):
    """(encoding, bytes of each id) of a file, once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get(flag) for t in spec.get("added_tokens") or [] for flag in ("lstrip", "rstrip", "single_word")) or any(a != b and a.startswith(b) for a in added for b in added):
            raise ValueError(f"{path}: added tokens must stand as they are, and none may begin another")
        byte, vocab = _byte_of(), spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: a byte-level BPE whose ids follow its merges is needed")
        size = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            size[i] = len(t)
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), size
    return _LOADED[path]


#: White space in a row from which a text goes to the ``tokenizers`` library.
_RUN = re.compile(r"\s{100000}")
_WHOLE: dict[str, object] = {}


def _whole(path: str):
    """The ``tokenizers`` library's own tokenizer of a file, once per process."""
    if path not in _WHOLE:
        from tokenizers import Tokenizer

        _WHOLE[path] = Tokenizer.from_file(path)
    return _WHOLE[path]


@dataclass
class Encoded:
    """Ids of a batch in one array, ``bounds[i]:bounds[i + 1]`` those of text i; with spans, also the first
    character of each token and the one after its last, in its text."""

    ids: np.ndarray
    bounds: np.ndarray
    first: np.ndarray | None = None
    end: np.ndarray | None = None


def encode(texts: Sequence[str | None], path: str, spans: bool = False) -> Encoded:
    enc, size = load(path)
    clean = [(t or "").encode("utf-8", "replace").decode() for t in texts]
    own = [np.array(_whole(path).encode(t, add_special_tokens=False).ids if len(t) >= 100_000 and _RUN.search(t) else enc.encode(t, allowed_special="all"), np.int64) for t in clean]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]).astype(np.int64)
    out = Encoded(np.concatenate([np.empty(0, np.int64), *own]), bounds)
    if spans:
        first, end = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t, ids in zip(clean, own):
            if len(ids):
                stop = np.cumsum(size[ids])
                at = np.cumsum((np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
                first.append(at[stop - size[ids]])
                end.append(at[stop - 1] + 1)
        out.first, out.end = np.concatenate(first), np.concatenate(end)
    return out
