"""A forward scanner of HTML tags, in time proportional to the page.

Tags are read as HTML's tokenizer does: a name, then attributes, whose quotes open a value only after ``=``. A page is
passed once: what would have no end is known beforehand from the last ``>`` and, for elements that nest, from pairs of their tags that are
matched once a page, so nothing is looked for twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is text up to their own end tag, or to the end of the page.
TO_END = frozenset("script style textarea title".split())
#: Elements that hold elements of their own kind, and those of them whose tag may close itself.
NESTED, SELF_CLOSED = frozenset("svg math object template".split()), frozenset("svg math".split())
#: Elements that end at any tag of theirs: a second opening tag tells that the first has no end.
FLAT = frozenset("button select canvas noscript iframe".split())

_WHITE = r"[\t\n\f\r ]"
_ATTRIBUTE = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_WHITE}*+={_WHITE}*+(?>\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]*+))?+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_ATTRIBUTE})*+)>")
#: A tag whose quoted value would run past the last ``>``: it ends at the first one.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*+)([^>]*+)>")
_ENDS_COMMENT = re.compile("--!?>")
_END_TAG = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])[^>]*+>", re.I) for t in TO_END}
_EITHER = {t: re.compile(rf"<(/?){t}(?=[\t\n\f\r />])", re.I) for t in NESTED | FLAT}
#: An option also ends before any tag but those that the caller names.
_OPTION = "option"

TEXT, OPEN, CLOSE = 0, 1, 2


class _Ends:
    """Where the raw elements of one page end."""

    def __init__(self, page: str, stop: int, inside_option: re.Pattern) -> None:
        self.page, self.stop, self.inside = page, stop, inside_option
        self.pairs: dict[str, dict[int, int]] = {}
        self.gone: set[str] = set()

    def _paired(self, tag: str) -> dict[int, int]:
        """Ends of the opening tags of ``tag`` by their places; those without an end tag have none."""
        own, open_ = {}, []
        for m in _EITHER[tag].finditer(self.page, 0, self.stop):
            if not m.group(1):
                whole = _TAG.match(self.page, m.start()) if tag in SELF_CLOSED else None
                if whole is None or not whole.group(3).endswith("/"):
                    if tag in FLAT:
                        open_.clear()
                    open_.append(m.start())
            elif open_:
                own[open_.pop()] = self.page.index(">", m.end()) + 1
        return own

    def after(self, tag: str, start: int, at: int) -> int:
        """Where the raw element ends whose opening tag stands from ``start`` to ``at``; ``at`` itself where it has no end and is its tag alone."""
        if tag in NESTED or tag in FLAT:
            if tag not in self.pairs:
                self.pairs[tag] = self._paired(tag)
            return max(at, self.pairs[tag].get(start, at))
        if tag == _OPTION:
            m = self.inside.search(self.page, at, self.stop)
            return at if m is None else m.end() if m.group(1) else m.start()
        m = None if tag in self.gone else _END_TAG[tag].search(self.page, at, self.stop)
        if m is None:
            self.gone.add(tag)
            return len(self.page)
        return m.end()


def scan(page: str, raw: frozenset[str], in_option: frozenset[str] = frozenset()) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ""), (OPEN, tag, attributes as they stand) and (CLOSE, tag, "") in page order, tag names in lower case. Comments, declarations and the
    elements of ``raw`` (of TO_END, NESTED, FLAT and ``option``) are left out whole; an option ends at the first tag not in ``in_option``. A ``<`` that
    opens nothing, and a tag that never ends, are text."""
    stop = page.rfind(">") + 1
    inside = re.compile(rf"<(/option(?=[\t\n\f\r />])[^>]*+>)|</?(?!(?:{'|'.join(sorted(in_option)) or '>'})[\t\n\f\r />])[a-z]", re.I)
    ends, broken = _Ends(page, stop, inside), False
    text = at = 0
    while 0 <= (at := page.find("<", at, stop)):
        after = page[at + 1 : at + 2]
        if after == "!" and page.startswith("<!--", at):
            short = 5 if page.startswith("<!-->", at) else 6 if page.startswith("<!--->", at) else 0
            end = None if short else _ENDS_COMMENT.search(page, at + 4, stop)
            kind, tag, rest, to = None, "", "", at + short if short else end.end() if end else len(page)
        elif after in ("!", "?") or after == "/" and not page[at + 2 : at + 3].isalpha():
            kind, tag, rest, to = None, "", "", page.index(">", at) + 1
        elif after.isascii() and after.isalpha() or after == "/" and page[at + 2 : at + 3].isascii():
            m = None if broken else _TAG.match(page, at, stop)
            if m is None:
                m, broken = _BROKEN.match(page, at, stop), True
            tag, rest, to = m.group(2).lower(), m.group(3), m.end()
            kind = CLOSE if m.group(1) else OPEN
            if kind == OPEN and tag in raw:
                kind, to = None, ends.after(tag, at, to)
        else:
            at += 1
            continue
        if at > text:
            yield TEXT, page[text:at], ""
        if kind is not None:
            yield kind, tag, rest if kind == OPEN else ""
        text = at = to
        if at >= len(page):
            break
    if text < len(page):
        yield TEXT, page[text:], ""
