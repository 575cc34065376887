"""Training of the block labeller, and its kept weights (``html_model.npz``).

``python -m barloom.llm.html_model`` trains again from the seed and writes the weights. The training pages are
layouts drawn at random: an article with headings, paragraphs, lists, quotes and tables, in one of many containers,
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments. A page's ``style`` tells how its parts are
marked: by semantic elements and class names (``marked``), by ``div`` elements without telling names (``plain``), or not
even by elements of their own, with text and line breaks right in a container (``bare``). Attributes of any length stand on any tag. Words are drawn anew for each page.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

from .html_blocks import N_IN, TAGS, _lstm, blocks, label, vectors

WEIGHTS = Path(__file__).with_name("html_model.npz")

#: Names that page parts go by in markup, by kind.
NAMES = {
    "nav": "nav navbar menu navigation main-menu topnav breadcrumb breadcrumbs pagination pager tabs toc site-nav",
    "header": "header masthead site-header top banner branding logo topbar page-header",
    "footer": "footer site-footer bottom colophon copyright legal footer-links page-footer",
    "side": "sidebar aside related side-column widget widgets rail recommended popular secondary more-stories trending tags",
    "notice": "cookie cookie-banner notice consent gdpr alert popup modal newsletter-popup disclaimer message",
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbox sponsor ad-slot",
    "form": "form search-form subscribe newsletter signup login contact-form searchbox",
    "comments": "comments comment comment-list replies reader-comments discussion responses disqus",
    "share": "share social share-buttons social-links sharing follow byline meta post-meta",
}
BODY = "content article post entry entry-content post-content main main-content story article-body text body page-content blog-post prose".split()
SAYS = {
    "nav": ["Home", "Menu", "Start", "Inicio", "Accueil", "Next", "Previous", "You are here"],
    "notice": ["We use cookies to improve this site", "Please accept our cookies", "This site uses cookies", "Subscribe to continue reading", "Wir verwenden Cookies", "Ce site utilise des cookies", "Este sitio usa cookies"],
    "form": ["Search", "Your email", "Subscribe", "Name", "Password", "Sign in", "Send"],
    "footer": ["© 2024 All rights reserved", "© 2019 {w} {w}. All rights reserved", "Copyright © {w} {w} {w}, all rights reserved.", "© {w} 2023", "Privacy policy", "Terms of use", "Contact us", "© {w} · {w} {w}.", "Impressum · Datenschutz", "Mentions légales", "Aviso legal"],
    "ad": ["Advertisement", "Sponsored", "Buy now and save", "Special offer", "Anzeige", "Publicité", "Publicidad"],
    "share": ["Share this", "Follow us", "Posted by {w}", "2 min read"],
    "comments": ["Reply", "Leave a comment", "{w} says:", "3 comments", "Comments", "12 Kommentare", "Commentaires", "Comentarios"],
    "side": ["Related", "Most read", "More stories", "Popular posts", "See also", "Mehr zum Thema", "À lire aussi"],
    "header": ["{w} News", "The {w}", "{w} {w} – {w}"],
}
STYLES = ("marked", "plain", "bare")


class Page:
    def __init__(self, rng: np.random.Generator, style: str | None = None, long_attributes: bool | None = None) -> None:
        self.rng, self.out, self.want = rng, [], []
        letters = "aeiounrstlhdcméüñößçä"
        self.vocab = ["".join(rng.choice(list(letters), rng.integers(1, 10))) for _ in range(60)]
        self.style = style or self.pick(["marked", "marked", "marked", "plain", "plain", "bare"])
        self.long = self.chance(0.25) if long_attributes is None else long_attributes

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def words(self, a: int, b: int) -> str:
        n = int(self.rng.integers(a, b))
        t = " ".join(self.pick(self.vocab) for _ in range(n)).capitalize()
        if self.chance(0.15):
            junk = self.pick(["***", "!!", " |", "###"])
            t = t.replace(" ", junk + " ") + (junk if self.chance(0.3) else "")
        return t + (self.pick([".", ".", "", "?", "!"]))

    def say(self, kind: str, p: float = 0.5) -> str:
        return self.pick(SAYS[kind]).format(w=self.pick(self.vocab)) if kind in SAYS and self.chance(p) else self.words(1, 14)

    def more(self) -> str:
        """Attributes that tell nothing, of any length."""
        if not self.chance(0.5 if self.long else 0.1):
            return ""
        n = int(self.rng.integers(100, 400)) if self.long else int(self.rng.integers(1, 40))
        return f' {self.pick(["data-q", "style", "data-id", "onclick", "data-class"])}="{"".join(self.rng.choice(list("abcdefgh /:;=-0123456789"), n))}"'

    def block(self, tag: str, text: str, main: bool, inner: str | None = None) -> None:
        self.out.append(f"<{tag}{self.more()}>{inner or text}</{tag.split(' ')[0]}>")
        self.want.append((text, main))

    def text_block(self, tag: str, text: str, main: bool) -> None:
        if self.chance(0.2):
            w = text.split(" ")
            k = int(self.rng.integers(len(w)))
            inner = " ".join([*w[:k], self.pick(["<b>{}</b>", "<a href='/x'>{}</a>", "<a href=/x/>{}</a>", "<em>{}</em>"]).format(w[k]), *w[k + 1 :]])
            self.block(tag, text, main, inner)
        else:
            self.block(tag, text, main)

    def odd(self) -> str:
        """A class that tells nothing, or none."""
        return f' class="{self.pick(["c", "x", "row", "col", "css", "box", "wrap"])}{int(self.rng.integers(100))}"' if self.chance(0.3) else ""

    def open(self, kind: str, element: str | None) -> str:
        if self.style != "marked" and not self.chance(0.15):
            tag = "form" if kind == "form" else "div"
            self.out.append(f"<{tag}{self.odd()}{self.more()}>")
            return tag
        tag = element if element and self.chance(0.5) else self.pick(["div", "div", "section"])
        mark = self.pick(["class", "class", "id"])
        name = self.pick(NAMES[kind].split()) if tag != element or self.chance(0.4) else None
        first, last = (self.more(), "") if self.chance(0.5) else ("", self.more())
        self.out.append(f'<{tag}{first} {mark}="{name}"{last}>' if name else f"<{tag}{first}{last}>")
        return tag

    def boiler(self, kind: str) -> None:
        tag = self.open(kind, {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind))
        told = self.style == "marked"  # elsewhere the first words must tell what it is
        if kind == "nav" and not told and self.chance(0.3):  # links in a row, no list
            n = int(self.rng.integers(3, 9))
            t = [self.words(1, 3).rstrip(".?!") for _ in range(n)]
            bar = self.pick([" | ", " ", " · "])
            self.out.append(bar.join(f'<a href="/x">{x}</a>' for x in t))
            self.want.append((bar.join(t), False))
        elif kind in ("nav", "side", "footer", "header") and self.chance(0.75 if kind == "nav" else 0.4):
            if kind != "nav" and (not told or self.chance(0.3)):
                self.block(self.pick(["h3", "h4", "p", "div"]), self.say(kind, 0.9), False)
            self.out.append("<ul>")
            for _ in range(int(self.rng.integers(2, 9))):
                t = self.words(1, 5).rstrip(".?!") if self.chance(0.9) else self.words(3, 12)
                self.block("li", t, False, f'<a href="/x">{t}</a>')
            self.out.append("</ul>")
        elif kind == "comments":
            if not told or self.chance(0.3):
                self.block(self.pick(["h2", "h3", "h4", "div"]), self.say(kind, 1 if not told else 0.8), False)
            for _ in range(int(self.rng.integers(1, 6))):
                inner = self.chance(0.5)
                if inner:
                    self.out.append(f'<div class="{self.pick(["comment", "comment-body", "reply", "c"])}"{self.more()}>' if told else "<div>")
                if self.chance(0.4):
                    self.block(self.pick(["h4", "p", "p", "div"]), self.say("comments"), False)
                for _ in range(int(self.rng.integers(1, 3))):
                    self.text_block(self.pick(["p", "p", "div"]), self.words(4, 60), False)
                if inner:
                    self.out.append("</div>")
        else:
            n = int(self.rng.integers(1, 4))
            p = 0.95 if not told else 0.5
            if n == 1 and self.chance(0.5):  # text right in the container
                t = self.say(kind, p)
                self.out.append(t)
                self.want.append((t, False))
            else:
                for k in range(n):
                    self.text_block(self.pick(["p", "div", "p", "h3"]), self.say(kind, p) if not told and k == 0 else self.say(kind) if self.chance(0.8) else self.words(5, 40 if told else 12), False)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        wrap, bare = [], self.style == "bare"
        for _ in range(int(self.rng.integers(1, 3)) if self.style == "marked" else int(self.rng.integers(0, 3))):
            if self.style != "marked":
                tag = self.pick(["div", "div", "div", "section"])
                self.out.append(f"<{tag}{self.odd()}{self.more()}>")
            else:
                tag = self.pick(["article", "article", "main", "div", "div", "section"])
                self.out.append(f"<{tag}{self.more()}>" if tag in ("article", "main") and self.chance(0.7) else f'<{tag}{self.more()} {self.pick(["class", "id"])}="{self.pick(BODY)}">')
            wrap.append(tag)
        if self.chance(0.85):
            self.text_block(self.pick(["h1", "h1", "h2"]), self.words(2, 12), True)
        if self.chance(0.12):
            self.boiler("share")
        para = ["p"] if self.style == "marked" else self.pick([["p"], ["div"], ["p", "div"]])
        n = int(self.rng.integers(20, 140)) if self.chance(0.03) else int(self.rng.integers(1, 14))
        again = self.words(1, 6) if self.chance(0.06) else ""  # a line that comes again and again
        if bare:  # text right in the container, or in the page, broken by line breaks
            if not wrap:
                self.out.append(self.pick(["<hr>", "<p></p>", "<div></div>"]))
            for _ in range(int(self.rng.integers(1, 4))):
                parts = [self.words(8 if self.style != "marked" else 1, 90) for _ in range(int(self.rng.integers(1, 6)))]
                self.out.append(self.pick(["<br><br>", "<br>", "<br/><br/>\n"]).join(parts))
                self.want.append((" ".join(parts), True))
                self.text_block(self.pick(["h2", "h3", "p"]), self.words(2, 9), True)
            n = int(self.rng.integers(0, 4))
        for _ in range(n):
            kind = self.rng.random()
            if kind < 0.68:
                text = again if again and self.chance(0.7) else self.words(1 if self.style == "marked" else 4, 90)
                if self.chance(0.25) and "p" in para:  # left open
                    self.out.append("<p>" + ("<b>" if self.chance(0.5) else "") + text + ("<br>" if self.chance(0.5) else ""))
                    self.want.append((text, True))
                    self.out.append("<p>")
                    t = self.words(2, 60)
                    self.out.append(t + "</p>")
                    self.want.append((t, True))
                else:
                    self.text_block(self.pick(para), text, True)
            elif kind < 0.78:
                self.text_block(self.pick(["h2", "h3"]), self.words(1, 8), True)
            elif kind < 0.88:
                self.out.append(tag := self.pick(["<ul>", "<ol>"]))
                for _ in range(int(self.rng.integers(2, 6))):
                    self.text_block("li", self.words(2, 20), True)
                self.out.append("</" + tag[1:])
            elif kind < 0.93:
                self.text_block("blockquote", self.words(5, 40), True)
            elif kind < 0.96:
                self.out.append("<table><tr>")
                for _ in range(int(self.rng.integers(2, 6))):
                    self.block("td", self.words(1, 4), True)
                self.out.append("</tr></table>")
            else:
                self.boiler(self.pick(["ad", "share", "form"]))
        for tag in reversed(wrap):
            self.out.append(f"</{tag}>")

    def draw(self) -> tuple[str, list[tuple[str, bool]]]:
        self.out.append('<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>')
        for kind, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.8), ("ad", 0.4), ("form", 0.15), ("side", 0.2)):
            if self.chance(p):
                self.boiler(kind)
        if self.chance(0.97):
            self.article()
        for kind, p in (("share", 0.15), ("comments", 0.35), ("side", 0.3), ("ad", 0.2), ("form", 0.15), ("nav", 0.1), ("footer", 0.8), ("notice", 0.1)):
            if self.chance(p):
                self.boiler(kind)
        if self.chance(0.9):
            self.out.append("</body></html>")
        return "".join(self.out), self.want


def layout(seed: int, style: str | None = None, long_attributes: bool | None = None) -> tuple[str, list[tuple[str, bool]]]:
    """A random page and its blocks with their labels."""
    return Page(np.random.default_rng(seed), style, long_attributes).draw()


def sample(seeds: range, style: str | None = None, long_attributes: bool | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for s in seeds:
        page, want = layout(s, style, long_attributes)
        b = blocks(page)
        if len(b.texts) != len(want):
            raise ValueError(f"layout {s}: {len(b.texts)} blocks of {len(want)}")
        out.append((vectors(b), np.array([y for _, y in want], np.float32)))
    return out


def start(hidden: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.1, (N_IN, 4 * hidden)).astype(np.float32)
        p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        p["b" + d] = np.zeros(4 * hidden, np.float32)
        p["v" + d] = rng.normal(0, 0.3, hidden).astype(np.float32)
    return p | {"vx": np.zeros(N_IN, np.float32), "c": np.zeros(1, np.float32)}


def _back(x: np.ndarray, keep: list, u: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction through time."""
    n = u.shape[0]
    dh, dc, du = np.zeros_like(dh_out[:, 0]), np.zeros_like(dh_out[:, 0]), np.zeros_like(u)
    dz_all = np.zeros((x.shape[0], x.shape[1], 4 * n), np.float32)
    for t in reversed(range(x.shape[1])):
        h, c, i, f, o, g, c_new, m = keep[t]
        dh = dh + dh_out[:, t]
        th = np.tanh(c_new)
        dcn = m * (dc + dh * o * (1 - th * th))
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), m * dh * th * o * (1 - o), dcn * i * (1 - g * g)], 1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + dcn * f
    return np.tensordot(x, dz_all, ([0, 1], [0, 1])), du, dz_all.sum((0, 1))


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 32, epochs: int = 12, batch: int = 32, rate: float = 0.01, drop: float = 0.25, soft: float = 0.01, seed: int = 5) -> dict:
    """Adam on the log loss of all blocks, their labels smoothed by ``soft``; what is returned is the running mean of the weights. Some input slots of names and words are blanked at random, so that no single one
    decides alone; those of tags are not."""
    rng, p = np.random.default_rng(seed), start(hidden, seed)
    mean = {k: v.copy() for k, v in p.items()}
    mom, sq, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) + rng.random() * 12)
        starts = rng.permutation(range(0, len(order), batch))
        for a in starts:
            own = [pages[i] for i in order[a : a + batch]]
            steps = max(len(x) for x, _ in own)
            x, live, y = np.zeros((len(own), steps, N_IN), np.float32), np.zeros((len(own), steps), np.float32), np.zeros((len(own), steps), np.float32)
            for k, (v, t) in enumerate(own):
                x[k, : len(v)] = v * ((rng.random(N_IN) > drop * rng.random()) | (np.arange(N_IN) < TAGS))
                live[k, : len(v)], y[k, : len(v)] = 1, soft + (1 - 2 * soft) * t
            kf, kb = [], []
            hf = _lstm(x, live, p["wf"], p["uf"], p["bf"], kf)
            hb = _lstm(x[:, ::-1], live[:, ::-1], p["wb"], p["ub"], p["bb"], kb)[:, ::-1]
            z = hf @ p["vf"] + hb @ p["vb"] + x @ p["vx"] + p["c"]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * live / live.sum()
            g = {"vf": np.tensordot(hf, d, ([0, 1], [0, 1])), "vb": np.tensordot(hb, d, ([0, 1], [0, 1])), "vx": np.tensordot(x, d, ([0, 1], [0, 1])), "c": np.array([d.sum()])}
            g["wf"], g["uf"], g["bf"] = _back(x, kf, p["uf"], d[:, :, None] * p["vf"])
            g["wb"], g["ub"], g["bb"] = _back(np.ascontiguousarray(x[:, ::-1]), kb, p["ub"], (d[:, :, None] * p["vb"])[:, ::-1])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale, lr = min(1.0, 1.0 / (norm + 1e-9)), rate * max(0.03, 1 - epoch / (epochs - 1)) if epochs > 1 else rate
            for k in p:
                v = (g[k] * scale).astype(np.float32) + 1e-5 * p[k]
                mom[k] = 0.9 * mom[k] + 0.1 * v
                sq[k] = 0.999 * sq[k] + 0.001 * v * v
                p[k] = (p[k] - lr * (mom[k] / (1 - 0.9**step)) / (np.sqrt(sq[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                keep = min(0.998, 1 - 1 / step)
                mean[k] = keep * mean[k] + np.float32(1 - keep) * p[k]
    return mean


def accuracy(pages: list[tuple[np.ndarray, np.ndarray]], p: dict) -> float:
    got = label([x for x, _ in pages], p)
    return float(np.mean(np.concatenate([g == (y > 0) for g, (_, y) in zip(got, pages)])))


def load() -> dict:
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def held_out(p: dict, pages: int = 300) -> dict[str, float]:
    """Share of right blocks on layouts not trained on, by kind of layout."""
    kinds = {style: (style, None) for style in STYLES} | {"long attributes": (None, True)}
    return {name: accuracy(sample(range(100_000, 100_000 + pages), *kind), p) for name, kind in kinds.items()}


if __name__ == "__main__":
    from multiprocessing import Pool

    with Pool() as pool:
        drawn = pool.map(sample, [range(a, a + 500) for a in range(0, 16_000, 500)])
    model = train([page for part in drawn for page in part])
    print("held-out accuracy", held_out(model))
    np.savez_compressed(WEIGHTS, **model)
