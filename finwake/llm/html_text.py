"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, each with
its open ancestors. Every block gets features of its ancestor tags, their class and id
words, and its text; a chain CRF with the labels ``boilerplate`` and ``content`` is
decoded by Viterbi, and the content blocks are the main text.

The CRF is trained here, by averaged gradient steps on the exact conditional likelihood
(forward-backward), on labelled pages: by default pages drawn from a seeded grammar of
layouts (articles with and without semantic tags, menus, banners, side columns, notices,
adverts, forms, footers and reader comments), whose labels are known by construction.
Own labelled pages can be given instead.

Edge cases: null and empty pages give an empty text; unclosed, crossed and cut-off tags
are read as browsers do, as far as block structure goes; a page of plain text is one
block; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_BITS = 14
LABELS = 2  # 0 boilerplate, 1 content
# Fixed values of HTML: elements whose content is no text, elements without content, and inline elements.
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas audio video head title".split())
FALLBACK = frozenset("svg math object select canvas audio video".split())  # of these, only a closed one hides what follows
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
DEPTH = 512  # elements nested deeper count as part of the last one, as in browsers
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Words that notices, adverts and forms are made of.
_SAYS = ("cookie", "subscribe", "newsletter", "sign up", "log in", "advert", "sponsored", "privacy", "accept", "read more", "share", "comment", "related", "skip to")
_SPACE = re.compile(r"[\s\xa0]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every comment, declaration and tag, in time linear in the page.

    A tag ends at the first ``>`` outside quotes; where quotes never close, at the first ``>``
    at all. Whether a scan outside quotes reaches the end of the page from some stop is
    remembered, as is the stop after a place, so nothing is scanned again and again.
    """
    size, last = len(page), page.rfind(">")
    dead: set[int] = set()  # stops outside quotes from which no tag ends
    known = (0, -1)  # no stop lies between these two places

    def tag_end(at: int) -> int:
        nonlocal known
        visited = []
        while True:
            if not known[0] <= at <= known[1]:
                m = _STOP.search(page, at)
                known = (at, m.start() if m else size)
            stop = known[1]
            if stop < size and page[stop] == ">":
                return stop + 1
            visited.append(stop)
            close = page.find(page[stop], stop + 1) if stop < size and stop not in dead else -1
            if close < 0:
                dead.update(visited)
                return -1
            at = close + 1

    at = 0
    while m := _OPENS.search(page, at):
        start, opening = m.start(), m[0]
        if opening == "<!--" or opening == "<![CDATA[":
            mark = "-->" if opening == "<!--" else "]]>"
            end = page.find(mark, m.end())
            end = size if end < 0 else end + len(mark)
        elif opening in ("<!", "<?"):
            end = page.find(">", m.end())
            end = size if end < 0 else end + 1
        else:
            end = tag_end(m.end()) if start < last else -1
            if end < 0 and start < last:
                end = page.find(">", m.end()) + 1
        if end < 0:  # no tag: text
            at = m.end()
            continue
        yield start, end
        at = end


class Block:
    """One leaf block: its text, its ancestors' tags and attribute words, the share of its text in links."""

    __slots__ = ("text", "tags", "words", "linked", "hidden")

    def __init__(self, text, tags, words, linked, hidden):
        self.text, self.tags, self.words, self.linked, self.hidden = text, tags, words, linked, hidden


@lru_cache(maxsize=20_000)
def _attributes(tag: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id, role and itemprop, and whether the element is hidden."""
    words, hidden = [], False
    for name, a, b, c in _ATTR.findall(tag):
        name, value = name.lower(), a or b or c
        if name == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words += [w.lower() for w in _WORDS.findall(value)]
    return tuple(words), hidden


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[tuple[str, bool]] = []  # text, in a link
    facts: list = [None]  # the stack that was last looked at, with what it says
    links = 0

    def flush():
        if parts:
            whole = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
            if whole:
                inner = sum(len(t.strip()) for t, a in parts if a)
                size = max(1, sum(len(t.strip()) for t, _ in parts))
                if facts[0] != stack:
                    tags = tuple(t for t, _, _ in stack if t not in INLINE)
                    facts[:] = stack.copy(), tags, tuple(w for _, ws, _ in stack for w in ws), any(h for _, _, h in stack)
                out.append(Block(whole, facts[1], facts[2], inner / size, facts[3]))
            parts.clear()

    def text(raw: str):
        if raw:
            parts.append((_html.unescape(raw) if "&" in raw else raw, links > 0))

    at, unclosed = 0, set()
    for start, end in tokens(page):
        token = page[start:end]
        if start < at:
            continue
        if start > at:
            text(page[at:start])
        at = end
        name = _NAME.match(token)
        if name is None:
            if token.startswith("<![CDATA["):
                text(token[9:].removesuffix("]]>"))
            continue
        tag, end = name[1].lower(), token[1] == "/"
        if not end and tag in RAW:
            if tag != "head" and not token.endswith("/>"):
                stop = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if stop is None:
                    unclosed.add(tag)
                if tag in ("select", "svg", "math", "object", "iframe", "video", "audio", "canvas", "textarea"):
                    flush()
                if stop or tag not in FALLBACK:
                    at = stop.end() if stop else len(page)
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag in VOID or tag in RAW:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                if tag == "a":
                    links = sum(t == "a" for t, _, _ in stack)
            elif not token.endswith("/>") and len(stack) < DEPTH:
                words, hidden = _attributes(token)
                if tag == "a" and links:
                    stack[:] = [s for s in stack if s[0] != "a"]  # links do not nest
                if tag == "a" or words or hidden:  # other inline elements say nothing
                    stack.append((tag, words, hidden))
                links += tag == "a" and not links
            continue
        flush()
        if end:
            closes = _HEADINGS if tag in _HEADINGS else (tag,)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
        else:
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
            if tag not in ("html", "body") and len(stack) < DEPTH:
                # a new block ends open inline elements for the layout, but links stay open only inside
                stack.append((tag, *_attributes(token)))
        links = sum(t == "a" for t, _, _ in stack)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[!/?a-zA-Z][^>]*\Z", rest)  # a tag cut off by the end of the page
        text(rest[: cut.start()] if cut else rest)
    flush()
    return out


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


@lru_cache(maxsize=200_000)
def _index(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << DIM_BITS) - 1)


@lru_cache(maxsize=100_000)
def _context(tags: tuple[str, ...], words: tuple[str, ...]) -> tuple[int, ...]:
    names = {f"anc={t}" for t in tags} | {f"w={w}" for w in words}
    names.add(f"leaf={tags[-1] if tags else ''}")
    names.add("path=" + "/".join(tags[-2:]))
    names.add("in_body" if not ({"article", "main"} & set(tags)) else "in_article")
    return tuple(_index(n) for n in sorted(names))


def block_features(b: Block) -> list[int]:
    """Indices of the block's binary features."""
    t = b.text
    n = len(t)
    low = t[:400].lower() if n < 400 else ""  # longer blocks are no notices
    words = t.count(" ") + 1
    names = (
        f"len{_bucket(n, (10, 25, 50, 100, 200, 400))}",
        f"words{_bucket(words, (2, 4, 8, 16, 32, 64))}",
        f"link{_bucket(b.linked, (0.01, 0.34, 0.67, 0.99))}",
        f"stop{_bucket(sum(t.count(c) for c in '.!?;'), (1, 2, 4))}",
        f"end{t[-1] if t[-1] in '.!?:;,' else ('a' if t[-1].isalpha() else 'o')}",
        f"copy{int('©' in t)}",
        *[f"says={w}" for w in _SAYS if w in low],
        f"hidden{int(b.hidden)}",
    )
    return [*_context(b.tags, b.words), *[_index(x) for x in names], _index("bias")]


def viterbi(emit: list[tuple[float, float]], trans: list[list[float]], start: list[float]) -> list[int]:
    """The most likely label sequence."""
    if not emit:
        return []
    s0, s1 = start[0] + emit[0][0], start[1] + emit[0][1]
    (t00, t01), (t10, t11) = trans
    back = []
    for e0, e1 in emit[1:]:
        a, b = s0 + t00, s1 + t10
        c, d = s0 + t01, s1 + t11
        back.append((0 if a >= b else 1, 0 if c > d else 1))
        s0, s1 = max(a, b) + e0, max(c, d) + e1
    y = [0 if s0 >= s1 else 1]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


class ChainCRF:
    """Weights of binary features per label, transitions and start scores."""

    def __init__(self):
        self.w = np.zeros((1 << DIM_BITS, LABELS))
        self.trans = np.zeros((LABELS, LABELS))
        self.start = np.zeros(LABELS)

    def emissions(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in feats])

    def gradient(self, feats: list[list[int]], y: list[int]):
        """Expected minus observed counts by forward-backward, and the loss."""
        e = self.emissions(feats)
        n = len(y)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = self.start + e[0]
        for i in range(1, n):
            alpha[i] = np.logaddexp(alpha[i - 1, 0] + self.trans[0], alpha[i - 1, 1] + self.trans[1]) + e[i]
        for i in range(n - 2, -1, -1):
            x = self.trans + e[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(x[:, 0], x[:, 1])
        z = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
        node = np.exp(alpha + beta - z)
        edge = np.zeros((2, 2))
        for i in range(1, n):
            edge += np.exp(alpha[i - 1][:, None] + self.trans + e[i] + beta[i] - z)
        truth = np.eye(2)[y]
        for i in range(1, n):
            edge[y[i - 1], y[i]] -= 1
        return node - truth, edge, node[0] - truth[0]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 12, rate: float = 0.3, l2: float = 1e-4, seed: int = 5):
        """Adaptive gradient steps page by page in a seeded order; the average of the last half is kept."""
        rng = random.Random(seed)
        g2, t2, s2 = np.full_like(self.w, 1e-2), np.full_like(self.trans, 1e-2), np.full_like(self.start, 1e-2)
        kept, total = 0, [np.zeros_like(self.w), np.zeros_like(self.trans), np.zeros_like(self.start)]
        for turn in range(rounds):
            order = list(range(len(pages)))
            rng.shuffle(order)
            for p in order:
                feats, y = pages[p]
                if not y:
                    continue
                node, edge, first = self.gradient(feats, y)
                flat = np.array([f for fs in feats for f in fs])
                rows = np.repeat(np.arange(len(y)), [len(f) for f in feats])
                seen, at = np.unique(flat, return_inverse=True)
                g = np.zeros((len(seen), 2))
                np.add.at(g, at, node[rows])
                g += l2 * self.w[seen]
                g2[seen] += g * g
                self.w[seen] -= rate * g / np.sqrt(g2[seen])
                t2 += edge * edge
                self.trans -= rate * edge / np.sqrt(t2)
                s2 += first * first
                self.start -= rate * first / np.sqrt(s2)
            if turn >= rounds // 2:
                kept += 1
                for a, b in zip(total, (self.w, self.trans, self.start)):
                    a += b
        self.w, self.trans, self.start = (a / kept for a in total)
        return self

    def label(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        feats = [block_features(b) for b in blocks]
        emit = self.emissions(feats).tolist()
        return viterbi(emit, self.trans.tolist(), self.start.tolist())


# ---------------------------------------------------------------- labelled pages
_MARK = "\x01"
_BAD = (
    "nav navbar menu topnav sidebar aside ad ads advert advertisement banner promo sponsored cookie cookies consent notice alert gdpr "
    "footer site-footer header site-header masthead breadcrumb breadcrumbs share social related recommended comments comment "
    "comment-list discussion reply newsletter subscribe signup login search widget tags pagination pager copyright toolbar modal popup "
    "legal disclaimer user-comments responses"
).split()
_NEUTRAL = "wrap wrapper container row col col-8 inner outer box block left center page site layout root app grid cell panel area".split()
_GOOD = "content article post entry main story body text page-content post-body article-body entry-content main-content prose".split()


class _Pages:
    """A seeded grammar of page layouts. Content text carries a mark, so labels are known by construction."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        syllables = ("the", "an", "re", "ti", "on", "es", "que", "ou", "eau", "ge", "sch", "ung", "ci", "ar", "do", "lo", "er", "is", "à", "ü")
        return "".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def prose(self, hi: int = 5) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(1, hi)))

    def attr(self, names, chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return ""
        kind = self.r.choice(("class", "class", "class", "id"))
        extra = f" {self.word()}" if self.r.random() < 0.2 else ""
        return f' {kind}="{self.r.choice(names)}{extra}"'

    def good(self) -> str:
        r, m = self.r, _MARK
        kind = r.random()
        if kind < 0.62:
            start = f"<b>{m}{self.words(1, 6)}</b> " if r.random() < 0.15 else m
            link = f' <a href="#">{self.words(1, 4)}</a> ' if r.random() < 0.2 else " "
            if r.random() < 0.07:
                return f"<p><b>{m}{self.words(1, 12).capitalize()}.<br>"
            return f"<p>{start}{self.prose()}{link}{self.prose(2)}</p>" if r.random() < 0.7 else f"<p>{m}{self.words(1, 5).capitalize()}.</p>"
        if kind < 0.74:
            return f"<h{r.choice('234')}>{m}{self.words(1, 9).capitalize()}</h{r.choice('234')}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{m}{self.words(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote>{m}{self.prose(3)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{m}{self.prose(3)}</p></blockquote>"
        if kind < 0.94:
            return f"<pre>{m}{self.words(2, 30)}</pre>"
        if kind < 0.97:
            cells = "".join(f"<td>{m}{self.words(1, 3)}</td>" for _ in range(r.randint(2, 6)))
            return f"<table><tr>{cells}</tr></table>"
        return f"<figure><img src='x'><figcaption>{m}{self.words(2, 12)}</figcaption></figure>"

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " ".join(item() for _ in range(n))

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "div"))
        names = ["nav", "menu", "navbar", "topnav", "breadcrumb"]
        return f"<{tag}{self.attr(names, 0.6 if tag == 'nav' else 0.8)}>{self.links(self.r.randint(2, 8))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        names = ["header", "site-header", "masthead", "banner"]
        inner = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 6)}</p>", f'<a href="/">{self.words(1, 2)}</a>', self.words(1, 4)))
        return f"<{tag}{self.attr(names, 0.6 if tag == 'header' else 1)}>{inner}{self.menu() if self.r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        names = ["footer", "site-footer", "copyright", "legal"]
        inner = self.r.choice((f"&copy; {self.word()}.example &middot; {self.prose(1)}", f"<p>{self.prose(2)}</p>", self.links(4) + f"<p>&copy; {self.words(1, 5)}</p>"))
        return f"<{tag}{self.attr(names, 0.6 if tag == 'footer' else 1)}>{inner}</{tag}>"

    def hidden(self) -> str:
        how = self.r.choice(('style="display:none"', "hidden", 'aria-hidden="true"', 'style="visibility: hidden"'))
        tag = self.r.choice(("div", "p", "section"))
        inner = self.prose(3) if tag == "p" or self.r.random() < 0.3 else f"<p>{self.prose(3)}</p>"
        return f"<{tag} {how}>{inner}</{tag}>"

    def spoken(self) -> str:
        """A notice or form that only its words tell from the text."""
        r = self.r
        said = f"{self.words(0, 5)} {r.choice(_SAYS)} {self.words(0, 8)}".strip().capitalize()
        if r.random() < 0.5:
            said += f" {r.choice(_SAYS)} {self.words(0, 4)}"
        button = f"<button>{r.choice(_SAYS)}</button>" if r.random() < 0.6 else ""
        return r.choice((f"<div><p>{said}.</p>{button}</div>", f"<div>{said}.{button}</div>", f"<p>{said}</p>{button}", f"<section><p>{said}.</p>{button}</section>"))

    def advert(self) -> str:
        names = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot"]
        tag = self.r.choice(("div", "div", "aside", "section"))
        inner = self.r.choice((self.prose(2), f"<p>{self.prose(2)}</p>", f'<a href="#">{self.words(2, 8)}</a>', f"<h3>{self.words(1, 4)}</h3><p>{self.prose(3)}</p>"))
        return f"<{tag}{self.attr(names, 1)}>{inner}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div"))
        names = ["sidebar", "aside", "related", "widget", "recommended", "side"]
        inner = self.r.choice((self.links(4), f"<h3>{self.words(1, 3)}</h3>{self.links(3)}", f"<p>{self.prose(3)}</p>", f"<h3>{self.words(1, 3)}</h3><p>{self.prose(2)}</p>"))
        return f"<{tag}{self.attr(names, 0.6 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def notice(self) -> str:
        names = ["cookie", "cookies", "consent", "notice", "alert", "gdpr", "cookie-banner", "popup", "modal", "disclaimer"]
        tag = self.r.choice(("div", "div", "section", "aside"))
        role = self.r.choice(('role="alert"', 'role="dialog"', ""))
        return f"<{tag} {role}{self.attr(names, 1)}><p>{self.prose(3)}</p><button>{self.words(1, 2)}</button></{tag}>"

    def form(self) -> str:
        names = ["newsletter", "subscribe", "login", "search", "signup", "form"]
        return f"<form{self.attr(names, 0.7)}><label>{self.words(1, 4)}</label><input type='text'><p>{self.prose(1)}</p><button>{self.word()}</button></form>"

    def comments(self) -> str:
        names = ["comments", "comment-list", "discussion", "user-comments", "responses"]
        tag = self.r.choice(("section", "div", "div", "aside", "ol"))
        inner = "li" if tag == "ol" else self.r.choice(("div", "div", "article", "p", "li"))
        one = lambda: f"<{inner}{self.attr(['comment', 'reply', 'comment-body', 'user-comment'], 0.8)}>{'<p>' if inner != 'p' else ''}{self.prose(4)}{'</p>' if inner != 'p' else ''}</{inner}>"
        head = f"<h{self.r.choice('234')}>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else ""
        return f"<{tag}{self.attr(names, 1)}>{head}{''.join(one() for _ in range(self.r.randint(1, 4)))}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attr(['share', 'social', 'tags', 'toolbar', 'pagination', 'pager'], 1)}>{self.links(self.r.randint(2, 5))}</div>"

    def page(self) -> str:
        r = self.r
        head = f"<!DOCTYPE html><html lang='xx'><head><meta charset='utf-8'><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        wrap = r.choice(("article", "article", "article", "article", "main", "main", "named", "named", "section", "main+article", "main+article", "neutral", "nested", "none", "none", "cell", "blocks"))
        body = []
        title = f"<h1>{_MARK}{self.words(1, 10).capitalize()}</h1>"
        if r.random() < 0.85:
            body.append(title)
        body += [self.good() for _ in range(r.randint(1, 3 if r.random() < 0.15 else 12))]
        if wrap == "blocks":
            body = [f"<div>{_MARK}{self.prose()}</div>" for _ in body]
        if wrap == "none" and r.random() < 0.3:
            body = [f"<p>{_MARK}{self.words(1, 6)}</p>"]
        for extra, chance in ((self.hidden, 0.25), (self.advert, 0.3), (self.share, 0.25), (self.side, 0.12), (self.form, 0.12), (self.notice, 0.06)):
            if r.random() < chance:
                body.insert(r.randint(0, len(body)), extra())
        if r.random() < 0.2:
            body.append(self.comments())
        text = "".join(body)
        if wrap == "main+article":
            text = f"<main><article{self.attr(_GOOD, 0.3)}>{text}</article></main>"
        elif wrap in ("neutral", "nested"):
            for _ in range(1 if wrap == "neutral" else r.randint(2, 4)):
                text = f"<div{self.attr(_NEUTRAL, 0.6)}>{text}</div>"
        elif wrap == "named":
            name = r.choice(_GOOD) + r.choice(("", "", r.choice(_GOOD).capitalize(), "-" + r.choice(_GOOD)))
            text = f"<div {r.choice(('class', 'id'))}='{name}'>{text}</div>"
        elif wrap == "cell":
            text = f"<table><tr><td>{self.links(r.randint(2, 6))}</td><td>{text}</td></tr></table>"
        elif wrap in ("article", "main", "section"):
            text = f"<{wrap}{self.attr(_GOOD, 0.3 if wrap in ('article', 'main') else 0.9)}>{text}</{wrap}>"
        if r.random() < 0.12:
            # nothing but the text, with or without a frame
            return text if r.random() < 0.5 else f"<html><body>{text}</body></html>"
        if r.random() < 0.04:
            return _MARK + self.prose(8)
        before = [f() for f, c in ((self.header, 0.6), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4), (self.side, 0.15), (self.form, 0.1), (self.spoken, 0.15), (self.hidden, 0.06)) if r.random() < c]
        after = [f() for f, c in ((self.share, 0.2), (self.comments, 0.4), (self.side, 0.35), (self.form, 0.25), (self.advert, 0.3), (self.notice, 0.2), (self.spoken, 0.15), (self.footer, 0.8)) if r.random() < c]
        if r.random() < 0.3:
            before.insert(r.randint(0, len(before)), f"<!-- {self.words(1, 3)} -->")
        whole = "".join(before) + text + "".join(after)
        if r.random() < 0.3:
            whole = f"<div{self.attr(['wrapper', 'container', 'page', 'site', 'layout', 'root', 'app'], 0.9)}>{whole}</div>"
        return head + whole + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int = 900, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """(blocks, labels) of seeded pages."""
    made, out = _Pages(seed), []
    for _ in range(n):
        blocks = blocks_of(made.page())
        y = [int(_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MARK, "").strip() or "."
        out.append((blocks, y))
    return out


@lru_cache(maxsize=4)
def default_model(pages: int = 900, seed: int = 11) -> ChainCRF:
    return train(labelled_pages(pages, seed))


def train(pages: list[tuple[list[Block], list[int]]]) -> ChainCRF:
    return ChainCRF().fit([([block_features(b) for b in blocks], y) for blocks, y in pages], rounds=6)


# --------------------------------------------------------------------- operator
def main_text(page: str | None, model: ChainCRF) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, model.label(blocks)) if y)


def extract(pages: DataFrame, html: str = "html", model: ChainCRF | None = None, out: str = "text") -> DataFrame:
    """Every column of ``pages`` but the html, plus ``out``: the main text (empty if none)."""
    model = model or default_model()
    used = np.flatnonzero(np.abs(model.w).sum(axis=1))
    packed = (used, model.w[used], model.trans, model.start)  # a few thousand weights
    keep = [c for c in pages.columns if c not in (html, out)]
    schema = pages.select(*keep).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = ChainCRF()
        crf.w[packed[0]], crf.trans, crf.start = packed[1], packed[2], packed[3]
        for batch in batches:
            texts = [main_text(p, crf) for p in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*keep, out])

    return pages.select(*keep, html).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """The contract rows of query op9."""
    texts = extract(pages.select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
