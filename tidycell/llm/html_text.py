"""The main text of web pages, by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order: runs of text between the starts and ends of block
elements.  Scripts, styles, titles, text fields, templates, frames and comments give no text, all other
elements do, whatever of their ends is left out; character references are decoded, white space inside a block becomes one space.  Each block has
features of its ancestors (tags, words of their classes, ids and roles, and which of these are the innermost) and of its text (length, links,
ends, digits); whether an element says that it is hidden is one of them.  The field has two labels, text and other; its weights for features
and for neighbouring labels are fitted on labelled pages, and pages are decoded by Viterbi.

Labelled pages come from two places.  ``TRAIN_PAGES`` pages of the table, chosen
by a digest of their ids, are labelled by their own markup where it says what is the article.
As many again are composed: text of those pages is laid out in
the usual ways of pages, with parts whose labels are known (menus, notices, adverts, sidebars,
forms, comments, footers), under changing tags and class names and also without telling ones.  This
bound on the training rows is a parameter; every page of the table is decoded in full.

Defined results: a null or empty page has no text; markup that is cut off or nested wrongly is read as far as
it goes; very long pages are read whole, in time in proportion to their length whatever their markup; pages are read one by one, repeated or not; with no page to learn from the composed ones use filler
words; extra columns stay.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 200
SEED = 11
STEPS = 120

#: Elements as HTML sorts them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "template", "iframe"}
#: Elements of drawings and formulas, part of the line they stand in; these may close themselves.
FOREIGN = set("svg g path circle rect line polyline polygon ellipse defs use symbol text tspan textpath lineargradient radialgradient stop clippath mask desc "
              "math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mpadded mphantom menclose mtable mtr mtd semantics annotation".split())
#: Controls: one without an end of its own is passed over, so that what follows is not taken for a part of it.
CONTROLS = {"button", "select"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object", *FOREIGN}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose start ends a paragraph.
CLOSES |= {t: {"p"} for t in "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
TAGS = {"article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "blockquote", "figure", "figcaption", "h1", "h2", "h3", "h4", "p", "li", "pre", "dl", "address", "details", "dialog", "menu", "a", "fieldset", "button", "select"}

SECTIONS = {"article", "main", "section", "nav", "header", "footer", "aside", "form", "figure", "table", "dialog", "menu", "details"}

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?<![^\s\"'/])([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_WORD = re.compile(r"[a-z]+")


class Path:
    """The features of a block's ancestors: those that one element adds, and the path above it."""

    __slots__ = ("above", "own", "section", "named", "scores")

    def __init__(self, above: Path | None, own: tuple[str, ...], section: str = "", named: tuple[str, ...] = ()):
        self.above, self.own, self.scores = above, own, None
        self.section, self.named = section, named

    def inner(self) -> list[str]:
        """What the innermost section and the innermost named element say."""
        return [f"in:{self.section}", *(f"last:{n[5:]}" for n in self.named)]

    def below(self, tag: str, feats: tuple[str, ...], fresh: tuple[str, ...]) -> Path:
        """The path within an element, some of whose features are new to it."""
        section = tag if tag in SECTIONS else self.section
        named = tuple(f for f in feats if f.startswith("name:")) or self.named
        return Path(self, fresh, section, named) if fresh or section != self.section or named != self.named else self

    def __iter__(self) -> Iterator[str]:
        at = self
        while at is not None:
            yield from at.own
            at = at.above


#: Text, features of the ancestors, features of the text.
Block = tuple[str, Path, list[str]]


def _tags(page: str) -> Iterator[tuple[int, int, str | None, str | None, str]]:
    """(start, end, "/" or "", name, attributes) of every tag; no name for comments and declarations.

    A quotation mark that is never closed counts as a character.  A tag that closed quotations leave open to the page's
    end stops at its first ``>``, as do all tags after it; without any ``>`` a last piece of a tag is no text.
    Each of these is found out once, so the time is in proportion to the page.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    quotes = True
    pos = yielded = 0
    while m := _OPEN.search(page, pos):
        start = m.start()
        if m[1]:
            end = page.find("-->", m.end())
            end = end + 3 if end >= 0 else len(page)
        elif m[2]:
            end = page.find(">", m.end()) + 1 or len(page)
        elif start > last[">"]:
            break
        else:
            at = m.end()
            while quotes and (q := _STOP.search(page, at)) and q[0] != ">":
                at = page.index(q[0], q.end()) + 1 if q.start() < last[q[0]] else q.end()
            if quotes and not q:
                quotes = False
            at = q.start() if quotes else page.index(">", m.end())
            end = at + 1
            took = yield start, end, m[3], m[4].lower(), page[m.end() : at]
            pos = yielded = max(end, took or 0)
            continue
        took = yield start, end, None, None, ""
        pos = yielded = max(end, took or 0)
    tail = page.rfind("<")
    if tail >= yielded and tail > last[">"] and re.match("[a-zA-Z/]", page[tail + 1 : tail + 2]):
        yield tail, len(page), None, None, ""


class _Element:
    """An open element; ``marks`` are the places of the inline elements open in it, by tag."""

    __slots__ = ("tag", "path", "own", "links", "marks")

    def __init__(self, tag: str, path: Path, own: tuple[str, ...], links: int):
        self.tag, self.path, self.own, self.links, self.marks = tag, path, own, links, None


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page."""
    page = page or ""
    out: list[Block] = []
    root = _Element("", Path(None, ()), (), 0)
    stack: list[_Element | None] = [root]  # None: an inline element that ended below others
    nearest = [0]  # places of the elements that are not inline
    places: dict[str, list[int]] = {}  # of these by tag
    root.marks = {}
    on: dict[str, int] = {}  # how many open elements give a feature to the path
    text: list[str] = []
    links = open_links = pos = 0

    def flush() -> None:
        nonlocal links
        if text:
            clean = " ".join("".join(text).split())
            text.clear()
            if clean:
                path = stack[nearest[-1]].path
                out.append((clean, path, _features(clean, links) + path.inner()))
            links = 0

    def take(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if open_links:
                links += len(piece)

    def leave(element: _Element) -> None:
        for f in element.own:
            on[f] -= 1

    def end_from(place: int) -> None:
        """End the elements from a place on, which holds one that is not inline."""
        nonlocal open_links
        open_links = stack[place].links
        while len(stack) > place:
            gone = stack.pop()
            if gone is not None:
                leave(gone)
                if gone.marks is not None:
                    nearest.pop()
                    places[gone.tag].pop()

    walk = _tags(page)
    found = next(walk, None)
    while found:
        start, end, slash, tag, attributes = found
        jump = end
        take(page[pos:start])
        pos = end
        if not tag:
            pass
        elif not slash and tag in RAW:
            close = _raw_end(tag).search(page, pos)
            pos = jump = close.end() if close else len(page)
        elif not slash:
            if tag not in INLINE:
                flush()
            # Text that shows ends a head, so a head as such holds none: its end, which may be left out, says nothing.
            void = tag in VOID or tag == "head" or tag in FOREIGN and attributes.endswith("/")
            if not void and not (tag in CONTROLS and not ((after := _control(tag).search(page, pos)) and after[1])):
                if tag in CLOSES and stack[nearest[-1]].tag in CLOSES[tag]:
                    # The element it ends by rule, with inline ones left open in it.
                    end_from(nearest[-1])
                    if tag == "tr" and stack[nearest[-1]].tag == "tr":
                        end_from(nearest[-1])
                own = _element(tag, attributes)
                above = stack[-1].path
                fresh = tuple(f for f in own if not on.get(f))
                for f in own:
                    on[f] = on.get(f, 0) + 1
                element = _Element(tag, above.below(tag, own, fresh), own, open_links)
                if tag in INLINE:
                    stack[nearest[-1]].marks.setdefault(tag, []).append(len(stack))
                    open_links += tag == "a"
                else:
                    element.marks = {}
                    nearest.append(len(stack))
                    places.setdefault(tag, []).append(len(stack))
                stack.append(element)
        elif tag in INLINE:
            marks = stack[nearest[-1]].marks.get(tag)
            if marks:  # an inline end closes its own element only
                place = marks.pop()
                leave(stack[place])
                stack[place] = None
                open_links -= tag == "a"
                while stack[-1] is None:
                    stack.pop()
        else:
            flush()
            if places.get(tag):
                end_from(places[tag][-1])
        try:
            found = walk.send(jump)
        except StopIteration:
            found = None
    take(page[pos:])
    flush()
    return out


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I)


@lru_cache(maxsize=None)
def _control(tag: str) -> re.Pattern:
    """The next end or start of the element."""
    return re.compile(rf"<(/?){tag}\b", re.I)


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    return _known_element(tag, attributes) if len(attributes) < 500 else _features_of(tag, attributes)


def _features_of(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element says by its tag, the words of its class, id and role, and whether it says that it is hidden."""
    feats = {f"tag:{tag}"} if tag in TAGS else set()
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            feats |= {f"name:{w}" for w in _WORD.findall(value)}
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            feats.add("hidden")
    return tuple(sorted(feats))


_UNSEEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_known_element = lru_cache(maxsize=4096)(_features_of)


def _features(text: str, links: int) -> list[str]:
    size = len(text)
    words = text.count(" ") + 1
    out = [f"chars:{min(size.bit_length(), 10)}", f"words:{min(words.bit_length(), 7)}", f"links:{min(3, int(4 * links / size))}"]
    out.append("ends:" + ("stop" if text[-1] in ".!?…\"”)" else "colon" if text[-1] == ":" else "open"))
    if text[0] in "©" or "©" in text[:40]:
        out.append("copyright")
    digits = sum(c.isdigit() for c in text[:200])
    if 4 * digits > min(size, 200):
        out.append("digits")
    return out


class Field:
    """A linear-chain conditional random field with the labels 0 (other) and 1 (text)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, chain: np.ndarray):
        self.chain = chain
        self.bias = tuple(weights[0].tolist())
        self.weights = {f: tuple(weights[i].tolist()) for f, i in names.items()}
        self.key = object()  # marks the scores that paths keep

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "key"}

    def __setstate__(self, state):
        self.__dict__.update(state, key=object())

    def _sum(self, features) -> tuple[float, float]:
        known = [self.weights[f] for f in features if f in self.weights]
        return sum(w[0] for w in known), sum(w[1] for w in known)

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for _, path, own in page:
            above = self._above(path)
            text = self._sum(own)
            out.append((self.bias[0] + above[0] + text[0], self.bias[1] + above[1] + text[1]))
        return out

    def _above(self, path: Path) -> tuple[float, float]:
        """The sum over a path, kept at each of its elements."""
        todo = []
        at: Path | None = path
        while at is not None and (at.scores is None or at.scores[0] is not self.key):
            todo.append(at)
            at = at.above
        a, b = at.scores[1] if at is not None else (0.0, 0.0)
        for at in reversed(todo):
            x, y = self._sum(at.own)
            a, b = a + x, b + y
            at.scores = (self.key, (a, b))
        return a, b

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not page:
            return []
        score = self.scores(page)
        (c00, c01), (c10, c11) = self.chain.tolist()
        a, b = score[0]
        back = []
        for s0, s1 in score[1:]:
            f0, f1 = b + c10 > a + c00, b + c11 > a + c01
            back.append((f0, f1))
            a, b = (b + c10 if f0 else a + c00) + s0, (b + c11 if f1 else a + c01) + s1
        label = int(b > a)
        labels = [label]
        for f in reversed(back):
            label = int(f[label])
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient ascent; all pages advance together, block by block."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    seen: dict[str, int] = {}
    for page, _ in pages:
        for _, path, own in page:
            for f in (*path, *own):
                seen[f] = seen.get(f, 0) + 1
    names = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    length = np.array([len(p[0]) for p in pages])
    most = int(length.max()) if len(pages) else 0
    x = np.zeros((int(length.sum()), len(names) + 1), np.float32)
    y = np.zeros((len(pages), most), np.int64)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    for k, (path, own) in enumerate((path, own) for page, _ in pages for _, path, own in page):
        x[k, [0, *(names[f] for f in (*path, *own) if f in names)]] = 1
    on = np.arange(most)[None, :] < length[:, None]
    gold = np.eye(2)[y] * on[..., None]
    gold_chain = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    weights, chain = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, chain)]
    for step in range(steps if len(pages) else 0):
        s = np.zeros((len(pages), most, 2))
        s[on] = x @ weights.astype(np.float32)
        fwd, bwd = np.zeros(s.shape), np.zeros(s.shape)
        fwd[:, 0] = s[:, 0]
        for t in range(1, most):
            fwd[:, t] = s[:, t] + np.logaddexp.reduce(fwd[:, t - 1, :, None] + chain, axis=1)
        for t in range(most - 2, -1, -1):
            after = np.logaddexp.reduce((s[:, t + 1] + bwd[:, t + 1])[:, None, :] + chain, axis=2)
            bwd[:, t] = np.where((t == length - 1)[:, None], 0.0, after)
        total = np.logaddexp.reduce(fwd[np.arange(len(pages)), length - 1], axis=1)
        prob = np.exp(fwd + bwd - total[:, None, None]) * on[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + chain + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
        blocks_n = on.sum()
        grads = (
            x.T @ (gold - prob)[on].astype(np.float32) / blocks_n - ridge * weights,
            (gold_chain - pair.sum((0, 1))) / blocks_n - ridge * chain,
        )
        for w, g, m in zip((weights, chain), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w += 0.15 * (m[0] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m[1] / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Field(names, weights, chain)


# Names that pages commonly give to the parts whose labels are known.
PARTS = {
    "menu": (["nav", "div", "ul", "header", "menu"], ["nav", "navbar", "menu", "main-menu", "site-nav", "navigation", "topbar", "breadcrumb", "breadcrumbs", "tabs", "toc", ""]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "branding", "logo", "site-title", "top", "hero", ""]),
    "notice": (["div", "aside", "section", "dialog", "p"], ["cookie-notice", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "message", "warning", "paywall"]),
    "advert": (["div", "aside", "section", "p", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner", "adsbox", "ad-slot", "promoted"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "widgets", "related", "recommended", "popular", "trending", "more", "secondary", "rail", "aside", ""]),
    "form": (["form", "div", "section"], ["form", "search", "newsletter", "subscribe", "signup", "login", "contact", "register", "subscription"]),
    "comments": (["section", "div", "ol", "ul", "aside"], ["comments", "comment", "comment-list", "commentlist", "discussion", "replies", "responses", "reader-comments", "disqus", "user-comments", "feedback"]),
    "share": (["div", "ul", "p"], ["share", "social", "sharing", "share-buttons", "tags", "meta", "byline", "author", "pagination", "pager", "tools", "buttons"]),
    "footer": (["footer", "div", "section"], ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer", "imprint"]),
}
ARTICLE = (["article", "main", "div", "section"], ["article", "post", "entry", "content", "post-content", "article-body", "entry-content", "main", "story", "text", "body", "main-content", "page-content", "single", "", ""])
WORDS = "the of and to in is that for it was on with as by this from at an be or".split()


def compose(rng: random.Random, sentences: list[str]) -> tuple[str, list[int]]:
    """A page of known labels, laid out at random from the given sentences."""
    labels: list[int] = []

    def phrase(low: int, high: int) -> str:
        words = rng.choice(sentences).split() or WORDS
        return html.escape(" ".join(words[: rng.randint(low, high)])) or "more"

    def block(tag: str, inner: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{inner}</{tag}>"

    def wrap(kind: tuple, inner) -> str:
        tags, names = kind
        tag, name = rng.choice(tags), rng.choice(names)
        attribute = rng.choice([f' class="{name}"', f' id="{name}"', f' class="box {name}"']) if name else ""
        if kind is not ARTICLE and rng.random() < 0.1:
            attribute += rng.choice([" hidden", ' aria-hidden="true"', ' style="display:none"'])
        return f"<{tag}{attribute}>{inner(tag)}</{tag}>"

    def links(tag: str) -> str:
        item = "li" if tag in ("ul", "ol", "menu") or rng.random() < 0.5 else "div"
        body = "".join(block(item, f'<a href="/{i}">{phrase(1, 5)}</a>', 0) for i in range(rng.randint(2, 8)))
        return f"<ul>{body}</ul>" if item == "li" and tag not in ("ul", "ol") else body

    def short(tag: str) -> str:
        if tag == "p" or rng.random() < 0.4:
            labels.append(0)
            return phrase(3, 25)
        return "".join(block(rng.choice(["p", "div", "h3"]), phrase(2, 30), 0) for _ in range(rng.randint(1, 3)))

    def form(tag: str) -> str:
        return block("p", phrase(2, 12), 0) + '<input type="text">' + f'<select>{block("option", "all", 0)}</select>' + block("button", "ok", 0)

    def comments(tag: str) -> str:
        item = "li" if tag in ("ol", "ul") else rng.choice(["div", "p", "article"])
        head = block("h3", phrase(1, 4), 0) if rng.random() < 0.6 and tag not in ("ol", "ul") else ""
        return head + "".join(f"<{item}{rng.choice(['', ' class=\"comment\"'])}>{block('p', phrase(4, 90), 0)}</{item}>" for _ in range(rng.randint(1, 4)))

    def foot(tag: str) -> str:
        return block("p", f"&copy; {phrase(2, 15)}", 0) if rng.random() < 0.6 else short(tag) if rng.random() < 0.5 else links(tag)

    makers = {"menu": links, "header": short, "notice": short, "advert": short, "sidebar": lambda t: links(t) if rng.random() < 0.5 else short(t), "form": form, "comments": comments, "share": links, "footer": foot}

    def part(kind: str) -> str:
        return wrap(PARTS[kind], makers[kind])

    def article(tag: str) -> str:
        inner = [block("h1", phrase(2, 16), 1)] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.72:
                inner.append(block("p", rng.choice([phrase(2, 150), phrase(1, 6)]), 1))
            elif roll < 0.80:
                inner.append(block(rng.choice(["h2", "h3"]), phrase(1, 8), 1))
            elif roll < 0.88:
                inner.append("<ul>" + "".join(block("li", phrase(1, 25), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif roll < 0.92:
                inner.append(block("blockquote", phrase(3, 40), 1))
            else:
                inner.append(part(rng.choice(["advert", "share", "notice", "form", "sidebar"])))
            if len(labels) % 5 == 0:
                inner.append(block("button", "share this", 0))
        if rng.random() < 0.2:
            inner.append(part("comments"))
        return "".join(inner)

    page = [part(k) for k in ("menu", "header") if rng.random() < 0.7]
    page += [part(k) for k in rng.sample(["notice", "advert", "sidebar", "form", "share"], rng.randint(0, 3))]
    page.append(wrap(ARTICLE, article))
    page += [part(k) for k in rng.sample(["share", "advert", "sidebar", "form", "notice"], rng.randint(0, 3))]
    page += [part(k) for k in ("comments", "footer") if rng.random() < 0.6]
    return f"<html><body>{''.join(page)}</body></html>", labels


#: Ancestors that say what a block is, for pages of the table.
INSIDE = {"tag:article", "tag:main"}
OUTSIDE = {"tag:nav", "tag:aside", "tag:footer", "tag:form", "tag:header", "tag:button", "tag:select", *(f"name:{w}" for k, (_, names) in PARTS.items() for n in names for w in n.split("-") if w not in ("main", "top", "text", "more", "side", "message"))}


def own_labels(page: list[Block]) -> list[int] | None:
    """Labels by a page's own markup; None if it doesn't say."""
    labels = []
    for _, path, _ in page:
        f = set(path)
        labels.append(int(bool(INSIDE & f) and not OUTSIDE & f))
    return labels if any(labels) else None


def train(pages: DataFrame, bound: int = TRAIN_PAGES, seed: int = SEED) -> Field:
    """A field fitted on ``bound`` pages of the table and as many composed ones."""
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).where("html is not null")
    digest = F.xxhash64("page_id")
    # Some twice the bound are looked at, by a digest, so that no task sends the driver more than its few.
    rows = rows.where(F.pmod(digest, F.lit(max(1, pages.count() // (2 * bound)))) == 0).orderBy(digest, "html").limit(bound).collect()
    read = [blocks(r.html) for r in rows]
    told = [(p, labels) for p in read if (labels := own_labels(p))]
    sentences = sorted({t for p in read for t, _, _ in p}) or [" ".join(WORDS)]
    rng = random.Random(seed)
    for _ in range(bound):
        page, labels = compose(rng, sentences)
        made = blocks(page)
        if len(made) == len(labels):
            told.append((made, labels))
    return fit(told)


def text_of(page: str | None, field: Field) -> str:
    found = blocks(page)
    return " ".join(t for (t, _, _), label in zip(found, field.decode(found)) if label)


def _extract(field, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            texts = [text_of(h, model) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "__text"])

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``pages`` with __text, the main text."""
    field = field or train(pages)
    model = pages.sparkSession.sparkContext.broadcast(field)  # some hundred weights
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(_extract(model, pages.columns.index("html")), f"{fields}, __text string")
