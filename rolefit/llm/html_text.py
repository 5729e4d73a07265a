"""Operator 9: main text of HTML pages by a recurrent block labeller."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm import _hashing as H
from rolefit.llm._work import mapped

#: Fixed values of the markup: tags that begin a new block, tags without content, and tags whose content is no markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe script style svg textarea title".split())
#: Names that mark a part of a page as no article, for the teaching labels. A header inside an article belongs to it.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select option menu dialog head title fieldset legend search template noscript".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo sidebar comment comments respond reply discussion cookie consent notice popup modal newsletter subscribe menu navbar breadcrumb breadcrumbs footer header masthead related recommended share social login signup widget toolbar pagination copyright".split()
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CELLS = ("table", "td", "th", "caption", "template", "object")
_LISTS = (*_CELLS, "article", "section", "aside", "nav", "form")
#: For a start tag, the open elements that it ends, and those beyond which it ends nothing; block tags not named here end a paragraph.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_LISTS)), "dt": (("dt", "dd"), ("dl", *_LISTS)), "dd": (("dt", "dd"), ("dl", *_LISTS)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
}
_PARAGRAPH = (("p",), ("button", *_CELLS))
_OWN_BARS = {"li": ("ul", "ol", "menu", *_CELLS), "p": _PARAGRAPH[1], "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "table": (), "caption": ("table",), "template": (), "object": ()}
#: A tag whose quotes are in order and hold neither < nor >. No character is tried twice, and none beyond the next < or >.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+\"[^\"<>]*+\"|=\s*+'[^'<>]*+'|=(?!\s*[\"'])|(?<![=\s])[\"']|(?<=[^=\s])\s++[\"'])*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_QUOTE = re.compile(r"[<>]|=\s*+([\"'])")
_ANGLE = re.compile(r"[<>]")
_INNER = re.compile(r"</?[a-zA-Z]")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+>?", re.I) for t in RAW_TAGS}
_NAMED = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_WORDS_OF = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
DEPTH = 512


class Place:
    """An element's place in the tree of tags, shared by all elements with the same names on their path; one more than `DEPTH` deep has its parent's place."""

    __slots__ = ("children", "depth", "last", "main", "plain", "total", "vector")

    def __init__(self, parent: Place | None, tag: str, words: tuple[str, ...]) -> None:
        self.children: dict[tuple[str, tuple[str, ...]], Place] = {}
        self.vector = None
        if parent is None:
            self.depth, self.main, self.plain, self.total, self.last = 0, False, True, np.zeros(PATH_DIM, np.float32), np.zeros(PATH_DIM, np.float32)
            return
        _places[0] += 1
        names = [_name_vector(x) for x in (tag, *("." + w for w in words))]
        self.depth, self.last, self.total = parent.depth + 1, names[-1], parent.total + np.sum(names, axis=0)
        self.main = parent.main or tag in ("article", "main")
        marks = {w for w in words if w in BOILERPLATE_NAMES} - ({"header"} if parent.main else set())
        if tag in ("article", "main"):
            marks &= {"comment", "comments", "reply"}
        self.plain = parent.plain and not marks and (tag not in BOILERPLATE_TAGS or tag == "header" and parent.main)

    def child(self, tag: str, words: tuple[str, ...]) -> Place:
        if self.depth >= DEPTH:
            return self
        got = self.children.get((tag, words))
        if got is None:
            got = self.children[tag, words] = Place(self, tag, words)
        return got

    def path_vector(self) -> np.ndarray:
        """Sum of the hashed vectors of a path's names, and of its last name; scaled to unit length."""
        if self.vector is None:
            both = np.concatenate([self.total, self.last])
            self.vector = both / max(1e-6, float(np.linalg.norm(both)))
        return self.vector


class Block(NamedTuple):
    place: Place
    text: str
    linked: float  # share of its characters inside links
    leaf: str  # tag of the innermost element


class Tag(NamedTuple):
    end: int
    closing: bool
    name: str
    attributes: str


class _Scan:
    """Tags of a page from left to right, in time that grows with its length: what was not found once is not searched for again."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def raw_end(self, tag: str, at: int) -> tuple[int, int] | None:
        if "/" + tag in self.gone:
            return None
        m = _RAW_END[tag].search(self.page, at)
        if m is None:
            self.gone.add("/" + tag)
        return m and m.span()

    def tag(self, at: int) -> Tag | None:
        """The tag that begins at `at`. A quote that is never closed, or only inside another tag, ends nothing: the tag then goes to the next >, or to the next < before it."""
        page = self.page
        m = _TAG.match(page, at)
        if m:
            return Tag(m.end(), bool(m[1]), m[2].lower(), m[3])
        m = _NAME.match(page, at)
        if m is None:
            return None
        k = m.end()
        while q := _QUOTE.search(page, k):
            if q[1] is None:
                return Tag(q.end() if q[0] == ">" else q.start(), bool(m[1]), m[2].lower(), page[m.end() : q.start()])
            close = self.find(q[1], q.end())
            angle = _ANGLE.search(page, q.end(), close) if close >= 0 else None
            sound = close >= 0 and (close + 1 == len(page) or page[close + 1] in " \t\n\f\r/>")
            if sound and angle and angle[0] == ">" and _INNER.search(page, angle.end(), close):
                sound = False
            k = close + 1 if sound else q.end()
        return Tag(len(page), bool(m[1]), m[2].lower(), page[m.end() :])


def _words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w for g in _NAMED.findall(attributes) for w in _WORDS_OF.findall("".join(g).lower()))


#: Tags that say what a part of a page is for; teaching pages without names have plain `div`s in their place.
_TELLING = frozenset("article aside footer header hgroup main menu nav search section".split())


def blocks(page: str, bare: bool = False) -> list[Block]:
    """The text leaves of a page in order: runs of text between the starts and ends of block tags. White space becomes one space; references are decoded.

    Scripts, styles, comments, `svg`, `textarea` and the content of a closed `iframe` are no text. Of such an element without an end (but for scripts and styles, which then reach to the end
    of the page, as in a browser) only the tag goes; a comment without an end goes to the next >. `noscript`, `template`, `object` are elements like others. A tag that the page's end cuts off goes.
    Elements more than 512 deep are siblings. The time grows with the page's length, however broken it is. With `bare`, places have no names but those of tags that don't tell what they are for.
    """
    out: list[Block] = []
    root = _root()
    stack: list[tuple[str, Place]] = []
    where: dict[str, list[int]] = {}
    held: list[str] = []
    linked = link_depth = 0
    in_link = False
    scan = _Scan(page)

    def top() -> tuple[str, Place]:
        return stack[-1] if stack else ("", root)

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                if stack and stack[-1][0] == "head":
                    pop(len(stack) - 1)
                tag, place = top()
                out.append(Block(place, text, min(1.0, linked / len(text)), tag))
        held, linked = [], 0

    def pop(at: int) -> None:
        nonlocal in_link
        for tag, _ in stack[at:]:
            where[tag].pop()
        del stack[at:]
        in_link = in_link and len(stack) >= link_depth

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def end(shut: tuple[str, ...], bars: tuple[str, ...]) -> None:
        bar = last(bars)
        inside = [where[t][bisect_right(where[t], bar)] for t in shut if where.get(t) and where[t][-1] > bar]
        if inside:
            pop(min(inside))

    def text(piece: str) -> None:
        nonlocal linked
        held.append(html.unescape(piece) if "&" in piece else piece)
        if in_link:
            linked += len(piece)

    at = 0
    while True:
        k = page.find("<", at)
        if k < 0:
            if at < len(page):
                text(page[at:])
            break
        if k > at:
            text(page[at:k])
        mark = page[k + 1 : k + 2]
        if mark in ("!", "?") or mark == "/" and not page[k + 2 : k + 3].isalpha():
            if page.startswith("<!--", k):
                close = k + 4 if page.startswith((">", "->"), k + 4) else scan.find("-->", k + 4)
                close = page.find(">", close) if close >= 0 else scan.find(">", k)
            else:
                close = scan.find(">", k)
            if close < 0:
                text("<")
            at = close + 1 if close >= 0 else k + 1
            continue
        tag = scan.tag(k)
        if tag is None:
            text("<")
            at = k + 1
            continue
        at, name = tag.end, tag.name
        if name in RAW_TAGS:
            if tag.closing or tag.attributes.endswith("/") and name in ("svg", "iframe"):
                continue
            close = scan.raw_end(name, at)
            if close is None and name in ("script", "style"):
                at = len(page)
            elif close is not None:
                if name == "title":
                    flush()
                    text(page[at : close[0]])
                    title = _SPACE.sub(" ", held.pop()).strip()
                    held, linked = [], 0
                    if title:
                        out.append(Block(root.child("head", ()).child("title", ()), title, 0.0, "title"))
                at = close[1]
            if name not in ("script", "style", "title"):
                held.append(" ")
        elif name == "a":
            in_link, link_depth = not tag.closing, len(stack)
        elif name == "br":
            held.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if tag.closing:
                if name in ("body", "html"):
                    continue
                if name in _HEADINGS:
                    opened = last(_HEADINGS)
                else:
                    opened = where[name][-1] if where.get(name) else -1
                if opened >= 0 and opened > last(_OWN_BARS.get(name, _CELLS)) or opened >= 0 and name in ("table", "template", "object"):
                    pop(opened)
                continue
            if name in ("body", "html") and where.get(name):
                continue
            if stack and stack[-1][0] == "head" and name not in ("noscript", "template"):
                pop(len(stack) - 1)
            end(*_PARAGRAPH)
            if name in _ENDS:
                end(*_ENDS[name])
            if name in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                pop(len(stack) - 1)
            if name not in VOID_TAGS:
                parent = top()[1]
                where.setdefault(name, []).append(len(stack))
                if name in ("body", "html"):  # every page has them, and their classes name what the page has somewhere
                    stack.append((name, parent))
                else:
                    stack.append((name, parent.child("div" if bare and name in _TELLING else name, () if bare else _words(tag.attributes))))
    flush()
    return out


def teaching_label(block: Block) -> int:
    return int(block.place.plain)


PATH_DIM, WORD_DIM, HIDDEN, BUCKETS = 48, 16, 20, 4096
#: Besides vectors: length and its steps, length against the page's longest block, link share, place, sentence ends, and four kinds of leaf.
INPUT = 2 * PATH_DIM + WORD_DIM + 15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return r.normal(size=(BUCKETS, PATH_DIM)).astype(np.float32), r.normal(size=(BUCKETS, WORD_DIM)).astype(np.float32)


_PATHS, _WORDS = _tables()
_VALUES = H.table(5, fold_case=True)
_name_cache: dict[str, np.ndarray] = {}
_roots: list[Place] = []


def _name_vector(name: str) -> np.ndarray:
    if name not in _name_cache:
        if len(_name_cache) > 50_000:
            _name_cache.clear()
        _name_cache[name] = _PATHS[int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS]
    return _name_cache[name]


_places = [0]


def _root() -> Place:
    """The tree that pages share, begun anew once it has 50,000 places."""
    if not _roots or _places[0] > 50_000:
        _roots[:], _places[0] = [Place(None, "", ())], 0
    return _roots[0]


def _place(path: tuple[str, ...], bare: bool = False) -> Place:
    """The place of a path written as tag names, each followed by its `.names`."""
    at, k = _root(), 0
    while k < len(path):
        tag, words = path[k], []
        k += 1
        while k < len(path) and path[k][0] == ".":
            words.append(path[k][1:])
            k += 1
        at = at.child("div" if bare and tag in _TELLING else tag, () if bare else tuple(words))
    return at


_SENTENCE_ENDS = frozenset(".!?\u2026\u3002:\"\u201d")


def features(leaves: list[Block]) -> np.ndarray:
    """One row for each block: tag-path vector, mean hashed-word vector of the whole text, length, link share, place, sentence end and kind of leaf."""
    texts = [b.text.encode("utf-8", "replace") for b in leaves]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, _, words = H.word_hashes(data, _VALUES)
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    counts = np.diff(cuts)
    vectors = np.zeros((len(leaves), WORD_DIM), np.float32)
    some = counts > 0
    if len(words):
        vectors[some] = np.add.reduceat(_WORDS[(words % H.U(BUCKETS)).astype(np.int64)], cuts[:-1][some], axis=0) / np.sqrt(counts[some])[:, None]
    n, longest = len(leaves), max(map(len, texts))
    rest = np.array(
        [
            [np.log1p(len(b.text)) / 8, np.log1p(len(b.text)) / np.log1p(longest), *(len(b.text) > x for x in (20, 40, 80, 160, 320)), b.linked, k / n, (n - k) / n, b.text[-1] in _SENTENCE_ENDS, b.leaf in _HEADINGS, b.leaf == "li", b.leaf == "p", "\u00a9" in b.text]
            for k, b in enumerate(leaves)
        ],
        np.float32,
    )
    return np.concatenate([3 * np.array([b.place.path_vector() for b in leaves], np.float32), 0.2 * vectors, 2 * rest], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page, with a logistic output for each block."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        n = HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, (1 / INPUT) ** 0.5, (INPUT, 4 * n)), f"U{d}": r.normal(0, (1 / n) ** 0.5, (n, 4 * n)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], n)}
        self.p |= {"V": r.normal(0, 0.2, (2 * n, 1)), "c": np.zeros(1)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: pages, blocks, inputs; the state of a page stays as it is beyond its last block."""
        pages, steps, _ = x.shape
        h, c, out, kept = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros((pages, steps, HIDDEN)), []
        inputs = x @ self.p["W" + d] + self.p["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ self.p["U" + d]
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            s = np.tanh(c_new)
            kept.append((t, h, c, i, f, o, g, s, m))
            h, c = np.where(m, o * s, h), np.where(m, c_new, c)
            out[:, t] = h
        return out, kept

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask)[0], self._run("b", x, mask)[0]], axis=2)
        return _sigmoid((both @ self.p["V"])[..., 0] + self.p["c"])

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, total: int) -> dict[str, np.ndarray]:
        (hf, kf), (hb, kb) = self._run("f", x, mask), self._run("b", x, mask)
        both = np.concatenate([hf, hb], axis=2)
        e = (_sigmoid((both @ self.p["V"])[..., 0] + self.p["c"]) - y) * mask / total
        g = {"V": np.einsum("bth,bt->h", both, e)[:, None], "c": np.array([e.sum()])}
        back = e[..., None] * self.p["V"][:, 0]
        for d, kept, own in (("f", kf, back[..., :HIDDEN]), ("b", kb, back[..., HIDDEN:])):
            dh, dc, dz = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.zeros((*x.shape[:2], 4 * HIDDEN))
            du = np.zeros_like(self.p["U" + d])
            for t, h, c, i, f, o, gate, s, m in reversed(kept):
                dh = dh + own[:, t]
                dh_in, dc_in = dh * m, dc * m
                dcell = dc_in + dh_in * o * (1 - s * s)
                z = np.concatenate([dcell * gate * i * (1 - i), dcell * c * f * (1 - f), dh_in * s * o * (1 - o), dcell * i * (1 - gate * gate)], axis=1)
                dz[:, t] = z
                du += h.T @ z
                dh, dc = np.where(m, z @ self.p["U" + d].T, dh), np.where(m, dcell * f, dc)
            g |= {"W" + d: np.einsum("btx,btz->xz", x, dz, optimize=True), "U" + d: du, "b" + d: dz.sum(axis=(0, 1))}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.01, batch: int = 32, seed: int = 9) -> Labeller:
        r, m1, m2, n = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for turn in range(rounds):
            order, pace = r.permutation(len(pages)), rate * (1 - 0.9 * turn / rounds)
            for at in range(0, len(order), batch):
                own = [pages[k] for k in order[at : at + batch]]
                total, sums = sum(len(p[0]) for p in own), {k: 0.0 for k in self.p}
                for part in _parts(own):
                    x, mask = padded([p[0] for p in part])
                    y = np.zeros(mask.shape)
                    for k, (_, labels) in enumerate(part):
                        y[k, : len(labels)] = labels
                    for k, g in self._gradients(x, mask, y, total).items():
                        sums[k] = sums[k] + g
                n += 1
                for k, g in sums.items():
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.999**n)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self


def _parts(pages: list[tuple[np.ndarray, np.ndarray]], cells: int = 16384) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The pages of one step as they are, or in runs of like length where padded they take more than `cells` rows: a step's memory is then that of its longest page."""
    if len(pages) * max(len(p[0]) for p in pages) <= cells:
        return [pages]
    out: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for p in sorted(pages, key=lambda p: len(p[0])):
        if out and (len(out[-1]) + 1) * len(p[0]) <= cells:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(rows), max(map(len, rows)), INPUT), np.float32), np.zeros((len(rows), max(map(len, rows))), bool)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, True
    return x, mask


#: Fixed forms of page parts that teaching pages get besides their own, so that the labeller meets all kinds of boilerplate.
_EXTRAS = (
    ("header", "p"), ("header", "h1"), ("body", "div", ".header", "p"), ("aside", "p"), ("div", ".sidebar", "ul", "li"), ("div", ".cookie", ".notice", "p"), ("div", ".ad"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "p"),
    ("ul", ".comment", "li", "p"), ("form", "p"), ("form", "button"), ("div", ".newsletter", "p"), ("div", ".menu", "a"), ("nav", ".breadcrumb", "ol", "li"), ("footer", "p"), ("div", ".footer", "p"), ("div", ".related", "ul", "li"), ("div", ".share"),
)
_BODIES = (("article", "p"), ("main", "p"), ("main", "article", "p"), ("div", ".content", "p"), ("article", "h1"), ("article", "h2"), ("article", "ul", "li"), ("article", "blockquote", "p"), ("div", ".post", "p"), ("article", "table", "tr", "td"), ("p",), ("article", "div", "p"))


#: Forms of the parts of a made-up page, each with its form where nothing is named: site name, menu in one block, menu in many, notice, advert, related links, comment, form, end of the page; then the article's parts.
_PARTS = {
    "site": ((("header", "p"), ("header",), ("div", ".header", "p"), ("div", ".masthead")), (("div",), ("div", "p"), ("div", "div"))),
    "menu": ((("nav",), ("nav", "div"), ("div", ".menu"), ("header", "nav"), ("nav", ".breadcrumb", "p")), (("div",), ("div", "div"), ("p",))),
    "menus": ((("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header", "nav", "ul", "li"), ("nav", ".breadcrumb", "ol", "li")), (("ul", "li"), ("div", "ul", "li"), ("div", "div"))),
    "notice": ((("div", ".cookie", ".notice", "p"), ("div", ".consent"), ("div", ".newsletter", "p"), ("dialog", "p")), (("div", "p"), ("div",), ("div", "div"))),
    "ad": ((("div", ".ad"), ("aside", ".advert", "p"), ("div", ".sponsored")), (("div",), ("div", "div"))),
    "related": ((("aside", "ul", "li"), ("div", ".related", "ul", "li"), ("div", ".sidebar", "ul", "li"), ("aside", "p"), ("div", ".share")), (("ul", "li"), ("div", "ul", "li"), ("div", "div"))),
    "comment": ((("section", ".comments", "div", ".comment", "p"), ("ul", ".comments", "li", "p"), ("div", ".comments", "p"), ("article", "div", ".comments", "p")), (("div", "div", "p"), ("div", "div", "div", "p"))),
    "form": ((("form", "p"), ("form", "button"), ("form", "fieldset", "p")), (("form",), ("form", "div"), ("form", "button"))),
    "end": ((("footer",), ("footer", "p"), ("div", ".footer", "p"), ("footer", "div")), (("div",), ("div", "p"), ("div", "div"))),
    "h1": ((("article", "h1"), ("article", "header", "h1"), ("main", "h1"), ("h1",)), (("div", "h1"), ("h1",), ("div", "div", "h1"))),
    "p": ((("article", "p"), ("main", "p"), ("main", "article", "p"), ("div", ".content", "p"), ("p",), ("article", "div", "p"), ("article", "section", "p")), (("div", "p"), ("div",), ("div", "div"), ("p",), ("div", "div", "p"))),
    "h2": ((("article", "h2"), ("main", "h2"), ("div", ".content", "h3")), (("div", "h2"), ("h2",), ("div", "h3"))),
    "item": ((("article", "ul", "li"), ("main", "ol", "li"), ("article", "table", "tr", "td"), ("article", "blockquote", "p")), (("div", "ul", "li"), ("ol", "li"), ("div", "table", "tr", "td"))),
}


def _leaf(path: tuple[str, ...]) -> str:
    return [x for x in path if x[0] != "."][-1]


def _layout(r: np.random.Generator, words: list[str]) -> tuple[list[Block], np.ndarray]:
    """A made-up page, half of the time without names: an article of headings, paragraphs and items, with the usual parts before and after it."""
    bare, page, labels = bool(r.random() < 0.5), [], []
    around = [("div",), ("div", ".wrapper"), ("div", ".page", ".container")][r.integers(3)] * int(r.integers(4)) if r.random() < 0.5 else ()
    forms = {part: around + own[bare][r.integers(len(own[bare]))] for part, own in _PARTS.items()}

    def say(least: int, most: int, sentences: bool) -> str:
        own = [words[k] for k in r.integers(len(words), size=r.integers(least, most + 1))]
        if sentences:
            for k in range(len(own) - 1, 0, -int(r.integers(6, 18))):
                own[k] += "."
            own[-1] = own[-1].rstrip(".") + "."
        return " ".join(own)

    def put(part: str, text: str, linked: float = 0.0) -> None:
        path = forms[part]
        place = _place(path, bare)
        page.append(Block(place, text, linked, _leaf(path)))
        labels.append(part in ("h1", "p", "h2", "item"))

    def maybe(chance: float) -> bool:
        return bool(r.random() < chance)

    if maybe(0.2):  # a short page: a menu, a few paragraphs, the page's end
        put("menu", (" | " if maybe(0.6) else " ").join(say(1, 2, False) for _ in range(r.integers(2, 9))), float(r.uniform(0.6, 1)))
        for _ in range(r.integers(1, 6)):
            put("p", say(8, 60, True))
        if maybe(0.5):
            put("end", ("\u00a9 " if maybe(0.6) else "") + say(2, 10, False))
        return page, np.array(labels, int)
    if maybe(0.5):
        page.append(Block(_root().child("head", ()).child("title", ()), say(2, 12, False), 0.0, "title"))
        labels.append(False)
    if maybe(0.5):
        put("site", say(1, 4, False), float(maybe(0.5)))
    if maybe(0.5):
        put("menu", (" | " if maybe(0.6) else " ").join(say(1, 2, False) for _ in range(r.integers(2, 9))), float(r.uniform(0.6, 1)) if maybe(0.8) else 0.0)
    elif maybe(0.85):
        for _ in range(r.integers(2, 10)):
            put("menus", say(1, 2, False), 1.0)
    if maybe(0.35):
        put("notice", say(5, 25, True), float(r.uniform(0, 0.3)))
    if maybe(0.5):
        put("ad", say(3, 14, maybe(0.6)), float(maybe(0.3)))
    if maybe(0.85):
        put("h1", say(2, 12, False))
    for _ in range(r.integers(1, r.integers(3, 41 if maybe(0.15) else 21))):
        kind = r.random()
        if kind < 0.08:
            put("h2", say(1, 8, False))
        elif kind < 0.18:
            put("item", say(2, 20, maybe(0.5)), float(r.uniform(0, 0.3)) if maybe(0.2) else 0.0)
        elif kind < 0.26:
            put("p", say(1, 6, True))
        else:
            put("p", say(8, 110, True), float(r.uniform(0, 0.3)) if maybe(0.2) else 0.0)
    if maybe(0.4):
        for _ in range(r.integers(2, 7)):
            put("related", say(2, 9, False), 1.0)
    if maybe(0.45):
        for _ in range(r.integers(1, 6)):
            put("comment", say(2, 20, maybe(0.8)), 0.0)
    if maybe(0.3):
        put("form", say(1, 8, False))
    if maybe(0.6):
        put("end", ("\u00a9 " if maybe(0.6) else "") + say(2, 14, maybe(0.4)), float(r.uniform(0, 0.8)) if maybe(0.4) else 0.0)
    return page, np.array(labels, int)


def teaching_pages(pages: list[str], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the sample's pages as they are, and once more with made-up parts around and in place of theirs."""
    r, out = np.random.default_rng(seed), []
    for page in pages:
        own = blocks(page)
        if not own:
            continue
        mixed: list[Block] = []
        for b in own:
            while r.random() < 0.3:
                extra = _EXTRAS[r.integers(len(_EXTRAS))]
                mixed.append(Block(_place(extra), own[r.integers(len(own))].text, float(r.random() < 0.4), _leaf(extra)))
            if teaching_label(b) and r.random() < 0.6:
                body = _BODIES[r.integers(len(_BODIES))]
                b = Block(_place(body), b.text, b.linked * 0.5, _leaf(body))
            mixed.append(b)
        out += [(features(x), np.array([teaching_label(b) for b in x])) for x in (own, mixed)]
    return out


def nameless_pages(pages: list[str], made: int = 3, seed: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the sample's pages without their names, and `made` made-up pages of its words for each, half of them without names.

    The labels are those of the pages with names, so that links, lengths, sentences, headings and order teach what else tells an article.
    """
    r, out = np.random.default_rng(seed), []
    for page in pages:
        own = blocks(page)
        if not own:
            continue
        labels = np.array([teaching_label(b) for b in own])
        if labels.any() and not labels.all():
            out.append((features(blocks(page, bare=True)), labels))
        words = [w for b in own for w in b.text.split(" ")]
        for _ in range(made):
            whole, kinds = _layout(r, words)
            out.append((features(whole), kinds))
    return out


def form_pages(n: int = 900, seed: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of made-up pages alone, for tables without a page to teach from."""
    r = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in r.integers(26, size=r.integers(2, 10))) for _ in range(2_000)]
    return [(features(page), labels) for page, labels in (_layout(r, words) for _ in range(n))]


def main_text(pages: DataFrame, fit_pages: int = 200, fit_chars: int = 60_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    The labeller is trained on at most `fit_pages` pages of `fit_chars` characters at most, all different, least hash of the html first. Their labels come from the names of tags and classes; pages
    without these names, and made-up pages of their words, teach what else tells an article. Where no page is short enough or has text, made-up pages alone take their place. Every block of every
    page, whole, is then labelled in the context of its page, and those with a chance over one half are joined by newlines. Null or empty html, and pages without text, give an empty text. Null ids
    and repeated rows keep their rows. What is no text, and how broken markup is read, is stated at `blocks`. Blocks of the same text on many pages of a host are not told apart from others.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    able = base.where((F.length("html") <= fit_chars) & (F.length("html") > 0)).withColumn("h", F.xxhash64("html"))
    chosen = [r["h"] for r in able.select("h").distinct().orderBy("h").limit(fit_pages).collect()]
    sample = [r["html"] for r in able.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).orderBy("h").select("html").collect()]
    taught = teaching_pages(sample) + nameless_pages(sample) or form_pages()
    sent = pages.sparkSession.sparkContext.broadcast(Labeller().fit(taught))  # the network's weights: a fixed size

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                leaves = [blocks(x) for x in rows.column("html").to_pylist()]
                texts = [""] * len(leaves)
                order = sorted((k for k in range(len(leaves)) if leaves[k]), key=lambda k: len(leaves[k]))
                while order:
                    own, cells = [], 0
                    while order and len(own) < 64 and (not own or cells + len(leaves[order[0]]) < 8192):
                        own.append(order.pop(0))
                        cells += len(leaves[own[-1]])
                    x, mask = padded([features(leaves[k]) for k in own])
                    chances = model.chances(x, mask)
                    for k, chance in zip(own, chances, strict=True):
                        texts[k] = "\n".join(b.text for b, c in zip(leaves[k], chance, strict=False) if c > 0.5)
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(base, extract, "page_id long, url string, text string, n_chars long")
