"""Main text of web pages by a recurrent labeller of blocks.

A page becomes the sequence of its text blocks. A bidirectional LSTM reads for each block
vectors of its tag path, of its hashed words and of its shape, and says whether it
belongs to the article, in view of all other blocks of the page.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import as_bytes, small_batches

PATHS, WORDS, SHAPES = 2048, 4096, 8
PATH_DIM, WORD_DIM, HIDDEN = 12, 6, 16
# pages of the table the labeller is fitted on, taken by the hash of their id; besides made ones
MAX_TRAIN, MADE_PAGES = 300, 1500
EPOCHS, BATCH, RATE = 8, 32, 0.01
# blocks held at once, and blocks of the padded pages of one batch
BLOCKS_AT_ONCE, PADDED_BLOCKS = 20_000, 40_000

# HTML elements by their role.
SKIPPED = frozenset("script style noscript template title svg iframe object annotation annotation-xml".split())
# of these, the ones whose content runs to the end of the page where no end tag follows
RAW = frozenset("script style iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
ARTICLE = frozenset("article main".split())
ASIDE = frozenset("nav aside footer form button select menu dialog header".split())
COMMENTS = frozenset(".comment .comments .commentlist .respond .replies .discussion".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
# what a picture ends at: its own end, or the first block, which no picture holds
_PICTURE = re.compile(rf"<(/?)(svg|{'|'.join(sorted(BLOCK))})(?![\w-])[^>]*>", re.I)


@dataclass
class Block:
    text: str
    path: list[str] = field(default_factory=list)  # names from the root down
    links: int = 0  # characters inside links


def _after_skipped(tag: str, page: str, at: int) -> int:
    """The place behind a skipped element whose start tag ends at ``at``.

    An element that never ends is passed over by its start tag alone, so no text is
    lost behind it; scripts, styles and frames run to the end of the page."""
    if tag == "svg":
        depth = 1
        for m in _PICTURE.finditer(page, at):
            if m[2].lower() != "svg":
                return m.start()
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
        return len(page)
    close = re.compile(rf"</{tag}(?![\w-])[^>]*>", re.I).search(page, at)
    return close.end() if close else len(page) if tag in RAW else at


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup and scripts are gone, references decoded,
    white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    links, depth, at, end = 0, 0, 0, len(page)

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if depth:
                links += len(text.strip())

    def flush() -> None:
        nonlocal links, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, [x for _, names in stack for x in names], links))
        parts, links = [], 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                depth = 0
            if tag in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
        elif tag in SKIPPED:
            if not m[3].endswith("/"):
                at = _after_skipped(tag, page, at)
        elif tag in BLOCK:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                stack.pop()
            if tag not in VOID:
                found = _NAMES.findall(m[3]) if "=" in m[3] else ()
                stack.append((tag, [tag, *(f".{w}" for x in found for w in _PARTS.findall(x.lower()))]))
        elif tag == "a":
            depth = 1
        elif tag == "br":
            parts.append(" ")
    add(page[at:])
    flush()
    return out


def _bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode()) % n


class _Buckets(dict):
    def __init__(self, n: int):
        self.n = n

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = b = _bucket(name, self.n)
        return b


def _steps(path: list[str]) -> list[str]:
    """The distinct names of a whole tag path, and its distinct steps from one element to the next."""
    tags = [x for x in path if x[0] != "."]
    return [*dict.fromkeys(path), *dict.fromkeys(f"{a}>{b}" for a, b in zip(tags, tags[1:])), "@" + tags[-1]] if tags else []


class Features:
    """Blocks to bucket lists and shapes; keeps the buckets of the names it has seen."""

    def __init__(self) -> None:
        self.paths, self.words = _Buckets(PATHS), _Buckets(WORDS)

    def of(self, blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        n = len(blocks)
        paths = [[*map(self.paths.__getitem__, _steps(b.path))] or [0] for b in blocks]
        words = [[*map(self.words.__getitem__, b.text.lower().split())] or [0] for b in blocks]
        size = np.array([len(b.text) for b in blocks], float)
        marks = np.array([b.text.count(".") + b.text.count(",") for b in blocks], float)
        shapes = np.stack([
            np.log1p(size) / 8, np.array([b.links for b in blocks]) / size, np.minimum(1, 10 * marks / size),
            np.arange(n) / max(1, n), np.full(n, np.log1p(n) / 8), size / size.max(), size > 80, np.ones(n),
        ], axis=1) if n else np.zeros((0, SHAPES))
        return paths, words, shapes


def _mean(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    flat = np.fromiter((i for x in lists for i in x), np.int64)
    sizes = np.array([len(x) for x in lists])
    return np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _reversed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each column's first ``sizes`` entries from the back to the front."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < sizes, sizes - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


def _forward(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = False):
    """An LSTM over ``x`` (time, pages, dim); the states, and what the gradient needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    states, kept = np.empty((steps, pages, HIDDEN)), []
    ahead = x @ w[:x.shape[2]] + b
    for t in range(steps):
        z = ahead[t] + h @ w[x.shape[2]:]
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(z[:, 3 * HIDDEN:])
        before, c = c, f * c + i * u
        s = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, u, s))
        h = o * s
        states[t] = h
    return states, kept


def _backward(x: np.ndarray, w: np.ndarray, kept: list, dstates: np.ndarray):
    """Gradients of ``_forward`` by its input, weights and offsets."""
    d = x.shape[2]
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(x)
    dh, dc = np.zeros(dstates.shape[1:]), np.zeros(dstates.shape[1:])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, u, s = kept[t]
        dh = dh + dstates[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)), axis=1)
        dw[:d] += x[t].T @ dz
        dw[d:] += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w[:d].T
        dh, dc = dz @ w[d:].T, dc * f
    return dx, dw, db


class Labeller:
    """The network: embeddings, one LSTM each way, a logistic on both states."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            r = np.random.default_rng(7)
            d = PATH_DIM + WORD_DIM + SHAPES
            draw = lambda *shape, scale=0.1: r.normal(0, scale, shape)
            weights = {"paths": draw(PATHS, PATH_DIM), "words": draw(WORDS, WORD_DIM), "out": draw(2 * HIDDEN), "out_b": np.zeros(1)}
            for way in ("ahead", "back"):
                offsets = np.zeros(4 * HIDDEN)
                offsets[HIDDEN:2 * HIDDEN] = 1.0  # remember at first
                weights |= {way: draw(d + HIDDEN, 4 * HIDDEN, scale=0.2), f"{way}_b": offsets}
        self.w = weights

    def _inputs(self, pages: list):
        sizes = np.array([len(p[2]) for p in pages])
        rows = np.concatenate([
            _mean(self.w["paths"], [x for p in pages for x in p[0]]), _mean(self.w["words"], [x for p in pages for x in p[1]]),
            np.concatenate([p[2] for p in pages])], axis=1)
        t = np.concatenate([np.arange(n) for n in sizes])
        page = np.repeat(np.arange(len(pages)), sizes)
        x = np.zeros((sizes.max(), len(pages), rows.shape[1]))
        x[t, page] = rows
        return x, t, page, sizes

    def scores(self, pages: list) -> list[np.ndarray]:
        """Probability of every block to be article text; pages have at least one block."""
        x, t, page, sizes = self._inputs(pages)
        a, _ = _forward(x, self.w["ahead"], self.w["ahead_b"])
        b, _ = _forward(_reversed(x, sizes), self.w["back"], self.w["back_b"])
        states = np.concatenate((a, _reversed(b, sizes)), axis=2)[t, page]
        return np.split(_sigmoid(states @ self.w["out"] + self.w["out_b"]), np.cumsum(sizes)[:-1])

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, t, page, sizes = self._inputs(pages)
        y = np.concatenate(labels)
        back = _reversed(x, sizes)
        a, kept_a = _forward(x, self.w["ahead"], self.w["ahead_b"], keep=True)
        b, kept_b = _forward(back, self.w["back"], self.w["back_b"], keep=True)
        states = np.concatenate((a, _reversed(b, sizes)), axis=2)[t, page]
        d = (_sigmoid(states @ self.w["out"] + self.w["out_b"]) - y) / len(y)
        g = {"out": states.T @ d, "out_b": np.array([d.sum()])}
        ds = np.zeros((*x.shape[:2], 2 * HIDDEN))
        ds[t, page] = d[:, None] * self.w["out"]
        dxa, g["ahead"], g["ahead_b"] = _backward(x, self.w["ahead"], kept_a, ds[..., :HIDDEN])
        dxb, g["back"], g["back_b"] = _backward(back, self.w["back"], kept_b, _reversed(ds[..., HIDDEN:], sizes))
        rows = (dxa + _reversed(dxb, sizes))[t, page]
        for name, k, at, dim in (("paths", 0, 0, PATH_DIM), ("words", 1, PATH_DIM, WORD_DIM)):
            g[name] = np.zeros_like(self.w[name])
            lists = [x for p in pages for x in p[k]]
            n = np.array([len(x) for x in lists])
            flat = np.fromiter((i for x in lists for i in x), np.int64)
            np.add.at(g[name], flat, np.repeat(rows[:, at:at + dim] / n[:, None], n, axis=0))
        return g

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = EPOCHS) -> Labeller:
        """Adam on the logistic loss of all blocks; pages of like length share a batch."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        order = sorted(range(len(pages)), key=lambda i: len(labels[i]))
        batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        r, step = np.random.default_rng(7), 0
        for _ in range(epochs):
            for k in r.permutation(len(batches)):
                step += 1
                g = self.gradients([pages[i] for i in batches[k]], [labels[i] for i in batches[k]])
                for name, d in g.items():
                    d = np.clip(d, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.w[name] = self.w[name] - RATE * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
        return self


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that names its article: blocks under it and not aside; else none."""
    inside = np.array([bool(ARTICLE.intersection(b.path)) for b in blocks], bool)
    if not inside.any() or inside.all():
        return None
    return (inside & np.array([not (ASIDE | COMMENTS).intersection(b.path) for b in blocks], bool)).astype(float)


def made_pages(n: int, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Made pages in many layouts, and the block texts that are their article."""
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnoprstuvwéüñ"))
    stock = {
        "menu": "Home News Sport About Contact Login Products Shop Blog Archive".split(),
        "notice": ["We use cookies to improve this site. Accept all cookies", "Please subscribe to our newsletter", "This site uses cookies", "Sign in to continue"],
        "ad": ["Advertisement", "Sponsored content", "Buy now and save", "Ad: best offers today"],
        "comment": ["Great post, thanks!", "I do not agree with this", "Reply", "Posted by a reader", "Nice article"],
        "foot": ["Copyright 2024 All rights reserved", "Privacy policy", "Terms of use", "© Company"],
    }

    def words(k: int) -> str:
        out = ["".join(r.choice(letters, r.integers(2, 9))) + ("," if r.random() < 0.08 else "") for _ in range(k)]
        return " ".join(out).capitalize() + "."

    def named(tag: str, names: list[str], inner: str) -> str:
        how = r.random()
        attr = "" if how < 0.15 and "comments" not in names else f' class="{r.choice(names)}"' if how < 0.7 else f' id="{r.choice(names)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def some(kind: str) -> str:
        return str(r.choice(stock[kind])) if r.random() < 0.4 else words(int(r.integers(1, 14)))

    def comment(text: str) -> str:
        how = r.random()
        if how < 0.3:
            name = str(r.choice(["comment-body", "comment-content", "comment", "reply"]))
            return f'<ol><li><article class="{name}"><p>{text}</p></article></li></ol>' if how < 0.2 else f'<ol><li class="{name}"><div><p>{text}</p></div></li></ol>'
        return f'<div class="comment"><p>{text}</p></div>' if how < 0.5 else f"<p>{text}</p>" if how < 0.8 else f"<ul><li>{text}</li></ul>"

    def menu(k: int) -> str:
        if r.random() < 0.3:
            # deep, with plain sentences among the links
            items = "".join(f'<li class="menu-item item-{i}">{words(int(r.integers(3, 25))) if r.random() < 0.4 else f"<a>{words(1)[:-1]}</a>"}</li>' for i in range(k))
            depth = int(r.integers(0, 4))
            return "<div>" * depth + f'<ul class="{r.choice(["menu", "nav-list", "links"])}">{items}</ul>' + "</div>" * depth
        return "<ul>" + "".join(f'<li><a href="/{i}">{str(r.choice(stock["menu"])) if r.random() < 0.5 else words(1)[:-1]}</a></li>' for i in range(k)) + "</ul>"

    for _ in range(n):
        article, body = set(), []
        for k in range(int(r.integers(1, 9))):
            kind = r.random()
            texts = [words(int(r.integers(2, 90))) for _ in range(1 if kind < 0.85 else 3)]
            if k == 0 and r.random() < 0.8:
                head = words(int(r.integers(3, 12)))
                article.add(head)
                body.append(f"<h1>{head}</h1>")
            article.update(texts)
            inner = texts[0] if r.random() < 0.6 else texts[0].replace(" ", " <b>", 1) + "</b>" if " " in texts[0] else texts[0]
            body.append(f"<p>{inner}</p>" if kind < 0.7 else f"<h2>{texts[0]}</h2>" if kind < 0.77 else f"<blockquote>{texts[0]}</blockquote>" if kind < 0.81
                        else f"<pre>{texts[0]}</pre>" if kind < 0.85 else "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>" if kind < 0.95
                        else "<table><tr>" + "".join(f"<td>{t}</td>" for t in texts) + "</tr></table>")
        tag = str(r.choice(["article", "main", "div", "div", "section"]))
        main = named(tag, ["content", "post", "entry-content", "article-body", "story", "main", "text", "page-content"], "".join(body))
        if r.random() < 0.3:
            # no names at all, in any depth
            depth = int(r.integers(1, 6))
            main = "<div>" * depth + "".join(body) + "</div>" * depth
        if r.random() < 0.3:
            main = f"<main>{main}</main>"
        bare = r.random() < 0.1
        around = [
            (0.8, 0, lambda: named(str(r.choice(["nav", "div"])), ["menu", "nav", "navbar", "main-menu", "breadcrumb"], menu(int(r.integers(2, 9))))),
            (0.5, 0, lambda: named(str(r.choice(["header", "div"])), ["header", "site-header", "top", "masthead", "banner"], f"<p>{some('menu')}</p>")),
            (0.6, 0, lambda: named("div", ["ad", "ads", "advert", "sponsor", "banner-ad", "promo"], some("ad"))),
            (0.4, 0, lambda: named(str(r.choice(["div", "section"])), ["cookie", "notice", "cookie-banner", "consent", "alert", "popup"], f"<p>{some('notice')}</p>")),
            (0.5, 1, lambda: named(str(r.choice(["aside", "div"])), ["sidebar", "side", "related", "widget", "share", "recommended"], f"<h3>{some('menu')}</h3>{menu(3)}<p>{words(8)}</p>")),
            (0.5, 1, lambda: named(str(r.choice(["div", "section"])), ["comments", "comments-area", "comment-list", "reader-comments", "discussion", "respond"],
                                   "".join(comment(some("comment") if r.random() < 0.4 else words(int(r.integers(5, 80)))) for _ in range(int(r.integers(1, 5)))))),
            (0.1, 0, lambda: "<table><tr>" + "".join(f'<td><a href="/{k}">{words(1)[:-1]}</a></td>' for k in range(int(r.integers(2, 6)))) + "</tr></table>"),
            (0.4, 1, lambda: f'<form action="/s"><label>{some("notice")}</label><input name="q"><button>{words(1)[:-1]}</button></form>'),
            (0.4, 1, lambda: named("div", ["ad", "ads", "advert", "sponsor", "promo"], f"<p>{some('ad')}</p>")),
            (0.8, 2, lambda: named(str(r.choice(["footer", "div"])), ["footer", "site-footer", "bottom", "copyright", "legal"], some("foot"))),
        ]
        parts = [[], [], []]
        for share, place, make in around:
            if not bare and r.random() < share:
                parts[place].append(make())
        for p in parts[:2]:
            r.shuffle(p)
        whole = "".join(parts[0]) + main + "".join(parts[1]) + "".join(parts[2])
        if r.random() < 0.4:
            whole = named("div", ["wrapper", "container", "page", "site"], whole)
        yield f"<html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{whole}</body></html>", article


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_train: int = MAX_TRAIN) -> Labeller:
    """Fits on made pages in many layouts and on at most ``max_train`` pages of the table
    whose markup names the article, taken by the hash of their id."""
    rows = pages.where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), id_col).select(html_col).limit(max_train)
    features, data, labels = Features(), [], []
    for r in rows.toLocalIterator():
        blocks = blocks_of(r[0])
        y = weak_labels(blocks)
        if y is not None:
            data.append(features.of(blocks))
            labels.append(y)
    for page, article in made_pages(MADE_PAGES):
        blocks = blocks_of(page)
        data.append(features.of(blocks))
        labels.append(np.array([float(b.text in article) for b in blocks]))
    return Labeller().fit(data, labels)


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``main_text``: the blocks of the article in order, one a line.

    Every block of the whole page is judged by its whole path. Pages are labelled in batches of at
    most ``PADDED_BLOCKS`` blocks with padding, so a very long page is a batch of its own. Null and empty pages, and pages
    without text, give an empty text; an empty table gives an empty table; repeated rows get equal
    texts. Other columns pass through; ``main_text`` replaces one of that name.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model.w)

    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, features = Labeller(sent.value), Features()
        for batch in batches:
            out = [""] * len(batch)
            held: list[tuple[int, list[Block]]] = []

            def flush() -> None:
                held.sort(key=lambda x: len(x[1]))
                while held:
                    n = 1
                    while n < min(len(held), 4 * BATCH) and (n + 1) * len(held[n][1]) <= PADDED_BLOCKS:
                        n += 1
                    some = held[:n]
                    del held[:n]
                    for (k, blocks), p in zip(some, net.scores([features.of(b) for _, b in some])):
                        out[k] = "\n".join(b.text for b, x in zip(blocks, p) if x > 0.5)

            size = 0
            for k, raw in enumerate(batch):
                if raw and (blocks := blocks_of(raw.decode("utf-8"))):
                    held.append((k, blocks))
                    size += len(blocks)
                    if size >= BLOCKS_AT_ONCE:
                        flush()
                        size = 0
            flush()
            yield pd.Series(out, dtype=object)

    return pages.withColumn("main_text", F.pandas_udf(extracted, "string")(as_bytes(F.col(html_col))))
