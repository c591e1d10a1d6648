"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags, each with the path
of tags (and their class, id and role words) that it lies under. A bidirectional LSTM
reads a vector for each block, made of its path, its hashed words, its length and its
share of link text, over the whole page in order, and says for each block whether it
belongs to the article, so a block is judged by its neighbours and its place as well.

The LSTM is trained in numpy by backpropagation through time. Its teacher is the markup of
pages whose structure is explicit (article or main on the one side; nav, footer and
the like on the other). Pages for training are rearranged copies of a bounded sample of
these: the article in other containers or none, and other boilerplate (headers,
sidebars, notices, forms, comments, adverts) around and inside it, under many names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm import wordhash
from mnemo.llm.common import fresh

# ---------------------------------------------------------------- fixed values: names in HTML
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = set("script style noscript template svg math iframe object canvas audio video head title select option optgroup "
              "datalist textarea button".split())
RAW = set("script style noscript template textarea title iframe".split())
CLOSED_BY = {"p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                      "pre section table ul".split()),
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: What may stand in a head; any other tag, and text, ends it.
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Unshown elements without an end tag of their own end at these tags.
BREAKOUT = CLOSED_BY["p"] | set("body center dd dt figcaption figure li listing".split())

# what containers are called: of articles, and of what is not the article
ARTICLE_TAGS = ("article", "main")
HAS_ARTICLE = r"(?i)<(" + "|".join(ARTICLE_TAGS) + r")[\s/>]"
ARTICLE_NAMES = "article content main post entry story body text page prose markdown single".split()
OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
OTHER_NAMES = ("ad ads advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
               "breadcrumbs sidebar side widget header masthead topbar footer bottom copyright cookie cookies consent gdpr notice "
               "notification alert message popup modal overlay newsletter subscribe signup login register search form comment "
               "comments respond reply replies discussion disqus reader feedback share sharing social related recommended "
               "more trending popular tags pagination pager toolbar skip legal disclaimer").split()

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>
    |<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Of a deeper path the outermost and innermost elements count.
DEPTH = 40
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float = 0.0  # share of the characters inside links


@dataclass
class _Open:
    """An open element and the words of its class, id and role."""
    tag: str
    names: tuple[str, ...] = ()
    loose: bool = False  # unshown and without an end tag of its own


_UNSHOWN_TAG = re.compile(f"<!--.*?(?:-->|\\Z)|<(/?)({'|'.join(sorted(UNSHOWN - RAW - {'head'}))})(?![^\\s/<>])", re.S | re.I)


def _loose(html: str) -> set[int]:
    """Where unshown elements begin that no end tag closes."""
    begun: dict[str, list[int]] = {}
    for m in _UNSHOWN_TAG.finditer(html):
        if m[2] is None:
            continue
        open_ = begun.setdefault(m[2].lower(), [])
        if not m[1]:
            open_.append(m.start())
        elif open_:
            open_.pop()
    return {i for x in begun.values() for i in x}


def cut_blocks(html: str) -> list[Block]:
    """The shown blocks of a page in order, white space made single, references decoded.

    A head without an end tag ends at the first tag or text that can't stand in it; a
    button, select, object, video or other unshown element without one ends at the next
    block tag, or with the element around it."""
    blocks: list[Block] = []
    stack: list[_Open] = []  # open elements but for inline ones
    opened: Counter[str] = Counter()
    words: list[str] = []
    linked = hidden = at = 0
    link = False
    loose = _loose(html)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(words))).strip()
        if text:
            shown = stack if len(stack) <= 2 * DEPTH else stack[:DEPTH] + stack[-DEPTH:]
            path = tuple(x for o in shown for x in (o.tag, *o.names))
            blocks.append(Block(text, path, min(1.0, linked / max(1, len(text)))))
        words.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal hidden
        for o in stack[i:]:
            hidden -= o.tag in UNSHOWN
            opened[o.tag] -= 1
        del stack[i:]

    def add(text: str) -> None:
        nonlocal linked
        if hidden and stack[-1].tag == "head" and text and not text.isspace():
            close(len(stack) - 1)
        if not hidden and text:
            words.append(text)
            if link:
                linked += len(text.strip())

    while m := _TOKEN.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if hidden and not m[1]:
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            while stack and stack[-1].loose and tag in BREAKOUT:
                close(len(stack) - 1)
        if tag in INLINE:
            if tag == "a":
                link = not m[1]
            elif tag == "br":
                add(" ")
            continue
        flush()
        if m[1]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                close(i)
                break
            if stack[i].tag not in CLOSED_BY:
                break
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        names = tuple("." + p.lower() for a in _ATTRIBUTE.finditer(m[3])
                      for p in _PARTS.findall(a[2] or a[3] or a[4] or "")) if m[3] else ()
        stack.append(_Open(tag, names, m.start() in loose))
        hidden += tag in UNSHOWN
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            at = end.start() if end else len(html)
    add(html[at:])
    flush()
    return blocks


# ---------------------------------------------------------------- teaching pages

#: Tags and names that tell of blocks beside the article.
TELLING = frozenset(OTHER_TAGS) | {"." + n for n in OTHER_NAMES}
#: Elements whose own names describe the page or the article, not a part beside it.
WHOLE = ("html", "body", *ARTICLE_TAGS)
#: Share of a page's text from which a container is the page's, not a part's.
WIDE = 0.9


def marked(blocks: list[Block]) -> list[Block]:
    """The blocks of a page with paths that have only what tells its parts apart: without the
    telling names of html, body and article elements (that a body has a sidebar says nothing
    of a block), and without those of a container that holds nearly all of the page's text,
    such as a form or a list of results around everything."""
    def owned(path: tuple[str, ...]) -> tuple[str, ...]:
        tag, out = "", []
        for x in path:
            if x[0] != ".":
                tag = x
            if not (x[0] == "." and tag in WHOLE and x in TELLING):
                out.append(x)
        return tuple(out)

    total, held = 0, Counter()
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    for b in blocks:
        if b.path not in paths:
            paths[b.path] = owned(b.path)
        total += len(b.text)
        for x in TELLING.intersection(paths[b.path]):
            held[x] += len(b.text)
    wide = {x for x, n in held.items() if n >= WIDE * total}
    for raw, path in paths.items():
        if wide.intersection(path):
            once: set[str] = set()
            # the outermost only: a part inside may bear the same name
            paths[raw] = tuple(x for x in path if x not in wide or x in once or once.add(x))
    return [b if paths[b.path] == b.path else Block(b.text, paths[b.path], b.linked) for b in blocks]


def taught(block: Block) -> bool | None:
    """What the markup says of a marked block; None if it says nothing."""
    tags = set(block.path)
    return False if tags & TELLING else True if tags & set(ARTICLE_TAGS) else None


def rearranged(article: list[Block], other: list[Block], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page made of an article's blocks and pieces of boilerplate."""
    def pick(x):
        return x[int(rng.integers(len(x)))]

    kind = rng.random()
    box: tuple[str, ...] = (pick(ARTICLE_TAGS),) if kind < 0.45 else () if kind < 0.6 else \
        ("div", "." + pick(ARTICLE_NAMES)) if kind < 0.85 else ("section", "." + pick(ARTICLE_NAMES))
    if kind < 0.45 and rng.random() < 0.4:
        box += ("." + pick(ARTICLE_NAMES),)
    if 0.6 < kind and rng.random() < 0.15:
        box = ("div", "." + pick(OTHER_NAMES)) + box
    if rng.random() < 0.15:  # a layout made of a table
        box = ("table", *pick(((), ("tbody",))), "tr", "td") + box
    if rng.random() < 0.05:  # a text without markup
        return [(Block(pick(article).text, pick(((), ("html", "body")))), True)]
    outer = ("html", "body") + (("div",) + (("." + pick(ARTICLE_NAMES),) if rng.random() < 0.3 else ()) if rng.random() < 0.4 else ())
    sentences = [b.text for b in other] + [s for b in article for s in re.split(r"(?<=[.!?]) ", b.text)][:200]

    def piece(inside: bool) -> list[tuple[Block, bool]]:
        wrap = (pick(OTHER_TAGS),) if rng.random() < 0.35 else (pick(("div", "section", "ul", "p", "div")), "." + pick(OTHER_NAMES))
        if rng.random() < 0.3:
            wrap = (*wrap, "." + pick(OTHER_NAMES))
        menu = rng.random() < 0.4
        inner = pick((("ul", "li"), ("li",), ("div",))) if menu else pick(((), ("p",), ("div", "p"), ("h3",), ("p",), ("h1",), ("h2",)))
        out = []
        for _ in range(int(rng.integers(1, 9 if menu else 5))):
            text = pick(sentences)
            if not menu and rng.random() < 0.3:
                text = " ".join(pick(sentences) for _ in range(int(rng.integers(2, 6))))
            if menu:
                text = " ".join(text.split()[:int(rng.integers(1, 4))])
            out.append((Block(text, outer + (box if inside else ()) + wrap + inner, 1.0 if menu and rng.random() < 0.8 else 0.0), False))
        return out

    page = [x for _ in range(int(rng.integers(0, 4))) for x in piece(False)]
    for i, b in enumerate(article):
        leaf = b.path[-1:] if rng.random() < 0.8 and b.path[-1:][0] in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td") else \
            pick((("p",), ("div",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("p",), ("section", "p"), ("table", "tr", "td"),
                  ("table", "tbody", "tr", "td"), ("table", "tr", "th"), ("dl", "dd"), ("figure", "figcaption"), ("h3",), ("ol", "li"), ()))
        page.append((Block(b.text, outer + box + leaf, b.linked), True))
        if rng.random() < 0.06:
            page += piece(True)
    if rng.random() < 0.3:
        page += piece(True)
    page += [x for _ in range(int(rng.integers(0, 4))) for x in piece(False)]
    return page


# ---------------------------------------------------------------- the network

@dataclass(frozen=True)
class Settings:
    """``pages`` bounds the training sample, ``page_chars`` the pages in it (longer ones
    aren't learnt from). A training step sees ``window`` blocks of a page, from any place."""
    pages: int = 400
    page_chars: int = 1_000_000
    window: int = 60
    path_buckets: int = 4096
    word_buckets: int = 1024
    path_size: int = 20
    word_size: int = 6
    hidden: int = 20
    steps: int = 800
    batch: int = 32
    rate: float = 0.01
    seed: int = 3


FACTS = 4


@dataclass
class Network:
    path: np.ndarray
    word: np.ndarray
    cell: list[np.ndarray] = field(default_factory=list)  # per direction (4H, in + H + 1)
    out: np.ndarray | None = None  # (2H + 1,)

    def weights(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.cell, self.out]


def new_network(s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    n, h = s.path_size + s.word_size + FACTS, s.hidden
    cells = []
    for _ in "fb":
        c = rng.normal(0, (n + h) ** -0.5, (4 * h, n + h + 1)).astype(np.float32)
        c[:, -1] = 0
        c[h:2 * h, -1] = 1  # remember at first
        cells.append(c)
    return Network(rng.normal(0, 0.3, (s.path_buckets, s.path_size)).astype(np.float32),
                   rng.normal(0, 0.1, (s.word_buckets, s.word_size)).astype(np.float32),
                   cells, np.append(rng.normal(0, 0.2, 2 * h), 0).astype(np.float32))


def path_features(path: tuple[str, ...], s: Settings) -> list[int]:
    """Buckets of a path: each tag and name once, the last tag, and its end as a whole."""
    tags = [x for x in path if x[0] != "."]
    parts = {*path, "last:" + (tags[-1] if tags else ""), "end:" + "/".join(tags[-2:])}
    return sorted(zlib.crc32(p.encode()) % s.path_buckets for p in parts)


def features(blocks: list[Block], s: Settings) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """(path buckets of each block, word buckets of all blocks, first word of each, facts)."""
    texts = pa.array([b.text.encode("utf-8") for b in blocks], pa.large_binary())
    buckets, first = [], [np.zeros(1, np.int64)]
    for _, _, hashes, at in wordhash.word_hashes(texts):
        buckets.append((hashes % np.uint64(s.word_buckets)).astype(np.int64))
        first.append(at[1:] + first[-1][-1])
    words, first = np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(first)
    n = np.diff(first)
    facts = np.array([[np.log1p(len(b.text)) / 6, b.linked, sum(b.text.count(c) for c in ".,;:!?") / (1 + k), 0.0]
                      for b, k in zip(blocks, n)], np.float32).reshape(-1, FACTS)
    facts[:, 3] = np.minimum(n, 60) / 30
    cache: dict[tuple[str, ...], list[int]] = {}
    paths = []
    for b in blocks:
        if b.path not in cache:
            cache[b.path] = path_features(b.path, s)
        paths.append(cache[b.path])
    return paths, words, first, facts


def _mean_rows(table: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(table[flat], first[:-1][full]) / np.diff(first)[full][:, None]
    return out


def vectors(net: Network, paths, words, first, facts) -> np.ndarray:
    """(blocks, size): sum of path vectors, mean of word vectors, facts."""
    lengths = np.array([len(p) for p in paths], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.array([i for p in paths for i in p], np.int64)
    return np.hstack([_mean_rows(net.path, flat, at) * (lengths ** 0.5)[:, None], _mean_rows(net.word, words, first), facts])


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def run_lstm(net: Network, x: np.ndarray, valid: np.ndarray, keep: bool = False):
    """States (steps, rows, 2H) of both directions over x (steps, rows, size)."""
    steps, rows, size = x.shape
    h = (len(net.out) - 1) // 2
    states = np.zeros((steps, rows, 2 * h), np.float32)
    traces = []
    for d in (0, 1):
        w = net.cell[d]
        now, memory = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        trace = []
        inputs = x @ w[:, :size].T + w[:, -1]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = inputs[t] + now @ w[:, size:size + h].T
            i, f, o = _sigmoid(a[:, :h]), _sigmoid(a[:, h:2 * h]), _sigmoid(a[:, 2 * h:3 * h])
            g = np.tanh(a[:, 3 * h:])
            on = valid[t][:, None]
            new = f * memory + i * g
            tanh = np.tanh(new)
            if keep:
                trace.append((t, now, memory, i, f, o, g, tanh, on))
            memory, now = np.where(on, new, memory), np.where(on, o * tanh, now)
            states[t, :, d * h:(d + 1) * h] = now
        traces.append(trace)
    return states, traces


def gradients(net: Network, x: np.ndarray, valid: np.ndarray, label: np.ndarray):
    """Mean loss over the valid blocks and the gradients of x, the cells and the output."""
    steps, rows, size = x.shape
    h = (len(net.out) - 1) // 2
    states, traces = run_lstm(net, x, valid, keep=True)
    p = _sigmoid(states @ net.out[:-1] + net.out[-1])
    total = valid.sum()
    loss = -float((np.log(np.where(label, p, 1 - p) + 1e-9) * valid).sum() / total)
    d_logit = (p - label) * valid / total
    g_out = np.append(np.einsum("tr,trh->h", d_logit, states), d_logit.sum())
    d_states = d_logit[:, :, None] * net.out[:-1]
    d_x, g_cells = np.zeros_like(x), []
    for d in (0, 1):
        w = net.cell[d]
        g_w = np.zeros_like(w)
        d_now, d_memory = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        for t, before, memory, i, f, o, g, tanh, on in reversed(traces[d]):
            d_h = d_states[t, :, d * h:(d + 1) * h] + d_now
            d_c = d_memory + d_h * o * (1 - tanh * tanh) * on
            d_a = np.hstack([d_c * g * i * (1 - i), d_c * memory * f * (1 - f), d_h * tanh * o * (1 - o), d_c * i * (1 - g * g)]) * on
            g_w += d_a.T @ np.hstack([x[t], before, np.ones((rows, 1), np.float32)])
            d_x[t] += d_a @ w[:, :size]
            d_now = np.where(on, d_a @ w[:, size:size + h], d_h)
            d_memory = np.where(on, d_c * f, d_memory)
        g_cells.append(g_w)
    return loss, d_x, g_cells, g_out


def train(pages: list[list[Block]], s: Settings = Settings()) -> Network:
    """Fit a network to rearranged copies of the pages whose markup tells the article
    from the rest, and to these pages as they are. Without any such page the article's
    blocks are every block of a page."""
    net = new_network(s)
    rng = np.random.default_rng(s.seed + 1)
    plain = [[(b, taught(b)) for b in marked(p)] for p in pages]
    usable = [p for p in plain if any(t for _, t in p)]
    if not usable:
        net.out[:] = 0
        net.out[-1] = 1
        return net
    articles = [[b for b, t in p if t] for p in usable]
    others = [[b for b, t in p if t is False] or [Block(p[0][0].text[:40], ())] for p in usable]
    m1 = [np.zeros_like(w) for w in net.weights()]
    m2 = [np.zeros_like(w) for w in net.weights()]
    met = np.zeros(s.path_buckets, bool)
    for step in range(1, s.steps + 1):
        batch = []
        for _ in range(s.batch):
            i = int(rng.integers(len(usable)))
            if rng.random() < 0.3:
                page = [(b, bool(t)) for b, t in usable[i] if t is not None]
            else:
                own = articles[i]
                lo = int(rng.integers(0, max(1, len(own) - 8)))
                made = rearranged(own[lo:lo + int(rng.integers(1, 12))], others[int(rng.integers(len(others)))], rng)
                page = list(zip(marked([b for b, _ in made]), [t for _, t in made]))
            lo = int(rng.integers(len(page) - s.window + 1)) if len(page) > s.window else 0
            batch.append(page[lo:lo + s.window])
        flat = [b for page in batch for b, _ in page]
        paths, words, first, facts = features(flat, s)
        # names that the sample lacks must be bearable: some parts of paths go unseen
        paths = [[i for i in p if rng.random() > 0.1] for p in paths]
        met[[i for p in paths for i in p]] = True
        dense = vectors(net, paths, words, first, facts)
        blind = rng.random(len(flat)) < 0.5
        dense[blind, s.path_size:s.path_size + s.word_size] = 0
        sizes = [len(p) for p in batch]
        steps = max(sizes)
        x = np.zeros((steps, s.batch, dense.shape[1]), np.float32)
        valid, label = np.zeros((steps, s.batch), bool), np.zeros((steps, s.batch), bool)
        at = 0
        for r, page in enumerate(batch):
            x[:len(page), r] = dense[at:at + len(page)]
            valid[:len(page), r] = True
            label[:len(page), r] = [t for _, t in page]
            at += len(page)
        _, d_x, g_cells, g_out = gradients(net, x, valid, label)
        d_flat = np.concatenate([d_x[:n, r] for r, n in enumerate(sizes)])
        g_path, g_word = np.zeros_like(net.path), np.zeros_like(net.word)
        lengths = np.array([len(p) for p in paths])
        scale = 1 / np.sqrt(np.maximum(lengths, 1))
        np.add.at(g_path, [i for p in paths for i in p], np.repeat(d_flat[:, :s.path_size] * scale[:, None], lengths, axis=0))
        n = np.diff(first)
        d_word = d_flat[:, s.path_size:s.path_size + s.word_size] / np.maximum(n, 1)[:, None]
        d_word[blind] = 0
        np.add.at(g_word, words, np.repeat(d_word, n, axis=0))
        grads = [g_path, g_word, *g_cells, g_out.astype(np.float32)]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = s.rate * min(1.0, 2.0 - 2.0 * step / (s.steps + 1) + 0.02)
        for w, g, a, b in zip(net.weights(), grads, m1, m2):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    net.path[~met] = 0  # a tag or name that no page had says nothing
    return net


def article_chances(net: Network, pages: list[list[Block]], s: Settings) -> list[np.ndarray]:
    """The chance of every block of every page to be of the article."""
    pages = [marked(p) for p in pages]
    out = [np.zeros(0, np.float32)] * len(pages)
    order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if pages[i]]
    lo = 0
    while lo < len(order):
        longest, hi = 0, lo
        while hi < len(order) and (hi - lo + 1) * (longest := max(longest, len(pages[order[hi]]))) <= 40_000:
            hi += 1
        group = order[lo:max(hi, lo + 1)]
        dense = vectors(net, *features([b for i in group for b in pages[i]], s))
        steps = max(len(pages[i]) for i in group)
        x, valid = np.zeros((steps, len(group), dense.shape[1]), np.float32), np.zeros((steps, len(group)), bool)
        at = 0
        for r, i in enumerate(group):
            n = len(pages[i])
            x[:n, r], valid[:n, r] = dense[at:at + n], True
            at += n
        states, _ = run_lstm(net, x, valid)
        p = _sigmoid(states @ net.out[:-1] + net.out[-1])
        for r, i in enumerate(group):
            out[i] = p[:len(pages[i]), r]
        lo += len(group)
    return out


# ---------------------------------------------------------------- over tables

def learn(pages: DataFrame, s: Settings = Settings(), html: str = "html") -> Network:
    """A network from at most ``s.pages`` pages: of the distinct ones with an article or main
    element those of the least hashes."""
    usable = (pages.select(F.col(html).alias("html")).where(F.col("html").rlike(HAS_ARTICLE) & (F.length("html") < s.page_chars))
              .withColumn("h", F.xxhash64("html")))
    least = [r.h for r in usable.select("h").distinct().orderBy("h").limit(s.pages).collect()]
    got = usable.where(F.col("h").isin(least)).dropDuplicates(["h"]).collect() if least else []
    return train([cut_blocks(x) for x in sorted(r.html for r in got)], s)


def extract(pages: DataFrame, net: Network, s: Settings = Settings(), html: str = "html", blocks: bool = False) -> DataFrame:
    """Add ``text``, the article's blocks joined by two line feeds (empty if there is none);
    with ``blocks`` also all blocks with their paths and chances. Other columns are kept.

    A null html counts as empty. The whole html of any length is read; a page without
    tags is one block.
    """
    out = ["text", *["blocks"] * blocks]
    key = fresh(pages, "_html")
    keep = [c for c in pages.columns if c.lower() not in out]
    src = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias(key))
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.StringType()),
                                     T.StructField("chance", T.DoubleType())]))
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()),
                           *[T.StructField("blocks", kind)] * blocks])
    arrow = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(key))
            step = max(1, min(len(column), 1 + int(4e6 * len(column) / max(1, column.nbytes))))
            for lo in range(0, len(column), step):
                cut = [cut_blocks(x.as_py()) for x in column.slice(lo, step)]
                with np.errstate(over="ignore"):
                    chances = article_chances(net, cut, s)
                texts = ["\n\n".join(b.text for b, c in zip(p, q) if c > 0.5) for p, q in zip(cut, chances)]
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, step) for c in keep]
                cols.append(pa.array(texts, pa.string()))
                if blocks:
                    cols.append(pa.array([[{"text": b.text, "path": "/".join(b.path), "chance": float(c)} for b, c in zip(p, q)]
                                          for p, q in zip(cut, chances)], arrow))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *out])

    return src.mapInArrow(run, schema)
