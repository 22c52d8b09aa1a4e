"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is parsed leniently into elements. Every element has features: its tag, the sense of its attribute
tokens and of its ancestors', depth, place among its siblings and their sizes, and the densities of its
subtree (text, links, blocks, punctuation). Boosted regression trees give each element the log odds of being
main content. The decoding picks one label for each element over the whole tree: *out* (nothing below is
kept), *in* (its own text is kept, children are in or out) or *frame* (a container of decisions below it), so that a
kept element never stands in a dropped one. Where no element is kept, the likeliest container that does not name itself
a menu, form or the like is.

The trees are fitted on a bounded sample of ``SAMPLE`` pages, chosen by a hash of their address. Pages that
mark their article teach what is content; each is also rebuilt ``VARIANTS`` times from its own passages with other
containers and with menus, sidebars, notices, forms, adverts and comments around them, so that the trees do
not depend on one template. Extraction is one pass over the pages, no shuffle.

Defined results: a null, empty or tag-less page: null and empty give an empty text, plain text is its own
main text; broken and unclosed markup is closed where its parent ends; a table without pages that mark an article is judged
by trees fitted on rebuilt pages of its plain text, or, without any, keeps all that is not hidden; repeated pages give repeated rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import per_row

SAMPLE = 150
VARIANTS = 3

# The elements of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video select option textarea button input".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("html body td th tr tbody thead tfoot li dd dt".split())
PARTS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote a b i u s em strong span small sup sub code q cite mark font abbr time br hr img label".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = set("html body table td th ul ol dl article section div aside nav footer header main form blockquote".split())
# What words in class, id and role attributes usually say.
CONTENT_WORDS = set("article articles body content contents copy entry main maincontent page post posts story text prose".split())
PAGE_WORDS = {
    "menu": "menu menus nav navbar navigation breadcrumb breadcrumbs toc tabs pager pagination topbar toolbar".split(),
    "edge": "footer foot header head masthead banner copyright bottom top logo branding".split(),
    "side": "sidebar side aside related recommended more widget widgets rail links tags archive popular trending".split(),
    "advert": "ad ads advert advertisement adverts promo promotion sponsor sponsored sponsors partner commercial".split(),
    "notice": "cookie cookies consent notice notices gdpr alert modal popup overlay warning privacy newsletter subscribe".split(),
    "form": "form search login signup signin register subscribe contact".split(),
    "comment": "comment comments commentlist discussion reply replies respond response responses disqus feedback".split(),
    "share": "share sharing social follow like likes rating byline meta author".split(),
}
SENSES = ["content", *PAGE_WORDS]
SENSE_OF = {w: 0 for w in CONTENT_WORDS} | {w: 1 + i for i, ws in enumerate(PAGE_WORDS.values()) for w in ws}
NAMING = ("class", "id", "role", "itemprop", "aria-label")
TAG_SENSE = {"nav": "menu", "aside": "side", "footer": "edge", "header": "edge", "form": "form"}
TAGS = ("article main section div p h1 h2 h3 li ul ol nav aside header footer form table td blockquote a body".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_STOPS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "senses", "parent", "pieces", "children", "depth", "kept", "truth", "index", "hidden", "letters")

    def __init__(self, tag, senses, parent, truth=None, hidden=False):
        self.tag, self.senses, self.parent = tag, senses, parent
        self.pieces, self.children = [], []  # pieces: texts and child nodes, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.truth = truth if truth is not None else (parent.truth if parent else None)
        self.kept, self.index, self.hidden = False, -1, hidden or bool(parent and parent.hidden)
        self.letters = 0  # of its own texts


class PageParser(HTMLParser):
    """A tree of ``Node``; the attribute ``data-truth`` is read into ``truth`` and is no feature."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", (), None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES)
        if tag in SELF_CLOSING:
            self._close(SELF_CLOSING[tag], {"ul", "ol", "dl", "table"})
        gone, truth, told = tag in HIDDEN, None, set()
        if attrs:
            given = dict(attrs)
            words = " ".join([given[a] or "" for a in NAMING if a in given])
            told = {SENSE_OF[t] for t in (w.lower() for w in _TOKEN.findall(words)) if t in SENSE_OF}
            gone = gone or "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
            truth = given.get("data-truth")
        if tag in TAG_SENSE:
            told.add(SENSES.index(TAG_SENSE[tag]))
        node = Node(tag, tuple(sorted(told)), self.open[-1], truth, gone)
        self.open[-1].children.append(node)
        self.open[-1].pieces.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.open.pop()

    def _close(self, tags, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].pieces.append(data)


def parse(html: str | None) -> list[Node]:
    """All elements in page order, the root first."""
    parser = PageParser()
    parser.feed((html or "").replace("\x00", ""))
    parser.close()
    order, todo = [], [parser.root]
    while todo:
        node = todo.pop()
        node.index = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    return order


TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = len(TAGS) + 2 * len(SENSES) + 18


def features(order: list[Node]) -> np.ndarray:
    """One row for each element."""
    n, t, s = len(order), len(TAGS), len(SENSES)
    x = np.zeros((n, N_FEATURES), np.float32)
    # Letters, words, stops, letters in links, elements, blocks: of each element, then of its subtree.
    own = []
    in_link = [False] * n
    for node in order:
        i = node.index
        in_link[i] = link = node.tag == "a" or (node.parent is not None and in_link[node.parent.index])
        if node.tag in TAG_AT:
            x[i, TAG_AT[node.tag]] = 1
        if node.senses:
            x[i, [t + k for k in node.senses]] = 1
        if node.hidden:
            own.append((0, 0, 0, 0, 0, 0))
            continue
        text = " ".join([p for p in node.pieces if p.__class__ is str]).strip()
        node.letters = size = len(text)
        stops = len(_STOPS.findall(text)) if size else 0
        own.append((size, len(text.split()) if size else 0, stops, size if link else 0, 1, node.tag in BLOCKS))
    below = [list(o) for o in own]
    for node in reversed(order):
        if node.parent:
            up = below[node.parent.index]
            for k, v in enumerate(below[node.index]):
                up[k] += v
    page = max(1, below[0][0])
    rows = [None] * n
    places = {0: (0, 1, max(1, below[0][0]), below[0][0], 1)}
    for node in order:
        i = node.index
        if node.children:
            sizes = [below[c.index][0] for c in node.children]
            total, largest, count = max(1, sum(sizes)), max(sizes), len(sizes)
            tags: dict[str, int] = {}
            for c in node.children:
                tags[c.tag] = tags.get(c.tag, 0) + 1
            for k, c in enumerate(node.children):
                places[c.index] = (k, count, total, largest, tags[c.tag])
        letters, words, stops, linked, elements, blocks = below[i]
        own_letters, own_words, own_stops = own[i][:3]
        place, count, total, largest, alike = places[i]
        rows[i] = (
            node.depth, letters, words / max(1, elements), linked / max(1, letters), stops / max(1, words), letters / page,
            own_letters, own_letters / max(1, letters), len(node.children), blocks, count, place / count, letters / total,
            letters >= largest, alike / count, own_stops / max(1, own_words), own_words, letters / max(1, blocks),
        )
    x[:, t + 2 * s :] = rows
    # The senses of all ancestors: parents come before their children.
    for node in order[1:]:
        up = x[node.parent.index]
        if up[t : t + 2 * s].any():
            x[node.index, t + s : t + 2 * s] = np.maximum(up[t + s : t + 2 * s], up[t : t + s])
    return x


class BoostedTrees:
    """Trees of one depth for the logistic loss, split on quantiles; all their nodes in three arrays."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.2, bins: int = 32, share: float = 0.4):
        self.share = share  # of the rows that each tree sees
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base = 0.0
        self.column, self.limit, self.leaf = [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        rng, every = np.random.default_rng(29), (binned, y, weight)
        for _ in range(self.trees):
            some = rng.random(len(every[1])) < self.share
            binned, y, weight = (part[some] for part in every)
            score = margin[some]
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(len(y), np.int64)  # node of the complete tree
            column, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            split_bin = np.full(inner, self.bins + 1)
            for level in range(self.depth):
                low, count = (1 << level) - 1, 1 << level
                local = at - low
                best = np.full(count, 1e-6)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue  # one value only
                    width = len(cuts[f]) + 1
                    key = local * width + binned[:, f]
                    gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                    hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[:, -1] = 0
                    where = gain.argmax(axis=1)
                    value = gain[np.arange(count), where]
                    better = np.flatnonzero(value > best)
                    best[better] = value[better]
                    column[low + better], split_bin[low + better] = f, where[better]
                    limit[low + better] = cuts[f][where[better]]
                at = 2 * at + 1 + (binned[np.arange(len(y)), column[at]] > split_bin[at])
            leaf = at - inner
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
            self.column.append(column)
            self.limit.append(limit)
            self.leaf.append(value)
            margin += self._tree(len(self.leaf) - 1, x)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for i in range(len(self.leaf)):
            score += self._tree(i, x)
        return score

    def _tree(self, i: int, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.column[i][at]] > self.limit[i][at])
        return self.leaf[i][at - ((1 << self.depth) - 1)]


OUT, FRAME, IN = 0, 1, 2
#: What it costs to leave out a part of a kept element.
CUT = 3.0


def decode(order: list[Node], odds: np.ndarray) -> None:
    """Sets ``kept`` of each element by the best consistent labelling; an element counts by its own text, and a little.

    Paragraphs and the like share the fate of their container: only containers and elements whose attributes say
    something can be left out of a kept element, or be kept in a frame.
    """
    odds = np.clip(odds, -6, 6).tolist()
    value: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * len(order)
    left = [0.0] * len(order)  # what leaving it out of a kept element is worth
    for node in reversed(order):
        i = node.index
        frame, inside = -0.05, (0.2 + math.log1p(node.letters)) * odds[i]
        for c in node.children:
            frame += 0.0 if c.tag in PARTS and not c.senses else max(value[c.index])
            inside += max(value[c.index][IN], left[c.index])
        if node.hidden:
            frame = inside = -1e9
        value[i] = 0.0, frame, inside
        left[i] = -CUT if node.hidden or node.senses or node.tag not in PARTS else -4 * CUT * (1 + math.log1p(node.letters))
    label = [OUT] * len(order)
    for node in order:
        v = value[node.index]
        above = FRAME if node.parent is None else label[node.parent.index]
        if above == FRAME:
            label[node.index] = OUT if node.tag in PARTS and not node.senses else v.index(max(v))
        elif above == IN and v[IN] >= left[node.index]:
            label[node.index] = IN
        node.kept = label[node.index] == IN


def text_of_nodes(order: list[Node]) -> str:
    """Kept text: blocks in page order, one to a line."""
    blocks, current = [], []

    def close():
        text = _SPACE.sub(" ", "".join(current)).strip()
        if text:
            blocks.append(text)
        current.clear()

    todo = [("open", order[0])]
    while todo:
        what, item = todo.pop()
        if what == "text":
            current.append(item)
        elif what == "close":
            close()
        elif not item.hidden:
            if item.tag == "br":
                current.append(" ")
            block = item.tag in BLOCKS
            if block:
                close()
                todo.append(("close", None))
            for piece in reversed(item.pieces):
                if isinstance(piece, Node):
                    todo.append(("open", piece))
                elif item.kept:
                    todo.append(("text", piece))
    close()
    return "\n".join(blocks)


def extract(html: str | None, model: BoostedTrees | None) -> str:
    if not html or not html.strip():
        return ""
    return extract_all([html], model)[0]


def extract_all(pages: list[str | None], model: BoostedTrees | None) -> list[str]:
    """Texts of many pages; the trees see all their elements at once."""
    trees = [parse(p) for p in pages]
    rows = [features(t) for t in trees] if model else []
    odds = model.log_odds(np.concatenate(rows)) if rows else None
    texts, at = [], 0
    for order in trees:
        if len(order) == 1:  # no markup at all
            order[0].kept = True
        elif model is None:
            for node in order:
                node.kept = not node.hidden
        else:
            decode(order, odds[at : at + len(order)])
            if not any(node.kept for node in order):
                _keep_best(order, odds[at : at + len(order)])
        at += len(order)
        texts.append(text_of_nodes(order))
    return texts


def _keep_best(order: list[Node], odds: np.ndarray) -> None:
    """Where nothing was judged content: the marked article, else the likeliest container outside menus and the like."""
    truth = weak_truth(order)
    if truth is not None:
        for node in order:
            node.kept = bool(truth[node.index]) and not node.hidden
        return
    letters = [node.letters for node in order]
    for node in reversed(order[1:]):
        letters[node.parent.index] += letters[node.index]
    named = [False] * len(order)  # it or an element above says that it is something else
    best, most = None, 0.0
    for node in order:
        i = node.index
        named[i] = any(k > 0 for k in node.senses) or node.hidden or (node.parent is not None and named[node.parent.index])
        if not named[i] and letters[i] and node.tag not in PARTS:
            score = float(odds[i]) + math.log1p(letters[i])
            if best is None or score > most:
                best, most = node, score
    if best is not None:
        best.kept = True
        for node in order[best.index + 1 :]:
            node.kept = node.parent.kept and not named[node.index]


# Training pages.

_CONTAINERS = ["article", "main", "div", "section", "td", "div", "div"]
_CONTENT_CLASSES = ["content", "post", "entry-content", "story", "article-body", "main", "post-body", "text", "", "", "box", "c1", "col-8"]
_FRAMES = ["", "wrapper", "container", "page", "layout", "grid"]


def marked_article(order: list[Node]) -> Node | None:
    """The page's only article or main element."""
    found = [n for n in order if n.tag in ("article", "main") and not n.hidden]
    return found[0] if len(found) == 1 else None


_DROPPED = set("nav aside footer form header".split())


def weak_truth(order: list[Node]) -> np.ndarray | None:
    """1 for the elements in the marked article but not in a menu, form or the like inside it; None without an article."""
    article = marked_article(order)
    if article is None:
        return None
    truth = np.zeros(len(order))
    for node in order:
        if node is article:
            truth[node.index] = 1
        elif node.parent and truth[node.parent.index] and node.tag not in _DROPPED and not any(k > 0 for k in node.senses):
            truth[node.index] = 1
    return truth


def _rebuilt(passages: list[str], others: list[str], rng) -> str:
    """A page of other structure around ``passages``, its content marked by ``data-truth``; ``others`` fill the rest."""
    from html import escape

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def words(low, high):
        w = pick(others).split() or ["x"]
        size = int(rng.integers(low, high))
        return escape(" ".join(w[:size]))

    def named(tag, sense, inner, tags=("div", "section")):
        word = pick(PAGE_WORDS[sense])
        tag = pick([tag, *tags])
        style = int(rng.integers(4))
        attr = "" if tag == pick([tag, "-"]) and tag not in tags else [f' class="{word}"', f' id="{word}"', f' class="x-{word} box"', f' class="{word.title()}Block"'][style]
        return f'<{tag}{attr} data-truth="0">{inner}</{tag}>'

    def links(low, high):
        items = "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(int(rng.integers(low, high))))
        return f"<ul>{items}</ul>"

    def prose(low, high):
        return "".join(f"<p>{words(3, 40)}</p>" for _ in range(int(rng.integers(low, high))))

    rest = {
        "menu": lambda: named("nav", "menu", links(3, 10), ("div", "ul")),
        "edge": lambda: named(pick(["header", "footer"]), "edge", pick([words(2, 20), prose(1, 3), links(2, 5), f"<h1>{words(1, 6)}</h1>" + links(2, 4)])),
        "side": lambda: named("aside", "side", f"<h3>{words(1, 4)}</h3>" + pick([links(2, 8), prose(1, 4)])),
        "advert": lambda: named("div", "advert", pick([words(3, 25), prose(1, 2)])),
        "notice": lambda: named("div", "notice", f"<p>{words(5, 25)}</p><button>{words(1, 3)}</button>"),
        "form": lambda: named("form", "form", f'<form><label>{words(1, 4)}</label><input name="q"><button>{words(1, 2)}</button></form>'),
        "comment": lambda: named("div", "comment", f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="{pick(PAGE_WORDS["comment"])}"><b>{words(1, 3)}</b>{prose(1, 3)}</div>' for _ in range(int(rng.integers(1, 6))))),
        "share": lambda: named("div", "share", links(2, 5)),
    }
    body = []
    for i, text in enumerate(passages):
        inner = escape(text)
        style = int(rng.integers(12))
        if i == 0:
            inner = f"<{pick(['h1', 'h1', 'h2'])}>{inner}</{'h1'}>" if style < 9 else f"<p>{inner}</p>"
        elif style == 0:
            inner = f"<blockquote><p>{inner}</p></blockquote>"
        elif style == 1:
            inner = f"<ul><li>{inner}</li></ul>"
        elif style == 2:
            inner = f"<p><b>{inner}<br>"
        elif style == 3:
            inner = f"<h2>{inner[:60]}</h2><p>{inner}"
        elif style == 4:
            inner = f'<p>{inner[:20]}<a href="/y">{inner[20:40]}</a>{inner[40:]}</p>'
        else:
            inner = f"<p>{inner}</p>"
        body.append(inner)
        if rng.random() < 0.06:
            body.append(rest[pick(["advert", "share", "notice", "side", "form"])]())
    kind, word = pick(_CONTAINERS), pick(_CONTENT_CLASSES)
    if rng.random() < 0.25:
        body.append(rest[pick(["comment", "share", "side"])]())
    attr = f' class="{word}"' if word else ""
    content = f'<{kind}{attr} data-truth="1">' + "".join(body) + f"</{kind}>"
    if kind == "td":
        content = f"<table><tr>{content}</tr></table>"
    before = [rest[k]() for k in ("menu", "edge", "notice", "advert", "side", "form") if rng.random() < 0.45]
    after = [rest[k]() for k in ("side", "advert", "share", "comment", "comment", "edge", "form", "notice") if rng.random() < 0.4]
    if rng.random() < 0.12:
        before, after = [], []
    frame = pick(_FRAMES)
    middle = f'<div class="{frame}">' + content + (rest["side"]() if rng.random() < 0.3 else "") + "</div>" if rng.random() < 0.5 else content
    return f"<html><head><title>{escape(passages[0])}</title></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>"


def fit_pages(pages: list[str]) -> BoostedTrees | None:
    """Trees fitted on ``pages`` and on rebuilt variants of them."""
    rng = np.random.default_rng(17)
    parsed = [parse(p) for p in pages]
    xs, ys, originals = [], [], []
    for order in parsed:
        truth = weak_truth(order)
        if truth is None:
            continue
        xs.append(features(order))
        ys.append(truth)
        for node in order:
            node.kept = bool(truth[node.index])
        lines = text_of_nodes(order).split("\n")
        if lines and lines[0]:
            originals.append(lines)
    if not originals:
        for order in parsed:
            for node in order:
                node.kept = not node.hidden
            lines = [line for line in text_of_nodes(order).split("\n") if line]
            if lines:
                originals.append(lines)
    if not originals:
        return None
    others = [line for lines in originals for line in lines[1:]] or originals[0]
    for lines in originals:
        for _ in range(VARIANTS):
            order = parse(_rebuilt(lines[:40], others, rng))
            xs.append(features(order))
            ys.append(np.array([float(node.truth == "1") for node in order]))
    x, y = np.concatenate(xs), np.concatenate(ys)
    weight = 0.3 + np.log1p(x[:, len(TAGS) + 2 * len(SENSES) + 6].astype(float)) / 4
    return BoostedTrees().fit(x, y, weight)


def fit(pages: DataFrame, sample_pages: int = SAMPLE) -> BoostedTrees | None:
    """The trees for ``pages``, fitted on at most ``sample_pages`` of them, those with the smallest hash of their address."""
    shown = pages.where("html is not null and html <> ''").select("html", F.xxhash64("url", "page_id").alias("at"))
    # Addresses are chosen first, so that no task sends pages that are not taken; both sides are bounded then.
    chosen = F.broadcast(shown.select("at").distinct().orderBy("at").limit(sample_pages))
    return fit_pages([r.html for r in shown.join(chosen, "at").orderBy("at", "html").limit(sample_pages).collect()])


def with_main_text(pages: DataFrame, model: BoostedTrees | None, drop: tuple[str, ...] = ("html",)) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def run(htmls):
            texts = []
            for at in range(0, len(htmls), 200):
                texts += extract_all(htmls[at : at + 200], fitted)
            return texts, [len(t) for t in texts]

        return run

    return per_row(pages, ["html"], [("text", "string"), ("n_chars", "bigint")], make, drop)
