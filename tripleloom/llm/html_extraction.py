"""Main text of web pages by a graphical model over the DOM tree.

Every element is a node with a hidden label, content or not. Node potentials
come from the element's tag, attributes and text; potentials on the edge from
parent to child depend on the child's kind. Sum-product message passing, once
upward and once downward, gives each node's marginal probability of being
content. All pages of a batch form one forest that is passed level by level.
Weights are trained by exact likelihood on labelled pages, which
``labelled_pages`` makes from templates.

Nulls: null or empty html gives an empty text. Unclosed, misnested and cut-off
markup is repaired as browsers do it, in short, in time linear in the page
however deep it nests. A very long page is a group of its own. Repeated rows are extracted
alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_entities
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose trees are passed together: so many, and so many characters of markup unless one page has more.
GROUP = 200
GROUP_CHARS = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
# Fixed values of the HTML standard: elements without content, with raw content, and of inline kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}

TAGS = (
    "html head body article main section div p h1 h2 h3 blockquote pre ul ol li dl table tr td figure figcaption a nav header footer aside form button "
    "select input label script style title noscript iframe svg menu details dialog".split()
)
KEYWORDS = (
    "content article post entry main body story text page wrapper container "
    "ad ads advert advertisement sponsor sponsored promo banner popup modal overlay cookie consent notice alert gdpr warning "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead top footer bottom copyright legal "
    "sidebar side aside widget related recommended popular trending share social follow newsletter subscribe signup login form search "
    "comment comments discussion reply replies respond disqus reader feedback tags meta byline hidden pagination pager toolbar skip".split()
)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_WORD_AT = {w: len(TAGS) + 1 + i for i, w in enumerate(KEYWORDS)}
_EXTRA = len(TAGS) + 1 + len(KEYWORDS)
FEATURES = _EXTRA + 10
#: Kinds of edges: to an inline child, to a paragraph-like child, to any other.
KINDS = 3
_PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tr td th tbody thead figure figcaption br hr".split())


class Tree:
    """A page's elements and its text pieces in page order."""

    def __init__(self):
        self.tag: list[str] = ["#page"]
        self.names: list[tuple[str, ...]] = [()]
        self.hidden: list[bool] = [False]
        self.mark: list[str | None] = [None]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        #: (element, text); a text of None is a break between blocks.
        self.pieces: list[tuple[int, str | None]] = []


def parse(page: str | None) -> Tree:
    """Read markup into a tree, repairing what is open or misplaced."""
    tree = Tree()
    text = page or ""
    stack = [0]
    #: Places in the stack of the open elements by tag, and of those that are not inline, so that no tag walks the stack.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[tree.tag[node]].pop()
            if tree.tag[node] not in INLINE:
                blocks.pop()
        del stack[k:]

    def close(tags: set[str], stop: set[str]) -> None:
        k = last(tags)
        if k > last(stop):
            tree.pieces.append((stack[k], None))
            cut(k)

    def say(piece: str) -> None:
        if piece:
            tree.pieces.append((stack[-1], html_entities.unescape(piece)))

    at, end = 0, len(text)
    while at < end:
        found = _TOKEN.search(text, at)
        if found is None:
            say(text[at:])
            break
        say(text[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            k = last([tag])
            if tag not in INLINE and k:
                tree.pieces.append((stack[k], None))
                cut(k)
            elif k and k > (blocks[-1] if blocks else 0):
                cut(k)
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            close(CLOSES[tag], HOLDS[tag])
        node = len(tree.tag)
        names, hidden, mark = _attributes(found[3])
        tree.tag.append(tag)
        tree.names.append(names)
        tree.hidden.append(hidden)
        tree.mark.append(mark)
        tree.parent.append(stack[-1])
        tree.depth.append(tree.depth[stack[-1]] + 1)
        if tag not in INLINE:
            tree.pieces.append((node, None))
        if tag in VOID or found[3].rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            # Found without lowering the page, which would shift places for a few characters.
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            tree.pieces.append((node, text[at : stop.start() if stop else end]))
            tree.pieces.append((node, None))
            at = stop.end() if stop else end
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(node)
    return tree


def _attributes(text: str) -> tuple[tuple[str, ...], bool, str | None]:
    """(words of class, id, role and label; hidden or not; training mark)."""
    if not text or "=" not in text and "hidden" not in text:
        return (), False, None
    words: list[str] = []
    hidden, mark = False, None
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words += re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "data-train-label":
            mark = value
    return tuple(w for w in words if w), hidden, mark


def features(tree: Tree) -> np.ndarray:
    """One row of features for each element."""
    n = len(tree.tag)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, piece in tree.pieces:
        if piece:
            own[node] += len(piece.strip())
            stops[node] += piece.count(".") + piece.count(",")
    whole, whole_stops = own.copy(), stops.copy()
    linked = np.where(np.array([t == "a" for t in tree.tag]), own, 0.0)
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        whole[up] += whole[node]
        whole_stops[up] += whole_stops[node]
        linked[up] += linked[node]
        if tree.tag[node] == "a":
            linked[up] += whole[node] - linked[node]
    for node in range(n):
        out[node, _TAG_AT.get(tree.tag[node], len(TAGS))] = 1
        for word in tree.names[node]:
            if word in _WORD_AT:
                out[node, _WORD_AT[word]] = 1
    density = linked / np.maximum(whole, 1)
    total = max(whole[0], 1.0)
    out[:, _EXTRA] = 1
    out[:, _EXTRA + 1] = np.log1p(own) / 5
    out[:, _EXTRA + 2] = np.log1p(whole) / 8
    out[:, _EXTRA + 3] = density
    out[:, _EXTRA + 4] = density > 0.6
    out[:, _EXTRA + 5] = whole / total
    out[:, _EXTRA + 6] = np.minimum(whole_stops / np.maximum(whole, 1) * 20, 2)
    out[:, _EXTRA + 7] = tree.hidden
    out[:, _EXTRA + 8] = np.minimum(np.array(tree.depth) / 8, 2)
    out[:, _EXTRA + 9] = whole == 0
    return out


class Forest:
    """Trees side by side, with the order in which messages pass."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        base = np.cumsum([0, *sizes])[:-1]
        self.rows = np.concatenate([features(t) for t in trees])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + b) for t, b in zip(trees, base)])
        self.kind = np.array([0 if tag in INLINE else 1 if tag in _PARAGRAPH else 2 for t in trees for tag in t.tag])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 1)) if len(depth) else []
        self.levels = np.split(order, cuts)
        self.base = base

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of content for each node, joint label probabilities on the edge to its parent).

        ``edges[kind, parent label, child label]`` are log potentials.
        """
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = self.rows @ weights
        table = edges[self.kind]
        up = np.zeros((n, 2))
        belief = unary.copy()
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(table[level, :, 0] + belief[level, None, 0], table[level, :, 1] + belief[level, None, 1])
            np.add.at(belief, self.parent[level], up[level])
        joint = np.zeros((n, 2, 2))
        whole = belief.copy()
        for level in self.levels[1:]:
            rest = whole[self.parent[level]] - up[level]
            pair = rest[:, :, None] + table[level] + belief[level][:, None, :]
            whole[level] = np.logaddexp(pair[:, 0], pair[:, 1])
            top = pair.max(axis=(1, 2), keepdims=True)
            p = np.exp(pair - top)
            joint[level] = p / p.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500))), joint


def labelled_pages(count: int = 160, seed: int = 5) -> list[str]:
    """Training pages; elements carry their label in ``data-train-label``."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v".split() for b in "a e i o u".split()]

    def words(n: int, stop: bool = True) -> str:
        said = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
        if stop:
            for k in range(6, n, 9):
                said[k] += rng.choice([",", ".", "."])
        return " ".join(said).capitalize() + ("." if stop else "")

    def el(tag: str, inner: str, label: int, attrs: str = "") -> str:
        return f'<{tag}{" " + attrs if attrs else ""} data-train-label="{label}">{inner}</{tag}>'

    def links(n: int, label: int) -> str:
        return el("ul", "".join(el("li", el("a", words(rng.randint(1, 3), False), label, 'href="/x"'), label) for _ in range(n)), label)

    def junk() -> str:
        cls = rng.choice(
            "ad advert advertisement sponsor sponsored promo banner popup modal overlay cookie consent notice alert gdpr sidebar widget related recommended popular trending share social "
            "follow newsletter subscribe signup login search comments comment discussion replies respond disqus feedback tags breadcrumb breadcrumbs pagination menu navbar navigation masthead footer copyright legal toolbar".split()
        )
        attr = rng.choice([f'class="{cls}"', f'id="{cls}"', f'class="{cls} box"', f'class="site-{cls}"'])
        inner = rng.choice([
            lambda: words(rng.randint(3, 60)), lambda: el("p", words(rng.randint(4, 50)), 0), lambda: links(rng.randint(2, 6), 0),
            lambda: el("h3", words(3, False), 0) + "".join(el("p", words(rng.randint(5, 40)), 0) for _ in range(rng.randint(1, 4))),
        ])()
        return el(rng.choice(["div", "div", "section", "aside"]), inner, 0, attr)

    def part() -> str:
        return rng.choice([
            lambda: el("nav", links(rng.randint(3, 8), 0), 0), lambda: el("header", el("h2", words(2, False), 0) + links(3, 0), 0, 'class="header"'),
            lambda: el("header", words(rng.randint(2, 9)), 0), lambda: el("aside", el("p", words(rng.randint(5, 50)), 0), 0), lambda: el("aside", links(4, 0), 0),
            lambda: el("form", el("label", words(2, False), 0) + el("button", words(1, False), 0), 0), junk, junk, junk,
            lambda: el("script", "var t = 1;", 0), lambda: el("style", "p{margin:0}", 0), lambda: el("noscript", words(6), 0),
            lambda: el("div", words(rng.randint(4, 30)), 0, 'style="display:none"'),
        ])()

    def comments() -> str:
        word = rng.choice("comment comments discussion replies respond disqus reply".split())
        each = [el("p", words(rng.randint(2, 40)), 0) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.6:
            each = [el("div", x, 0, f'class="{rng.choice(["comment", "reply", "item"])}"') for x in each]
        head = el("h3", words(2, False), 0) if rng.random() < 0.5 else ""
        return el(rng.choice(["div", "section"]), head + "".join(each), 0, f'{rng.choice(["class", "id"])}="{word}"')

    def foot() -> str:
        return rng.choice([
            lambda: el("footer", "&copy; " + words(rng.randint(3, 20)), 0), lambda: el("footer", el("p", words(rng.randint(3, 30)), 0) + links(3, 0), 0),
            lambda: el("div", words(rng.randint(3, 20)), 0, 'class="footer"'), comments,
        ])()

    def para() -> str:
        inner = words(rng.choice([rng.randint(1, 12), rng.randint(8, 90)]))
        if rng.random() < 0.3:
            inner += " " + el(rng.choice(["a", "b", "em", "span", "strong", "i"]), words(rng.randint(1, 12), False), 1) + " " + words(rng.randint(1, 30))
        if rng.random() < 0.15:
            inner = el("b", inner, 1)
        return el("p", inner, 1)

    def body() -> str:
        return rng.choice([
            para, para, para, para, lambda: el("h2", words(rng.randint(1, 6), False), 1), lambda: el("blockquote", para(), 1), lambda: el("pre", words(12), 1),
            lambda: el("ul", "".join(el("li", words(rng.randint(2, 25)), 1) for _ in range(rng.randint(2, 5))), 1), lambda: el("ol", "".join(el("li", words(rng.randint(2, 20)), 1) for _ in range(3)), 1),
            lambda: el("table", el("tr", el("td", words(4, False), 1) + el("td", words(5, False), 1), 1), 1), lambda: el("figure", el("figcaption", words(8), 1), 1),
            lambda: el("section", el("h2", words(3, False), 1) + para() + para(), 1), lambda: el("div", para() + para(), 1), lambda: el("div", words(rng.randint(10, 60)), 1),
        ])()

    pages = []
    for _ in range(count):
        inner = el("h1", words(rng.randint(1, 9), False), 1) if rng.random() < 0.7 else ""
        for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 9])):
            inner += body()
            if rng.random() < 0.12:
                inner += part()
        if rng.random() < 0.4:
            inner += rng.choice([comments, junk])()
        attrs = rng.choice(["class='content'", "class='article-body'", "id='main'", "class='post entry'", "class='story text'", "id='content'", "role='main'"])
        article = rng.choice([
            lambda: el("article", inner, 1), lambda: el("article", inner, 1), lambda: el("main", inner, 1), lambda: el("main", el("article", inner, 1), 1),
            lambda: el("div", inner, 1, attrs), lambda: el("section", inner, 1, attrs), lambda: el("div", el("div", inner, 1, attrs), 1, "class='wrapper container'"),
        ])()
        before, after = "".join(part() for _ in range(rng.randint(0, 4))), "".join(part() for _ in range(rng.randint(0, 3)))
        middle = before + article + after + (foot() if rng.random() < 0.8 else "") + (foot() if rng.random() < 0.3 else "")
        if rng.random() < 0.3:
            middle = el("div", middle, 1, rng.choice(["class='page'", "id='wrapper'", "class='container'"]))
        if rng.random() < 0.25:
            pages.append(middle)
            continue
        pages.append(el("html", el("head", el("title", words(4, False), 0) + el("style", "a{}", 0), 0) + el("body", middle, 1), 1))
    return pages


@functools.cache
def fit_pages(count: int = 300, rounds: int = 200, rate: float = 0.08, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, edge potentials) that maximise the labelled pages' likelihood (Adam)."""
    trees = [parse(p) for p in labelled_pages(count)]
    forest = Forest(trees)
    label = np.array([1 if m is None else int(m) for t in trees for m in t.mark])
    child = forest.parent >= 0
    truth = np.zeros((len(label), 2, 2))
    truth[np.flatnonzero(child), label[forest.parent[child]], label[child]] = 1
    theta = np.zeros(FEATURES + KINDS * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, edges = theta[:FEATURES], theta[FEATURES:].reshape(KINDS, 2, 2)
        p, joint = forest.marginals(weights, edges)
        slope = [forest.rows.T @ (label - p)]
        slope += [(truth - joint)[child & (forest.kind == k)].sum(axis=0).ravel() for k in range(KINDS)]
        g = np.concatenate(slope) / len(label) * 10 - ridge * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:FEATURES], theta[FEATURES:].reshape(KINDS, 2, 2)


#: Elements whose text is never shown as text.
_NEVER = {"script", "style", "title", "noscript", "iframe", "template", "textarea", "noembed", "noframes", "head", "svg", "select", "button"}


def extract(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = forest.marginals(*model)
    texts = []
    for tree, base in zip(trees, forest.base):
        shown = []
        for node, piece in tree.pieces:
            if piece is None:
                shown.append(" ")
            elif p[base + node] >= 0.5 and tree.tag[node] not in _NEVER:
                shown.append(piece)
            elif node == 0 or tree.tag[node] not in INLINE:
                shown.append(" ")
        texts.append(" ".join("".join(shown).split()))
    return texts


def page_groups(pages: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first place, pages) of neighbours that are passed together."""
    sizes = pc.fill_null(pc.utf8_length(pages), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == GROUP or held + size > GROUP_CHARS):
            yield start, pages.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, pages.slice(start).to_pylist()


def _run(model: tuple[np.ndarray, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, pages in page_groups(batch.column(2)):
                part = batch.slice(at, len(pages))
                texts = extract(pages, model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run(fit_pages()), "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
