"""Main text of web pages: gradient-boosted trees over the nodes of the page's tree, and hierarchical decoding.

Each element gets a score from its tag, depth, sibling statistics, density of its subtree, and the tokens of its attributes
and of those above it. Decoding keeps a set of elements that is closed upwards and has the largest sum of scores, so that no
element is kept below one that is dropped.

The trees are fitted on the driver from a bounded sample of pages, whose own semantic elements label them. Copies of the sample
with other markup (plain containers for the article, further elements in it, and menus, notices, forms and comments around and in it) teach
the trees what the sample does not have.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrim.llm.common import arrow_map

#: A comment, script or style runs to the end of the page when it is not closed.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose inside is skipped up to their closing tag, if there is one further on.
SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template", "textarea", "svg", "iframe")}
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a line; every other one begins and ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: An opening tag of the key closes an open element of these, if no container is in between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
CONTAINERS = frozenset("html body div article section main table ul ol dl blockquote aside nav header footer form figure".split())
HIDDEN = frozenset(["head", "title", "button", "select", "option"])
#: What labels the sample: elements with the article, and elements without any of it.
MAIN, ASIDE = frozenset(["article", "main"]), frozenset("nav footer aside form header menu dialog".split())
ASIDE_TOKENS = frozenset(
    "ad ads advert advertisement banner promo sponsored sidebar menu nav navbar breadcrumb footer header comment comments cookie "
    "notice consent newsletter subscribe related share social popup modal widget".split()
)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    sibling: int = 0
    children: int = 0
    own: int = 0  # code points of its own text
    tags: int = 0  # elements below
    chars: int = 0  # code points below, its own among them
    linked: int = 0  # of these, in links
    stops: int = 0  # marks of punctuation below


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) in page order; node -1 begins a new block.
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of a page, broken ones too: open elements end with the page, stray ends are ignored."""
    page = Page([Node("#root", -1, 0)])
    nodes, pieces, stack = page.nodes, page.pieces, [0]
    opened: Counter = Counter()  # how many elements of each tag are on the stack: it is searched only for those that are

    def leave(k: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[k:])
        del stack[k:]

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            value = entities.unescape(raw)
            node = nodes[stack[-1]]
            visible = len(value.strip())
            node.own += visible
            node.stops += sum(value.count(c) for c in ".,;:!?")
            pieces.append((stack[-1], value))
        elif raw:
            pieces.append((stack[-1], " "))

    # Where the last closing tag of each begins: behind it, no opening one is looked for further.
    lowered = source.lower()
    last = {t: lowered.rfind(f"</{t}") for t in SKIPPED} if len(lowered) == len(source) else dict.fromkeys(SKIPPED, len(source))
    at = 0
    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in SKIPPED and not m[2] and not m[4].endswith("/") and at <= last[tag]:
            if closed := SKIPPED[tag].search(source, at):
                at = closed.end()
                continue
        if tag not in INLINE:
            pieces.append((-1, ""))
        elif tag == "br":
            pieces.append((stack[-1], " "))
        if m[2]:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if nodes[stack[k]].tag == tag:
                    leave(k)
                    break
                if nodes[stack[k]].tag in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag in VOID:
            continue
        shut = {"p"} if tag not in INLINE else set()
        shut |= CLOSES.get(tag, set())
        for k in range(len(stack) - 1 if any(opened[t] for t in shut) else 0, 0, -1):
            name = nodes[stack[k]].tag
            if name in shut:
                leave(k)
                break
            if name in CONTAINERS:
                break
        parent = stack[-1]
        tokens = ()
        if m[4] and "=" in m[4]:
            values = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[4]))
            tokens = tuple(re.findall(r"[a-z]+", values.lower()))
        nodes.append(Node(tag, parent, len(stack), tokens, nodes[parent].children))
        nodes[parent].children += 1
        if not m[4].endswith("/"):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    text(source[at:])
    for i in range(len(nodes) - 1, 0, -1):
        node, above = nodes[i], nodes[nodes[i].parent]
        node.chars += node.own
        if node.tag == "a":
            node.linked = node.chars
        above.chars += node.chars
        above.linked += node.linked
        above.stops += node.stops
        above.tags += node.tags + 1
    nodes[0].chars += nodes[0].own
    return page


#: Hashed places of tags and attribute tokens: of the element itself, and of all above it.
PLACES = 512
NUMBERS = 10


def _place(word: str) -> int:
    return zlib.crc32(word.encode()) % PLACES


def features(page: Page, columns: dict[int, int] | None = None) -> np.ndarray:
    """One row an element: numbers in 16 steps, then flags of its tag and tokens, then flags of those above it.

    With ``columns`` (number: place in the row) only these are made.
    """
    nodes = page.nodes
    width = NUMBERS + 3 * PLACES
    columns = columns if columns is not None else {k: k for k in range(width)}
    out = np.zeros((len(nodes), len(columns)), np.uint8)
    above_places = np.array([j for k, j in columns.items() if k >= NUMBERS + 2 * PLACES], np.int64)
    whole = max(1, nodes[0].chars)
    numbers = []
    for i, n in enumerate(nodes):
        above = nodes[max(n.parent, 0)]
        numbers.append((
            n.own, n.chars, n.tags, 15 * n.linked / max(1, n.chars), n.depth, n.sibling, above.children - n.sibling,
            n.chars / (n.tags + 1), 200 * n.stops / max(1, n.chars), 15 * n.chars / whole,
        ))
        flags = [NUMBERS + _place(n.tag)]
        if i:
            out[i, above_places] = out[n.parent, above_places]
            flags.append(NUMBERS + 2 * PLACES + _place(n.tag))
        for t in n.tokens:
            flags += [NUMBERS + PLACES + _place(t), NUMBERS + 2 * PLACES + _place("." + t)]
        for k in flags:
            if k in columns:
                out[i, columns[k]] = 1
    table = np.array(numbers)
    for k in (0, 1, 2, 7):
        table[:, k] = 1.5 * np.log2(table[:, k] + 1)
    for k in range(NUMBERS):
        if k in columns:
            out[:, columns[k]] = np.minimum(table[:, k], 15)
    return out


@dataclass
class Trees:
    """Complete trees of one depth: for each, the feature and limit of every inner node, and the leaves' scores."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - len(feature)]
        return total

    def local(self) -> tuple[Trees, dict[int, int]]:
        """The same trees over the features they look at, and the places of these."""
        used = np.unique(self.feature)
        return Trees(self.start, np.searchsorted(used, self.feature), self.limit, self.leaf), {int(k): j for j, k in enumerate(used)}


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3) -> Trees:
    """Trees of logistic loss, by Newton steps over histograms of the 16 steps of each feature."""
    rounds = rounds if len(y) and 0 < y.mean() < 1 else 0
    # A tag or token that all elements have, or none, says nothing; so what the sample lacks has no evidence of its own.
    told = np.flatnonzero(x.min(axis=0) < x.max(axis=0)) if rounds else np.zeros(0, np.int64)
    x = x[:, told]
    inner, n_features = 2**depth - 1, x.shape[1]
    share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(x), start)
    found = Trees(start, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), 255, np.int64), np.zeros((rounds, inner + 1)))
    columns = np.arange(n_features) * 16
    for r in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(at == k)
            if len(mine):
                cells = (x[mine].astype(np.int64) + columns).ravel()
                gs, hs = (np.bincount(cells, np.repeat(v[mine], n_features), 16 * n_features).reshape(-1, 16).cumsum(axis=1) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                best = int(gain.argmax())
                if gain.flat[best] > 1e-3:
                    found.feature[r, k], found.limit[r, k] = divmod(best, 16)
                at[mine] = 2 * k + 1 + (x[mine, found.feature[r, k]] > found.limit[r, k])
        leaves = at - inner
        found.leaf[r] = rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + 1)
        total += found.leaf[r][leaves]
    if rounds:
        found.feature = told[found.feature]
    return found


def labels(page: Page) -> np.ndarray:
    """1 for elements with text of the article in them that are not in a part beside it; 0 for the others."""
    nodes = page.nodes
    inside, beside, keep = ([False] * len(nodes) for _ in range(3))
    for i, n in enumerate(nodes):
        up = n.parent if i else 0
        beside[i] = beside[up] or n.tag in ASIDE or n.tag in HIDDEN or not ASIDE_TOKENS.isdisjoint(n.tokens)
        inside[i] = (inside[up] or n.tag in MAIN or "x-main" in n.tag) and not beside[i]
        keep[i] = inside[i]
    for i in range(len(nodes) - 1, 0, -1):
        if keep[i]:
            keep[nodes[i].parent] = True
    return np.array(keep, np.float64)


def keep_elements(page: Page, scores: np.ndarray) -> np.ndarray:
    """The set that is closed upwards with the largest sum of scores; the root is always kept."""
    nodes = page.nodes
    best = scores.astype(np.float64).copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0 and nodes[i].tag not in HIDDEN
    return kept


def main_text(page: Page, kept: np.ndarray) -> str:
    """Blocks of kept elements, white space inside each made one space, two line feeds between."""
    blocks, current = [], []
    for node, text in (*page.pieces, (-1, "")):
        if node >= 0:
            if kept[node]:
                current.append(text)
        elif current:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
    return "\n\n".join(blocks)


BESIDE = (
    '<aside class="sidebar"><h3>{0}</h3><ul><li><a href="/x">{1}</a></li><li><a href="/y">{2}</a></li></ul></aside>',
    '<div class="cookie-notice" role="dialog"><p>{1}</p><button>{0}</button></div>',
    '<form class="newsletter" action="/s"><label>{0}</label><input type="text"><p>{1}</p></form>',
    '<div class="advert promo"><p>{1}</p></div>',
    '<header class="site-header"><a href="/">{0}</a><p>{2}</p></header>',
    '<div id="menu" class="nav menu"><a href="/a">{0}</a> <a href="/b">{2}</a></div>',
    '<div class="related"><h4>{0}</h4><a href="/r">{1}</a></div>',
    '<section id="comments" class="comments"><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>',
    '<div class="share social"><a href="/t">{0}</a><a href="/f">{2}</a></div>',
    '<div class="banner notice">{1}</div>',
)
ARTICLES = ('<div class="post content">', '<div id="content" class="entry">', "<main>", '<section class="article body">', "<article>", '<div class="story text">',
            '<div class="post">', '<div id="main">', "<div>", "<section>", "<td>", "")
#: What an article may have between and around its paragraphs.
INSIDE = (
    "<h2>{0}</h2>", "<h3>{0}</h3><p>{1}</p>", "<ul><li>{1}</li><li>{2}</li></ul>", "<ol><li>{0}</li><li>{1}</li><li>{2}</li></ol>",
    "<pre>{1}</pre>", "<pre><code>{0}</code></pre>", "<blockquote>{1}</blockquote>", "<blockquote><p>{1}</p></blockquote>",
    "<table><tr><th>{0}</th><th>{2}</th></tr><tr><td>{1}</td><td>{2}</td></tr></table>", "<dl><dt>{0}</dt><dd>{1}</dd></dl>",
    '<figure><img src="/i"><figcaption>{0}</figcaption></figure>', "<div>{1}</div>", "<div><p>{1}</p></div>", "<section><h3>{0}</h3><p>{1}</p></section>",
    '<p>{1} <a href="/l">{0}</a> {2}</p>', '<p><a href="/l">{0}</a></p>', "<p><strong>{0}</strong> {1} <em>{2}</em></p>", "<h4>{0}</h4>", "<p>{0}</p>",
)


def varied(source: str, rng: random.Random) -> str:
    """A page with other markup for its article and in it, and with further parts beside it made of its own sentences."""
    sentences = [s.strip() for s in re.split(r"[.<>\n]", re.sub(r"<[^>]*>", "\n", source)) if 3 < len(s.strip()) < 400] or ["text"]

    def made(kinds: tuple[str, ...], count: int) -> str:
        return "".join(
            rng.choice(kinds).format(*(entities.escape(entities.unescape(". ".join(rng.choices(sentences, k=k)))) + "." * (k > 1) for k in (1, rng.randint(1, 4), 1)))
            for _ in range(count)
        )

    opening = rng.choice(ARTICLES)
    name = re.match("<([a-z]+)", opening)
    closing = f"</{name[1]}>" if name else ""
    if opening == "<td>":
        opening, closing = "<table><tr><td>", "</td></tr></table>"
    head, start, rest = source.partition("<article")
    body, end, tail = rest.partition("</article>")
    if start and end:
        attributes, _, body = body.partition(">")
        blocks = re.split(r"(?<=</p>)|(?=<p>)", body)
        if rng.random() < 0.4:
            blocks = blocks[: rng.randint(1, 4)]
        share = rng.choice((0, 0.15, 0.5))
        body = "".join(b + (made(INSIDE, 1) if rng.random() < share else "") for b in blocks)
        inner = made(BESIDE, 1) if rng.random() < 0.3 else ""
        source = f"{head}{made(BESIDE, rng.randint(0, 2))}<x-main>{opening}{body}{inner}{closing}</x-main>{made(BESIDE, rng.randint(0, 3))}{tail}"
    if rng.random() < 0.3:
        source = source.replace("<nav>", '<div class="nav">').replace("</nav>", "</div>")
    if rng.random() < 0.3:
        source = source.replace("<footer>", '<div class="footer">').replace("</footer>", "</div>")
    return source


def _without_marks(page: Page) -> Page:
    """``x-main`` only marks the article of a varied page; the trees must not see it."""
    for n in page.nodes:
        if n.tag == "x-main":
            n.tag = "div"
    return page


def fit(pages: list[str], variants: int = 3) -> Trees:
    """Trees from sample pages and ``variants`` of each; deterministic. Without pages they keep all text."""
    rng = random.Random(3)
    xs, ys, ws = [], [], []
    for source in pages:
        for text in (source, *(varied(source, rng) for _ in range(variants))):
            page = parse(text)
            y = labels(page)
            # Without the marks the article may stand in its parent as it is, among the parts beside it.
            bare, own = parse(re.sub("</?x-main>", "", text)), np.array([n.tag != "x-main" for n in page.nodes])
            page, y = (bare, y[own]) if [n.tag for n in bare.nodes] == [n.tag for n in page.nodes if n.tag != "x-main"] else (_without_marks(page), y)
            xs.append(features(page))
            ys.append(y)
            ws.append(np.ones(len(y)))
    if not xs:
        return Trees(1.0, np.zeros((0, 15), np.int64), np.zeros((0, 15), np.int64), np.zeros((0, 16)))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def sample(pages: DataFrame, most: int = 300, chars: int = 100_000) -> list[str]:
    """At most ``most`` pages with an article element and at most ``chars`` characters, chosen by a hash of the html."""
    usable = pages.filter(F.col("html").contains("<article") & F.col("html").contains("</article>") & (F.length("html") <= chars))
    total = usable.count()
    part = min(1.0, 1.2 * most / max(total, 1))
    kept = usable.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < part * (1 << 20))
    return sorted(r["html"] for r in kept.select("html").limit(most).collect())


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """Replaces the column html of ``pages`` by text and n_chars (code points); other columns are kept.

    Whole pages are read; NULL, empty and pages without kept text have the empty text; repeated rows get the same text.
    """
    kept_columns = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    source = pages.select(*kept_columns, F.col("html").cast("string").alias("html"))
    schema = source.drop("html").select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    trees, places = trees.local()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                rows = batch.slice(start, 100)
                parsed = [parse(h or "") for h in rows.column("html").to_pylist()]
                scores = trees.scores(np.concatenate([features(p, places) for p in parsed]))
                ends = np.cumsum([len(p.nodes) for p in parsed])
                texts = [main_text(p, keep_elements(p, s)) for p, s in zip(parsed, np.split(scores, ends[:-1]), strict=True)]
                columns = [*(rows.column(c) for c in kept_columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept_columns, "text", "n_chars"])

    return arrow_map(source, task, schema)
