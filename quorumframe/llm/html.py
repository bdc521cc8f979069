"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a node with a hidden label, content
or not. Parent-child potentials say how likely a child with its tag, class words and
look of text shares its parent's label or departs from it. Sum-product
messages go up the tree and down again and give each node's exact marginal. The
model is counted from labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.html_pages import labelled_pages

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
# How HTML names its elements.
RAW = frozenset("script style".split())
ASIDE = frozenset("textarea noscript template svg iframe select option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body title article section main nav aside header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption form fieldset details summary address hgroup dialog menu center".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
}
_STOPS = frozenset("ul ol dl table div article section main body html aside nav header footer td th blockquote form".split())
ROOT = 0


@dataclass
class Node:
    kind: str  # a tag, or "text"
    parent: int
    features: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    label: int | None = None


class _Tags:
    """Where the tags of a name open and end in a page, looked up once for each name."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}

    def ended(self, name: str, at: int) -> int | None:
        """Where an element that opened before at has ended, if it did before another of its name opened."""
        if name not in self.known:
            found = list(re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>", self.page, re.I))
            self.known[name] = [m.start() for m in found], found
        starts, found = self.known[name]
        k = bisect_left(starts, at)
        return found[k].end() if k < len(found) and found[k][1] else None


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; inline markup leaves no node.

    Elements that are no text (ASIDE) go with all they hold where they end before
    another of their name opens. Where the end is missing, as authors and standards
    allow, only the tag goes, and of a button, option or text area what stands before
    the next block.
    """
    nodes, open_at, links, run = [Node("root", -1)], [ROOT], 0, None
    tags, muted = _Tags(page), False
    standing: Counter = Counter()  # open elements by tag, so an end tag without a beginning looks through none

    def text(piece: str) -> None:
        nonlocal run
        if not piece or muted:
            return
        if run is None:
            if piece.isspace():
                return
            nodes.append(Node("text", open_at[-1]))
            run = nodes[-1]
        run.text.append(piece)
        run.linked += len(piece) if links else 0

    def close(upto: int) -> None:
        nonlocal run
        for k in open_at[upto:]:
            standing[nodes[k].kind] -= 1
        del open_at[upto:]
        run = None

    def closed_by(tag: str) -> None:
        if tag in BLOCK and nodes[open_at[-1]].kind == "p":
            close(len(open_at) - 1)
        for at in range(len(open_at) - 1, 0, -1) if any(standing[kind] for kind in _CLOSES.get(tag, ())) else ():
            kind = nodes[open_at[at]].kind
            if kind in _CLOSES.get(tag, ()):
                return close(at)
            if kind in _STOPS and not (tag in ("td", "th", "tr") and kind in ("td", "th")):
                return None
        return None

    at, skip_to = 0, None
    while (match := _MARKUP.search(page, at)) is not None:
        text(page[at : match.start()])
        at = match.end()
        ending, tag, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if ending else 1
        elif tag in RAW and not ending:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else len(page)
        elif tag in ASIDE:
            muted = False
            if not ending and not rest.endswith("/"):
                after = tags.ended(tag, at)
                muted = after is None and tag in ("option", "button", "textarea")
                at = after or at
        elif tag == "br" or tag in VOID:
            text(" " if run is not None else "")
        elif tag in BLOCK and ending:
            muted = False
            for depth in range(len(open_at) - 1, 0, -1) if standing[tag] else ():
                if nodes[open_at[depth]].kind == tag:
                    close(depth)
                    break
            run = None
        elif tag in BLOCK:
            muted = False
            closed_by(tag)
            run = None
            words = {w for m in _ATTRIBUTE.finditer(rest) for w in _WORD.findall(m[2].lower())}
            nodes.append(Node(tag, open_at[-1], [f"tag {tag}", *(f"word {w}" for w in sorted(words))]))
            open_at.append(len(nodes) - 1)
            standing[tag] += 1
    text(page[at:])
    for node in nodes:
        if node.kind == "text":
            joined = "".join(node.text)
            node.text = [" ".join(html.unescape(joined).split())]
            size = len(joined)
            node.features = [f"long {min(12, size.bit_length())}", f"linked {round(2 * node.linked / size)}", f"stops {any(c in joined for c in '.!?')}"]
    return nodes


@dataclass
class TreeModel:
    """Logarithms by parent label and label: of a child's label by kind, and of its features; what was never seen says nothing."""

    pair: dict[str, list[list[float]]]
    feature: dict[str, list[list[float]]]

    @classmethod
    def counted(cls, pages: list[list[Node]]) -> TreeModel:
        pairs: dict[str, Counter] = defaultdict(Counter)
        seen: dict[str, Counter] = defaultdict(Counter)
        turns: Counter = Counter()
        for nodes in pages:
            for node in nodes[1:]:
                turn = nodes[node.parent].label, node.label
                pairs[_kind(node)][turn] += 1
                turns[turn] += 1
                for name in node.features:
                    seen[name][turn] += 1
        pair = {k: [[math.log((c[a, b] + 0.1) / (c[a, 0] + c[a, 1] + 0.2)) for b in (0, 1)] for a in (0, 1)] for k, c in pairs.items()}
        # what is missing in one turn is smoothed towards its share in all, so rare words still speak
        share = {f: c.total() / turns.total() for f, c in seen.items()}
        feature = {f: [[math.log((c[a, b] + share[f]) / (turns[a, b] + 1)) for b in (0, 1)] for a in (0, 1)] for f, c in seen.items()}
        return cls(pair, feature)

    def _potential(self, node: Node) -> list[list[float]]:
        out = [list(row) for row in self.pair[_kind(node)]]
        for name in node.features:
            if (weights := self.feature.get(name)) is not None:
                for a in (0, 1):
                    for b in (0, 1):
                        out[a][b] += weights[a][b]
        return out

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by sum-product messages up and down the tree."""
        potentials = [[]] + [self._potential(n) for n in nodes[1:]]
        gathered, sent = [[0.0, 0.0] for _ in nodes], [[0.0, 0.0] for _ in nodes]
        gathered[ROOT][1] = -30.0  # the page as such is not content
        for k in range(len(nodes) - 1, 0, -1):
            pair = potentials[k]
            sent[k] = [_log_sum(pair[a][0] + gathered[k][0], pair[a][1] + gathered[k][1]) for a in (0, 1)]
            above = gathered[nodes[k].parent]
            above[0] += sent[k][0]
            above[1] += sent[k][1]
        belief = [list(g) for g in gathered]
        for k in range(1, len(nodes)):
            pair, above = potentials[k], belief[nodes[k].parent]
            rest = [above[a] - sent[k][a] for a in (0, 1)]
            top = _log_sum(*above)
            belief[k] = [gathered[k][b] + _log_sum(pair[0][b] + rest[0] - top, pair[1][b] + rest[1] - top) for b in (0, 1)]
        return [1 / (1 + math.exp(max(-60.0, min(60.0, b[0] - b[1])))) for b in belief]


def _kind(node: Node) -> str:
    return "text" if node.kind == "text" else "element"


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _labelled(page: str) -> list[Node]:
    """Nodes of a labelled page: an element with the word keep is content, one with the word drop is not, others are what their parent is."""
    nodes = parse(page)
    nodes[ROOT].label = 0
    for node in nodes[1:]:
        marks = {f for f in node.features if f in ("word keep", "word drop")}
        node.label = 1 if "word keep" in marks else 0 if marks else nodes[node.parent].label
        node.features = [f for f in node.features if f not in marks]
    return nodes


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return TreeModel.counted([_labelled(page) for page in labelled_pages()])


def main_text(page: str | None, model: TreeModel | None = None) -> str:
    """Content blocks in page order, one to a line."""
    nodes = parse(page or "")
    chances = (model or trained()).marginals(nodes)
    return "\n".join(n.text[0] for n, p in zip(nodes, chances) if n.kind == "text" and p >= 0.5 and n.text[0])


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per row of pages.

    A null, empty or contentless page has an empty text. Nothing of a content block
    is cut, however long it is; repeated rows give repeated rows.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
