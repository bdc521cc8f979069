"""Personal data by a skip-chain conditional random field over suspicious tokens.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Every
match is a node of the document's field, and so is every other token that could
be one: groups of seven digits or more, tokens with an at sign, and words that
are the local part of an address found elsewhere in the document. Neighbours in
the text are linked in a chain. Tokens that repeat or resemble one another (the
same digits at the end, the same address or local part) are linked however far
apart they stand, each with its next occurrence. Loopy sum-product message
passing over both kinds of links gives each node's marginals, so a phone number
written without its prefix takes the label of its full form.

The potentials are fitted by pseudo-likelihood: each node's label given its features
and the labels of its neighbours, over a bounded sample of nodes. The base rules' labels
are the truth there, with the marks that decide them hidden: a phone number counts
without its plus sign and country code, an address by its local part. So a shape or the
word before it can speak for a label where no rule accepts it. Nodes without a match
that are linked to one are unknown and take no part. With little to learn from, weights
stay near their priors: links favour equal labels, and most tokens are nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise

#: The kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits of a run are taken at once and only from its first one on; a start inside a run fails as that at its start did.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][0-9().\x20-]*[0-9]")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_AT_WORD = re.compile(r"[^\s,;:<>()\[\]\"']*@[^\s,;:<>()\[\]\"']*")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules' matches, by start, then kind as listed."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    base: int  # the label that the base rules give, 0 if none
    features: tuple[str, ...]
    keys: tuple[str, ...]


_COUNTRY = re.compile(r"\+(?:[0-9]{1,3}(?=[\x20(.-]))?[\x20.-]*")
_DIGITS = re.compile(r"[0-9]+")
_BEFORE = re.compile(r"([A-Za-z]{2,15})[^A-Za-z0-9]{0,3}\Z")


def _described(token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Features of a token's shape without the marks that decide a label, and the keys that link it with tokens that repeat or resemble it."""
    if "@" in token:
        local = token.partition("@")[0].lower()
        return _word_shape(local), (f"w {token.lower()}", *([f"l {local}"] if len(local) >= 4 else []))
    digits = _NO_DIGIT.sub("", token)
    parts = token.split(".")
    dotted = len(parts) == 4 and all(p.isdigit() for p in parts)
    if len(digits) >= 7 or dotted:
        hidden = _COUNTRY.sub("", token)
        groups = _DIGITS.findall(hidden)
        shape = (f"digits {min(20, sum(map(len, groups)))}", "groups " + "-".join(str(min(9, len(g))) for g in groups[:6]), f"dotted {dotted}", f"bracket {'(' in hidden}")
        return shape, (f"n {digits if dotted or len(digits) > 13 else digits[-7:]}",)
    return _word_shape(token), (f"l {token.lower()}",)


def _word_shape(word: str) -> tuple[str, ...]:
    return "word", f"dots {min(3, word.count('.'))}", f"mixed {bool(_DIGIT.search(word))}"


def _before(text: str, start: int) -> tuple[str, ...]:
    """The word that stands right before."""
    found = _BEFORE.search(text, max(0, start - 20), start)
    return (f"before {found[1].lower()}",) if found else ()


def _node(text: str, start: int, end: int, base: int) -> Node:
    shape, keys = _described(text[start:end])
    return Node(start, end, base, shape + _before(text, start), keys)


def nodes_of(text: str) -> list[Node]:
    """The field's nodes in text order; none for most documents."""
    base = base_spans(text)
    taken, upto = [], 0
    for start, end, _ in base:
        if start >= upto:
            taken.append((start, end))
        elif end > upto:
            taken[-1] = (taken[-1][0], end)
        upto = max(upto, end)
    out = [_node(text, s, e, LABELS.index(kind)) for s, e, kind in base]
    locals_ = {k[2:] for n in out for k in n.keys if k[0] == "l"}

    def others(at: int, to: int) -> Iterator[tuple[int, int]]:
        if "@" in text[at:to]:
            yield from ((m.start(), m.end()) for m in _at_words(text, at, to))
        yield from ((m.start(), m.end()) for m in _NUMBER.finditer(text, at, to) if len(_NO_DIGIT.sub("", m[0])) >= 7)
        if locals_:
            yield from ((m.start(), m.end()) for m in _WORD.finditer(text, at, to) if m[0].lower() in locals_)

    if base or "@" in text or _DIGIT.search(text):
        at = 0
        for start, end in [*taken, (len(text), len(text))]:
            free = at
            for s, e in sorted(others(at, start)):
                if s >= free:
                    out.append(_node(text, s, e, 0))
                    free = e
            at = end
    return sorted(out, key=lambda n: (n.start, n.base))


def _at_words(text: str, at: int, to: int):
    """Tokens with an at sign, each looked for from the last blank before it."""
    free, sign = at, text.find("@", at, to)
    while sign >= 0:
        start = max(free, *(text.rfind(c, free, sign) + 1 for c in " \n\t,;:<>()[]\"'"))
        m = _AT_WORD.match(text, start, to)
        if m and m.end() - m.start() >= 3:
            yield m
        free = m.end() if m else sign + 1
        sign = text.find("@", max(free, sign + 1), to)


def links_of(nodes: list[Node], near: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links between neighbours, and between a token and the next that repeats or resembles it."""
    chain, skip, last = [], [], {}
    for k, node in enumerate(nodes):
        if k and node.start - nodes[k - 1].end <= near:
            chain.append((k - 1, k))
        for key in node.keys:
            if key in last:
                skip.append((last[key], k))
            last[key] = k
    return chain, list(dict.fromkeys(skip))


@dataclass
class Field:
    """unary: feature -> log-potential of each label. bias: of each label. chain, skip: of the labels that a link joins, symmetric."""

    unary: dict[str, list[float]]
    bias: list[float]
    chain: list[list[float]]
    skip: list[list[float]]
    near: int

    def marginals(self, documents: list[list[Node]], rounds: int = 30) -> list[np.ndarray]:
        """P(label) of the nodes of each document, by loopy sum-product; each document settles by itself."""
        flat = [n for nodes in documents for n in nodes]
        if not flat:
            return [np.zeros((0, len(LABELS))) for _ in documents]
        none = [0.0] * len(LABELS)
        own = np.array([np.sum([self.bias, *(self.unary.get(f, none) for f in node.features)], axis=0) for node in flat])
        own[np.arange(len(flat)), [n.base for n in flat]] += [20.0 if n.base else 0.0 for n in flat]
        ends, pairs, first = [], [], 0
        for nodes in documents:
            for kind, links in zip((self.chain, self.skip), links_of(nodes, self.near)):
                ends += [(first + a, first + b) for a, b in links]
                pairs += [kind] * len(links)
            first += len(nodes)
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        if ends:
            own = _sum_product(own, np.array(ends, np.int64), np.array(pairs), owner, rounds)
        belief = np.exp(own - own.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
        return np.split(belief, np.cumsum([len(d) for d in documents])[:-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _sum_product(own: np.ndarray, ends: np.ndarray, pairs: np.ndarray, owner: np.ndarray, rounds: int) -> np.ndarray:
    """Log-beliefs after damped rounds of messages both ways along the links; the messages of an owner that has settled stay as they are."""
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    both = np.concatenate([pairs, pairs.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    sent, whose = np.zeros((len(source), own.shape[1])), owner[source]
    belief, live = own, np.ones(len(source), bool)
    for _ in range(rounds):
        out = _log_sum((belief[source[live]] - sent[back[live]])[:, :, None] + both[live], axis=1)
        out -= out.max(axis=1, keepdims=True)
        moved = np.zeros(owner[-1] + 1)
        np.maximum.at(moved, whose[live], np.abs(out - sent[live]).max(axis=1))
        settled = moved <= 1e-4
        sent[live] = np.where(settled[whose[live]][:, None], out, (sent[live] + out) / 2)
        belief = own.copy()
        np.add.at(belief, target, sent)
        live &= ~settled[whose]
        if not live.any():
            break
    return belief


_NODE = "struct<start:int,end:int,base:int,features:array<string>,keys:array<string>>"
_NODE_ARROW = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.int32()), ("features", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))])


def _finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [[vars(n) for n in nodes_of(t or "")] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(nodes, pa.list_(_NODE_ARROW))], ["doc_id", "nodes"])


def found_nodes(docs: DataFrame) -> DataFrame:
    """doc_id and the nodes of each document's field, one row per row of docs."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finding, f"doc_id long, nodes array<{_NODE}>")


_TRAINING = "place long, features array<string>, label int, chain array<int>, skip array<int>"


def known_labels(nodes: list[Node]) -> list[int | None]:
    """The labels that can be learned from: those of the base rules; none where nothing links a node to a match; unknown otherwise."""
    matched = {key for n in nodes if n.base for key in n.keys}
    return [n.base if n.base else None if matched.intersection(n.keys) else 0 for n in nodes]


def _examples(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["nodes"].to_pylist()):
                nodes = _nodes(raw)
                known, beside = known_labels(nodes), [np.zeros((2, len(LABELS)), int) for _ in nodes]
                for kind, links in enumerate(links_of(nodes, near)):
                    for a, b in links:
                        for one, other in ((a, b), (b, a)):
                            if known[other] is not None:
                                beside[one][kind, known[other]] += 1
                rows += [(zlib.crc32(f"{doc_id} {n.start}".encode()), n.features, label, *map(np.ndarray.tolist, by)) for n, label, by in zip(nodes, known, beside) if label is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["place", "features", "label", "chain", "skip"])

    return run


def _nodes(raw: list[dict]) -> list[Node]:
    return [Node(n["start"], n["end"], n["base"], tuple(n["features"]), tuple(n["keys"])) for n in raw]


class Sparse:
    """A matrix of rows that have ones in a few of their first columns (width of them) and any numbers in those after."""

    def __init__(self, ones: list[list[int]], width: int, rest: np.ndarray, transposed: bool = False) -> None:
        self.ones, self.width, self.rest, self.transposed = ones, width, rest, transposed
        self.row = np.repeat(np.arange(len(ones)), [len(o) for o in ones])
        self.at = np.array([k for o in ones for k in o], np.int64)

    def __len__(self) -> int:
        return len(self.rest)

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.ones, self.width, self.rest, not self.transposed)

    def __matmul__(self, other: np.ndarray) -> np.ndarray:
        into, from_, size = (self.at, self.row, self.width) if self.transposed else (self.row, self.at, len(self.rest))
        sums = np.stack([np.bincount(into, other[from_, k], size) for k in range(other.shape[1])], axis=1)
        return np.concatenate([sums, self.rest.T @ other]) if self.transposed else sums + self.rest @ other[self.width :]


def fitted_field(found: DataFrame, *, sample_nodes: int = 30_000, least_nodes: int = 3, near: int = 40, seldom: float = 2.0, agree: float = 6.0) -> Field:
    """The field fitted by pseudo-likelihood on at most sample_nodes nodes, drawn by hash.

    seldom and agree are the priors: how much less likely each kind is than none, and how
    much likelier equal labels are on a skip link. Features that fewer than least_nodes
    nodes have are not learned; all others of these nodes are.
    """
    rows = found.where(F.size("nodes") > 0).mapInArrow(_examples(near), _TRAINING).orderBy("place", F.xxhash64("features", "label")).limit(sample_nodes).collect()
    seen = Counter((tuple(r["features"]), r["label"], tuple(r["chain"]), tuple(r["skip"])) for r in rows)
    often = Counter(f for r in rows for f in r["features"])
    names = [f for f, n in sorted(often.items(), key=lambda i: (-i[1], i[0])) if n >= least_nodes]
    size, at = len(LABELS), {f: k for k, f in enumerate(names)}
    kinds = sorted(seen.items())
    x = Sparse([[at[f] for f in features if f in at] for (features, *_), _ in kinds], len(names), np.array([(1, *chain, *skip) for (_, _, chain, skip), _ in kinds]).reshape(len(kinds), 1 + 2 * size))
    y, n = np.array([label for (_, label, *_), _ in kinds], np.int64), np.array([count for _, count in kinds], float)
    prior = np.zeros((len(names) + 1 + 2 * size, size))
    prior[len(names), 1:] = -seldom
    prior[len(names) + 1 + size :] = agree * np.eye(size)
    weights = _softmax(x, y, n, prior)
    links = weights[len(names) + 1 :].reshape(2, size, size)
    chain, skip = ((m + m.T) / 2 for m in links)
    return Field({f: weights[k].tolist() for f, k in at.items()}, weights[len(names)].tolist(), chain.tolist(), skip.tolist(), near)


def _softmax(x: np.ndarray | Sparse, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 400, pace: float = 0.1) -> np.ndarray:
    """Weights of a softmax model near their prior, by steps of adaptive length."""
    weights, mean, spread = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
    if not len(x):
        return weights
    truth, turned = np.eye(prior.shape[1])[y], x.T
    for k in range(1, rounds + 1):
        logits = x @ weights
        p = np.exp(logits - _log_sum(logits, 1)[:, None])
        slope = turned @ ((p - truth) * n[:, None]) + ridge * (weights - prior)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        weights -= pace * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-8)
    return weights


def _spans(nodes: list[Node], belief: np.ndarray) -> list[tuple[int, int, str]]:
    """Base matches, and other nodes that are more likely personal data than not."""
    picked = {(n.start, n.end, LABELS[n.base]) for n in nodes if n.base}
    picked |= {(n.start, n.end, LABELS[int(b[1:].argmax()) + 1]) for n, b in zip(nodes, belief) if not n.base and b[0] < 0.5}
    return sorted(picked, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _labelling(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = [_nodes(nodes) for nodes in batch["nodes"].to_pylist()]
            counts, sums, spans = [], [], []
            for nodes, belief in zip(documents, field.value.marginals(documents)):
                base = [(n.start, n.end, LABELS[n.base]) for n in nodes if n.base]
                counts.append([sum(n.base == k for n in nodes) for k in range(1, len(LABELS))])
                sums.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(_spans(nodes, belief)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of each document.

    One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256
    (of the base rules' spans) and spans (all, those that the field adds included).
    A null or empty text has none. Repeated rows give repeated rows, and a null
    doc_id keeps its row. Only doc_id and text are read; an empty table gives no rows.
    """
    found = materialise(found_nodes(docs), "pii-nodes")
    field = docs.sparkSession.sparkContext.broadcast(fitted_field(found))  # features of sample_nodes nodes at most
    return found.mapInArrow(_labelling(field), _RESULT)


def _masking(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            documents = [nodes_of(t or "") for t in texts]
            for k, (nodes, belief) in enumerate(zip(documents, field.value.marginals(documents))):
                if spans := _spans(nodes, belief):
                    pieces, upto = [], 0
                    for start, end, kind in spans:
                        if start >= upto:
                            pieces += [texts[k][upto:start], f"[{kind}]"]
                        upto = max(upto, end)
                    texts[k] = "".join([*pieces, texts[k][upto:]])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; all columns stay as they are but text."""
    field = docs.sparkSession.sparkContext.broadcast(fitted_field(materialise(found_nodes(docs), "pii-nodes")))
    return docs.mapInArrow(_masking(field), docs.schema)
