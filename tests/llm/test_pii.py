import hashlib
import random
import re

from quorumframe.llm.pii import LABELS, Field, Node, _softmax, base_spans, links_of, luhn, masked, nodes_of, personal_data

# Plain patterns, as the contract words them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(s):
    return re.sub(r"[^0-9]", "", s)


def brute(text):
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(_digits(s)) <= 19 and luhn(_digits(s)),
        "phone": lambda s: 10 <= len(_digits(s)) <= 15,
    }
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep[k](m[0])]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_plain_patterns():
    draw = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "12", "4041894974608795", "255", "256", "1.2.3.4", "x@y.zz", "é", "\n", "0", "+1 (212) 555-0147", "_", "%"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randrange(1, 16)))
        assert base_spans(text) == brute(text), repr(text)


def test_long_runs_take_no_longer_than_their_length():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "+1" * 100_000, "1." * 150_000, "@" * 200_000):
        nodes_of(text)


def test_repeated_tokens_take_the_label_of_their_full_form(spark):
    text = "Call +1 (212) 555-0147 or mail jane.roe@mail.example.com. " + "word " * 200 + "Ask jane.roe, or call (212) 555-0147. Not 1234567 nor 300.1.1.1."
    clean = "Version 2.0, chapter 1234567, not a phone: 9876543."
    rows = [(1, text), (2, clean), (3, None), (4, ""), (1, text), (None, "a@b.cc"), (5, "x " * 200_000 + "10.0.0.7")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = [r.asDict() for r in personal_data(docs).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    spans = {(text[int(s):int(e)], k) for k, s, e in (x.split(":") for x in by[1]["spans"].split(","))}
    assert {("+1 (212) 555-0147", "phone"), ("jane.roe@mail.example.com", "email"), ("jane.roe", "email")} <= spans
    assert any(k == "phone" and "555-0147" in t and "+" not in t for t, k in spans)
    assert not any("1234567" in t or "300.1" in t for t, _ in spans)
    assert by[2]["spans"] == by[3]["spans"] == by[4]["spans"] == ""
    assert by[None]["n_email"] == 1 and by[5]["spans"] == "ip:400000:400008"
    base = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(text))
    assert by[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and (by[1]["n_email"], by[1]["n_phone"]) == (1, 1)
    assert personal_data(docs.where("false")).count() == 0
    out = {r.doc_id: r for r in masked(docs).collect()}
    assert "jane" not in out[1].text and "555-0147" not in out[1].text and "1234567" in out[1].text and out[1].spans == "k"
    assert out[2].text == clean and out[3].text is None


def _enumerated(nodes, field):
    import itertools

    import numpy as np

    chain, skip = links_of(nodes, field.near)
    exact = np.zeros((len(nodes), len(LABELS)))
    for labels in itertools.product(range(len(LABELS)), repeat=len(nodes)):
        score = sum(field.bias[label] + sum(field.unary[f][label] for f in nodes[k].features) for k, label in enumerate(labels))
        score += sum(field.chain[labels[a]][labels[b]] for a, b in chain) + sum(field.skip[labels[a]][labels[b]] for a, b in skip)
        for k, label in enumerate(labels):
            exact[k, label] += np.exp(score)
    return exact / exact.sum(axis=1, keepdims=True)


def _drawn_field(seed=3):
    import numpy as np

    draw = np.random.default_rng(seed)
    symmetric = lambda: (lambda m: ((m + m.T) / 2).tolist())(draw.uniform(-1, 1, (5, 5)))
    return Field({f"f{k}": draw.uniform(-2, 2, 5).tolist() for k in range(4)}, draw.uniform(-1, 1, 5).tolist(), symmetric(), symmetric(), 40)


def test_messages_give_exact_marginals_on_a_tree():
    import numpy as np

    nodes = [Node(10 * k, 10 * k + 5, 0, (f"f{k}",), ("n 1",) if k in (0, 3) else (f"k{k}",)) for k in range(4)]
    nodes[3] = Node(900, 905, 0, ("f3",), ("n 1",))  # far off: linked by its key alone, so the field is a tree
    field = _drawn_field()
    assert np.allclose(field.marginals([nodes])[0], _enumerated(nodes, field), atol=5e-3)


def test_a_document_settles_by_itself():
    import numpy as np

    field = _drawn_field()
    field.skip = (np.array(field.skip) * 6).tolist()  # slow to settle
    slow = [Node(10 * k, 10 * k + 5, 0, (f"f{k % 4}",), (f"n {k % 2}",)) for k in range(12)]
    quick = [Node(10 * k, 10 * k + 5, 0, (f"f{k}",), (f"k{k}",)) for k in range(3)]
    alone = [field.marginals([d])[0] for d in (quick, slow, quick)]
    assert all((a == b).all() for a, b in zip(alone, field.marginals([quick, slow, quick])))


def test_shapes_speak_where_no_rule_accepts_them(spark):
    """Numbers that always stand with their country code teach the shape of one that stands without; other numbers stay clean."""
    draw = random.Random(4)
    number = lambda: f"({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"
    rows = [(k, f"Please call +1 {number()} today or write. Order {draw.randrange(10**7, 10**8)} was sent.") for k in range(200)]
    alone = number()
    rows += [(900, f"Please call {alone} today."), (901, "Order 12345678 was sent, and order 87654321 was not.")]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = len("Please call ")
    assert got[900] == f"phone:{start + 1}:{start + len(alone)}" or got[900] == f"phone:{start}:{start + len(alone)}"
    assert got[901] == "" and all("," not in got[k] and got[k].startswith("phone:12:") for k in range(200))


def test_pseudo_likelihood_prefers_what_it_saw(spark):
    import numpy as np

    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    y, n = np.array([0, 1, 1]), np.array([50.0, 30.0, 20.0])
    weights = _softmax(x, y, n, np.zeros((2, 2)), ridge=0.01)
    p = np.exp(x @ weights) / np.exp(x @ weights).sum(axis=1, keepdims=True)
    slope = x.T @ ((p - np.eye(2)[y]) * n[:, None]) + 0.01 * weights
    assert np.abs(slope).max() < 0.3 and (p[[0, 1, 2], y] > 0.9).all()
    assert (_softmax(np.zeros((0, 3)), np.zeros(0, int), np.zeros(0), np.ones((3, 2))) == 1).all()


def test_sparse_rows_are_the_dense_matrix():
    import numpy as np

    from quorumframe.llm.pii import Sparse

    draw = np.random.default_rng(3)
    ones = [sorted(draw.choice(6, draw.integers(0, 4), replace=False).tolist()) for _ in range(9)]
    rest, weights, slopes = draw.normal(size=(9, 3)), draw.normal(size=(9, 2)), draw.normal(size=(9, 2))
    dense = np.concatenate([[[float(k in o) for k in range(6)] for o in ones], rest], axis=1)
    own = Sparse(ones, 6, rest)
    assert np.allclose(own @ weights, dense @ weights) and np.allclose(own.T @ slopes, dense.T @ slopes)
    assert (Sparse([], 2, np.zeros((0, 3))) @ np.ones((5, 2))).shape == (0, 2)
