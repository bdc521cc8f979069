"""Operators whose rows meet by what they share: against all pairs, with hot keys, and what no longer vanishes."""

import datetime as dt
import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumframe.operators import automaton, joins, matching, similar, skew, vectors
from quorumframe.plans.census import census


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most_block", [3, 200])
def test_close_pairs_are_all_pairs(spark, most_block):
    draw = random.Random(4)
    names = ["".join(draw.choice("aeilmnorst") for _ in range(draw.randrange(10, 16))) for _ in range(120)]
    for name in list(names):
        for _ in range(draw.randrange(3)):
            changed = list(name)
            for _ in range(draw.randrange(1, 4)):
                at = draw.randrange(len(changed))
                draw.choice([lambda: changed.pop(at), lambda: changed.insert(at, draw.choice("xyz")), lambda: changed.__setitem__(at, "q")])()
            names.append("".join(changed))
    names += ["anananananan", "ananananananan", "nananananana", "short", "shorts"]
    keys = sorted({n for n in names if len(n) >= 10})
    expected = {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if edits(a, b) <= 2}
    got = similar.close_pairs(spark.createDataFrame([(n,) for n in [*names, None]], "key string"), most_block=most_block).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 50


def test_a_chain_of_spellings_is_one_person(spark):
    letters = "abcdefghijklmnopqrst"
    chain = ["".join("z" if p < 2 * k else c for p, c in enumerate(letters)) for k in range(10)]
    names = spark.createDataFrame([(n, 9 - k) for k, n in enumerate(chain)] + [("someone else entirely", 4), ("", 3), (None, 2)], "key string, n int")
    got = {r.key: r.person for r in similar.fused(names).collect()}
    assert got == dict.fromkeys(chain, chain[0]) | {"someone else entirely": "someone else entirely"}
    seen = spark.createDataFrame([(n, "g", dt.date(2020, 1, 1 + k), False) for k, n in enumerate(chain)], "name string, group string, date date, is_mayor boolean")
    assert [(r.n, str(r["first"]), str(r["last"])) for r in census(seen).collect()] == [(10, "2020-01-01", "2020-01-10")]


def test_many_labels_in_texts(spark):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(400)] + ["Ñandú", "Über", "a"]
    labels = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 4)))) for k in range(30_000)] + [(99_999, "w1 W2"), (99_998, " ,, "), (99_997, None), (99_996, "w1 w2")]
    texts = [(k, " ".join(draw.choice(words) + draw.choice(["", ",", "."]) for _ in range(200))) for k in range(20)] + [(50, None), (51, ""), (52, "w1 w2 w1 w2"), (52, "w1")]
    made, wanted = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(labels, "place int, name string")
    plain = lambda x: " ".join(re.findall("[a-z0-9]+", (x or "").lower().translate(str.maketrans("ñúü", "nuu"))))
    expected = sorted((d, k, plain(n)) for d, t in texts for k, n in labels if plain(n) and f" {plain(n)} " in f" {plain(t)} ")
    for letters in (20_000_000, 40_000):
        got = automaton.labels_in(made, "doc", "text", wanted, "place", "name", shard_letters=letters)
        assert sorted(tuple(r) for r in got.collect()) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert automaton.labels_in(made, "doc", "text", wanted.where("false"), "place", "name").count() == 0


def test_ranges_counts_and_interruptions_equal_all_pairs(spark):
    draw = random.Random(6)
    points = [("f" if draw.random() < 0.8 else None, k, draw.randrange(60)) for k in range(200)]
    ranges = [("f", a := draw.randrange(60), a + draw.randrange(-2, 12), t) for t in range(60)]
    got = matching.contained_in_range(spark.createDataFrame(points, "pdf string, point int, page int"), spark.createDataFrame(ranges, "pdf string, a int, b int, target int"), ["pdf"], "page", "a", "b", "target")
    expected = set()
    for pdf, point, page in points:
        held = [(a, t) for p, a, b, t in ranges if p == pdf and a <= page <= b]
        if held:
            best = {t for a, t in held if a == max(held)[0]}
            expected.add((pdf, point, page, best.pop() if len(best) == 1 else None))
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 100

    lists, tallies = [(draw.randrange(5), draw.randrange(4), draw.randrange(4), k) for k in range(80)], [(draw.randrange(5), draw.randrange(4), draw.randrange(4), k) for k in range(60)]
    got = matching.matching_counts(spark.createDataFrame(lists, "p int, f int, c int, l int"), spark.createDataFrame(tallies, "p int, f int, c int, t int"), "p", ["f", "c"], "l", "t")
    alike = {(p, i): {t for q, g, d, t in tallies if (q, g, d) == (p, f, c)} for p, f, c, i in lists}
    assert {tuple(r) for r in got.collect()} == {(p, i, *ts) for (p, i), ts in alike.items() if len(ts) == 1}

    numbers = [(draw.choice("ab"), at, draw.randrange(100)) for at in range(150)]
    known = [(draw.choice("ab"), k) for k in range(0, 100, 7)]
    got = matching.interrupted(spark.createDataFrame(numbers, "s string, at int, number int"), ["s"], "at", "number", spark.createDataFrame(known, "s string, number int"))
    expected = set()
    for s in "ab":
        own = [(at, n) for x, at, n in numbers if x == s]
        expected |= {(s, at, n, m) for (at, n), (_, m) in zip(own, own[1:]) if any(x == s and n < k < m for x, k in known)}
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 10


def test_matching_in_rounds_equals_the_sorted_scan(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["g", "h", None]), draw.randrange(60), draw.randrange(60), draw.randrange(30) / 30) for _ in range(4000)]
    pairs = spark.createDataFrame([(*r, "x") for r in {(g, x, y): (g, x, y, s) for g, x, y, s in rows}.values()], "group string, l int, r int, score double, other string")
    at_once = sorted(map(str, matching.matched_once(pairs, "group", "l", "r", "score").collect()))
    assert sorted(map(str, matching.matched_once(pairs, "group", "l", "r", "score", most_pairs=40).collect())) == at_once and len(at_once) > 100


def test_open_intervals_hold(spark):
    day = lambda s: dt.date.fromisoformat(s)
    terms = spark.createDataFrame([(1, day("2001-01-01"), day("2005-01-01")), (2, day("2005-01-01"), None), (3, None, day("1999-12-31")), (4, day("2003-01-01"), day("9999-12-31")), (5, day("2009-01-01"), day("2008-01-01"))], "t int, a date, b date")
    asked = spark.createDataFrame([(day(d),) for d in ("1990-05-05", "2000-06-06", "2004-07-07", "2020-08-08")] + [(None,)], "day date")
    got = {(str(r.day), r.t) for r in joins.interval_join(asked, terms, "day", "a", "b", bucket_days=30, how="left").collect()}
    assert got == {("1990-05-05", 3), ("2000-06-06", None), ("2004-07-07", 1), ("2004-07-07", 4), ("2020-08-08", 2), ("2020-08-08", 4), ("None", None)}
    counts = {str(r.day): r.n for r in joins.active_counts(asked, terms, "day", "a", "b").collect()}
    assert counts == {"1990-05-05": 1, "2004-07-07": 2, "2020-08-08": 2}
    people = spark.createDataFrame([("x", 1, day("2001-01-01"), None), ("x", 2, day("1990-01-01"), day("1995-01-01"))], "name string, person int, a date, b date")
    named = joins.named_at(spark.createDataFrame([("x", day("2010-01-01"))], "name string, day date"), people, "name", "day", "person", "a", "b")
    assert named.first().person == 1


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {(r.query_id, r.vec_id) for r in vectors.nearest(df, df.where("vec_id in (1, 3, 5)"), k=5).collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4)}
    named = vectors.assign_prototypes(df, spark.createDataFrame([("two", [1.0, 0.0]), ("three", [0.0, 1.0, 0.0])], "name string, embedding array<float>"))
    assert {r.vec_id: r.prototype for r in named.collect()} == {1: "two", 2: "two", 3: None, 4: "three", 5: None, 6: None, 7: None}


def test_labels_that_many_texts_hold(spark):
    texts = spark.range(2000).select(F.col("id").alias("doc"), F.lit("the same words in each text").alias("text"))
    labels = spark.createDataFrame([(1, "same words"), (2, "each"), (3, "words the")], "place int, name string")
    assert {(r.place, r["count"]) for r in automaton.labels_in(texts, "doc", "text", labels, "place", "name").groupBy("place").count().collect()} == {(1, 2000), (2, 2000)}


def test_rows_of_hot_keys_are_dealt_over_tasks(spark):
    draw = random.Random(4)
    rows = [(draw.choice([7, 7, 7, None, *range(40)]), k) for k in range(4000)]
    facts = [(k, f"f{k}{c}") for k in range(30) for c in "ab"]  # two facts a key, some keys without
    table = spark.createDataFrame(rows, "key int, id int")
    hot = skew.hot_keys(table, "key", most=100)
    assert {r.key for r in hot.collect()} == {7, *(k for k in (None, *range(40)) if sum(r[0] == k for r in rows) > 100)}
    got = skew.salted_join(table, spark.createDataFrame(facts, "key int, fact string"), "key", hot, ["id"])
    assert sorted((r.key, r.id, r.fact) for r in got.collect()) == sorted((k, i, f) for k, i in rows for g, f in facts if g == k)
    most = max(r["salts"] for r in hot.collect())
    assert most >= 2 and skew.hot_keys(table, "key", most=4000) is None
    assert skew.salted_join(table, spark.createDataFrame(facts, "key int, fact string"), "key", None, ["id"]).count() == got.count()


def _most_rows(plan) -> int:
    """The most rows that a node of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _most_rows(plan.finalPhysicalPlan())
    if name.endswith("QueryStage"):
        return _most_rows(plan.plan())
    metric = plan.metrics().get("numOutputRows")
    own = metric.get().value() if metric.isDefined() else 0
    children = plan.children()
    return max([own, *(_most_rows(children.apply(k)) for k in range(children.size()))])


@pytest.mark.parametrize("hint", [None, "party"])
def test_names_at_dates_meet_no_pairs(spark, hint):
    draw = random.Random(4)
    at = lambda n: dt.date(2010, 1, 1) + dt.timedelta(days=n)
    maybe = lambda value, share: None if draw.random() < share else value
    people, asked = [], []
    for _ in range(400):  # some people in several rows, whose intervals may overlap or end before they start
        start = draw.randrange(300)
        people.append(("xy"[draw.random() < 0.02], draw.randrange(300), maybe(at(start), 0.01), maybe(at(start + draw.randrange(-1, 4)), 0.01), maybe(draw.choice("abc"), 0.1)))
    people += [("z", 7, at(0), at(9), "a"), ("z", 7, at(5), at(20), "a"), ("z", 8, at(15), None, "b")]
    for name in "xyzw":
        asked += [(name, maybe(at(k), 0.05), maybe(draw.choice("abcd"), 0.2)) for k in range(-5, 310)]
    columns = ["name", "day"] + ([hint] if hint else [])
    df = joins.named_at(spark.createDataFrame(asked, "name string, day date, party string"), spark.createDataFrame(people, "name string, person int, a date, b date, party string"), "name", "day", "person", "a", "b", hint=hint)
    found = {tuple(r[c] for c in columns): r.person for r in df.collect()}
    expected = {}
    for name, day, party in asked:
        levels = {}
        for own, person, a, b, group in people:
            if own == name:
                active = day is not None and (a is None or a <= day) and (b is None or day <= b)
                levels.setdefault(active * 2 + bool(hint and party is not None and party == group), set()).add(person)
        if levels:
            best = levels[max(levels)]
            expected[(name, day, party) if hint else (name, day)] = min(best) if len(best) == 1 else None
    assert found == expected and any(v is not None for v in found.values())
    assert _most_rows(df._jdf.queryExecution().executedPlan()) <= 3 * (len(people) + len(asked))


def test_close_names_that_repeat_a_gram_far_away(spark):
    # an edit spoils the first of the grams of one letter, and those that are left are far from where the other name has as many
    names = ["aaaaaaaxeeaaaaaaaaar", "aazzaaaxeeaaaaaaaaar"]
    # so that these grams are the rarest
    names += [f"{x}{rest}{k:02d}" for k in range(12) for x, rest in (("q", "aazzaaabxeeabraarbzzaax"), ("w", "zzaxeaazxxeebaarzzaea"))]
    keys = sorted(set(names))
    expected = {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if edits(a, b) <= 2}
    for most_block in (5, 10_000):
        got = similar.close_pairs(spark.createDataFrame([(n,) for n in names], "key string"), most_block=most_block).collect()
        assert {tuple(r) for r in got} == expected


def test_chunks_leave_a_task_in_small_batches():
    from quorumframe.functions.chunks import _cutting

    batch = pa.RecordBatch.from_pydict({"k": [*range(60), None], "t": ["word " * 10_000] * 60 + [None]})
    parts = list(_cutting("k", 1200, 200, 100_000)(iter([batch])))
    assert all(sum(map(len, p["chunk"].to_pylist())) <= 101_200 for p in parts)
    assert [p["k"].to_pylist() for p in parts][0][0] == 0 and {k for p in parts for k in p["k"].to_pylist()} == set(range(60))


def test_vectors_are_compared_a_slice_at_a_time(monkeypatch):
    sizes, plain = [], vectors._matrices
    monkeypatch.setattr(vectors, "_matrices", lambda column: sizes.append(len(column)) or plain(column))
    every = [[float(k % 7), float(k % 11), 1.0] for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"vec_id": range(3000), "embedding": every})
    block = SimpleNamespace(value=([0, 5], plain([every[0], every[5]])))
    (found,) = vectors._scanning(block, 3, None)(iter([batch]))
    assert max(sizes) <= 512 and sum(sizes) == 3000
    assert found["vec_id"].to_pylist() == [0, 77, 154, 5, 82, 159]


def test_many_labels_are_no_automaton(spark, monkeypatch):
    def refused(shard):
        raise AssertionError("all labels in one worker")

    monkeypatch.setattr(automaton, "_finding", refused)
    texts = spark.createDataFrame([(k, f"Calle {k} de la Villa, número {k + 1}") for k in range(300)] + [(300, None), (301, "de la")], "doc int, text string")
    labels = spark.createDataFrame([(k, f"calle {k} de") for k in range(300)] + [(500, "Villa numero"), (501, "calle villa"), (502, "la"), (503, "")], "place int, name string")
    found = automaton.labels_in(texts, "doc", "text", labels, "place", "name", shard_letters=100).collect()
    assert {(r.doc, r.place) for r in found if r.place < 500} == {(k, k) for k in range(300)}
    assert {r.place for r in found} == {*range(300), 500, 502} and len(found) == 901


def test_matching_goes_through_groups_as_they_pass_by(spark):
    import pyarrow as pa

    rows = [(None, 1, 1), (None, 1, 2), (None, 2, 2), (1, 1, 1), (1, 2, 1), (1, 2, 3), (2, 1, 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("glr", row)) for row in rows[k : k + 2]], pa.schema([(c, pa.int64()) for c in "glr"])) for k in range(0, len(rows), 2)]
    kept = [tuple(r.values()) for b in matching._first_uses(iter(batches)) for r in b.to_pylist()]
    assert kept == [(None, 1, 1), (None, 2, 2), (1, 1, 1), (1, 2, 3), (2, 1, 1)]
    pairs = spark.createDataFrame([(k % 7, k % 11, k % 13, (k % 17) / 17) for k in range(500)], "g int, l int, r int, s double")
    assert "FlatMapGroups" not in matching.matched_once(pairs, "g", "l", "r", "s")._jdf.queryExecution().executedPlan().toString()
