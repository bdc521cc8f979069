"""Changes of a closure against the closure made again."""

import random

import pytest

from quorumframe.operators.closure import closure_change, transitive_closure


def reach(links):
    above = {}
    for c, p in links:
        above.setdefault(c, set()).add(p)
    out = set()
    for c in above:
        seen, todo = set(), [c]
        while todo:
            for p in above.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out |= {(c, p) for p in seen if p != c}
    return out


@pytest.mark.parametrize(("seed", "cycles"), [(1, False), (2, False), (3, True)])
def test_changes_equal_a_rebuild(spark, seed, cycles):
    draw = random.Random(seed)
    link = lambda: (a := draw.randrange(30), draw.randrange(30) if cycles else draw.randrange(a) if a else 0)
    links = {x for x in (link() for _ in range(34)) if x[0] != x[1]}
    added = {x for x in (link() for _ in range(6)) if x[0] != x[1]}
    removed = set(draw.sample(sorted(links), 5)) | {(98, 99)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "child int, parent int")
    new, gone = closure_change(transitive_closure(frame(links)), frame(links), added=frame(added), removed=frame(removed))
    before, after = reach(links), reach(links - (removed - added) | added)
    assert {tuple(r) for r in new.collect()} == after - before and {tuple(r) for r in gone.collect()} == before - after


def test_nothing_changes_without_a_change(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (None, 4)], "child int, parent int")
    closure = transitive_closure(links)
    for change in ({}, {"removed": links.where("child = 1 and parent = 3")}, {"added": links.where("child = 1")}, {"added": links, "removed": links}):
        new, gone = closure_change(closure, links, **change)
        assert new.count() == gone.count() == 0


@pytest.mark.parametrize("most_above", [1_000_000, 3])
@pytest.mark.parametrize(("seed", "cycles"), [(4, False), (5, True), (6, True)])
def test_changes_without_a_closure_equal_a_rebuild(spark, seed, cycles, most_above):
    draw = random.Random(seed)
    link = lambda: (a := draw.randrange(40), draw.randrange(40) if cycles else draw.randrange(a) if a else 0)
    links = {x for x in (link() for _ in range(50)) if x[0] != x[1]} | {(k, k + 1) for k in range(100, 120)}
    added = {x for x in (link() for _ in range(6)) if x[0] != x[1]} | {(120, 105)} | set(draw.sample(sorted(links), 2))
    removed = set(draw.sample(sorted(links), 7)) | {(98, 99), (110, 111)}
    frame = lambda rows: spark.createDataFrame([*sorted(rows), (None, 1), (2, None), (3, 3)], "child int, parent int")
    new, gone = closure_change(None, frame(links), added=frame(added), removed=frame(removed), most_above=most_above)
    before, after = reach(links), reach(links - (removed - added) | added)
    new, gone = [tuple(r) for r in new.collect()], [tuple(r) for r in gone.collect()]
    assert set(new) == after - before and set(gone) == before - after and len(new) + len(gone) == len({*new, *gone})


def test_unchanged_links_have_no_changes_without_a_closure(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (None, 4)], "child int, parent int")
    for change in ({}, {"removed": links.limit(0)}, {"added": links.where("child = 1")}, {"added": links, "removed": links}):
        new, gone = closure_change(None, links, **change)
        assert new.count() == gone.count() == 0
    assert closure_change(None, links.limit(0))[0].columns == ["child", "parent"]
