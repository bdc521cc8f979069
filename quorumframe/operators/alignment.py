"""Monotone alignment of two ordered lists of a document, such as its agenda and the headings of its body.

Entries are alike as far as they share words. Of all ways to pair entries without crossing
the one with the largest total likeness is taken, by dynamic programming over a band
around the diagonal. An entry without a partner is placed between those of its
neighbours: this is how a point is recovered whose heading was lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_pairs(left: list[set], right: list[set], least: float, band: int | None) -> list[tuple[int, int, float]]:
    """Pairs (place in left, place in right, likeness) of the best alignment; of equal ones that whose right entries come first."""
    n, m = len(left), len(right)
    total, taken = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), bool)
    weights: dict[tuple[int, int], float] = {}
    for i in range(n):
        middle = round(i * m / max(n, 1))
        low, high = (0, m) if band is None else (max(0, middle - band), min(m, middle + band + 1))
        row = np.zeros(m)
        for j in range(low, high):
            common = len(left[i] & right[j])
            like = common / len(left[i] | right[j]) if common else 0.0
            if like >= least:
                row[j] = weights[i, j] = like
        paired = np.where(row > 0, total[i, :-1] + row, 0.0)
        best = np.maximum(total[i, 1:], paired)
        total[i + 1, 1:] = np.maximum.accumulate(best)
        taken[i + 1, 1:] = (row > 0) & (paired >= total[i + 1, 1:]) & (paired > total[i, 1:])
    pairs, i, j = [], n, m
    while i and j:
        if total[i, j - 1] == total[i, j]:
            j -= 1
        elif taken[i, j]:
            pairs.append((i - 1, j - 1, weights[i - 1, j - 1]))
            i, j = i - 1, j - 1
        else:
            i -= 1
    return pairs[::-1]


def aligned(left: DataFrame, right: DataFrame, doc: str, *, least: float = 0.34, band: int | None = None) -> DataFrame:
    """doc, at, other, score, after, before for each entry of left: its partner in right and their likeness (Jaccard of their words).

    Both have doc, at (its place, unique in the document) and words (an array). Where an
    entry has no partner, other and score are null, and after and before are the places in
    right of its nearest neighbours' partners, null at either end. band is how far, in
    entries of right, a partner may be from where the entry stands by proportion; without
    one all are tried. A document is one task's: an agenda has tens of points. Null words
    are none, entries without words have no partner.
    """
    schema = left.select(doc, F.col("at").cast("long").alias("at")).schema.add("other", "long").add("score", "double").add("after", "long").add("before", "long")

    def align(own: pa.Table, others: pa.Table) -> pa.Table:
        own, others = own.sort_by("at"), others.sort_by("at")
        sets = [[set(w or ()) for w in t["words"].to_pylist()] for t in (own, others)]
        places = others["at"].to_pylist()
        pairs = {i: (places[j], like) for i, j, like in best_pairs(*sets, least, band)}
        other = [pairs.get(k, (None, None)) for k in range(len(own))]
        after, before, last = [], [], None
        for k in range(len(own)):
            after.append(None if k in pairs else last)
            last = pairs[k][0] if k in pairs else last
        last = None
        for k in reversed(range(len(own))):
            before.append(None if k in pairs else last)
            last = pairs[k][0] if k in pairs else last
        columns = [own[doc], own["at"], pa.array([o for o, _ in other], pa.int64()), pa.array([s for _, s in other], pa.float64()), pa.array(after, pa.int64()), pa.array(before[::-1], pa.int64())]
        return pa.Table.from_arrays(columns, names=[f.name for f in schema])

    # columns of their own on either side, as both may come from one table
    shown = [t.select(F.col(doc).alias(doc), F.col("at").cast("long").alias("at"), F.col("words").alias("words")).groupBy(doc) for t in (left, right)]
    return shown[0].cogroup(shown[1]).applyInArrow(align, schema)
