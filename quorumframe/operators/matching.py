"""Matching of texts, labels, keys and counts between tables, without comparing all with all.

Labels meet texts in an automaton, rows meet over equal keys whose facts are added up
before they meet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.text import stem
from quorumframe.operators.automaton import folded_words, labels_in
from quorumframe.operators.ordered import over_order
from quorumframe.storage import materialise


def contained_labels(texts: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, *, shard_letters: int = 1_000_000) -> DataFrame:
    """key, label_key, label of each label whose words stand in the text in order, as whole words; see automaton.labels_in. Keys of texts are unique."""
    return labels_in(texts, key, text, labels, label_key, label, shard_letters=shard_letters)


def places_in(texts: DataFrame, key: str, text: str, places: DataFrame, *, capitals: Sequence[str] = ()) -> DataFrame:
    """key and place_id of the places (place_id, name) that a text names.

    Names in capitals (folded) are common words as well: they count only where the text
    writes them with a capital that does not open a sentence.
    """
    held = contained_labels(texts, key, text, places, "place_id", "name")
    if capitals:
        shown = held.join(texts.select(key, F.col(text).alias("_text")), key).join(places.select("place_id", F.col("name").alias("_name")), "place_id")
        written = F.regexp_like("_text", F.concat(F.lit(r"(?<=[\p{L}\p{N},;:)] )\Q"), F.col("_name"), F.lit(r"\E(?![\p{L}\p{N}])")))
        held = shown.where(~F.col("label").isin(*capitals) | written)
    return held.select(key, "place_id").distinct()


def best_label(texts: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, *, least: int = 5) -> DataFrame:
    """The label equal to the text, else the longest of at least so many letters that it holds; of equal ones the smallest key."""
    held = contained_labels(texts, key, text, labels, label_key, label)
    whole = texts.select(key, F.array_join(folded_words(text), " ").alias("_whole"))
    judged = held.join(whole, key).where((F.col("label") == F.col("_whole")) | (F.length("label") >= least))
    return judged.groupBy(key).agg(F.max_by(F.struct(label_key, "label"), F.struct(F.length("label"), -F.col(label_key))).alias("_best")).select(key, f"_best.{label_key}", "_best.label")


def subject_hits(fields: DataFrame, alternatives: Sequence[Sequence[str]]) -> DataFrame:
    """point_id, relation: points one of whose fields holds all stems of an alternative; treats if a field about it does, else mentions.

    fields has point_id, text and is_about. No alternatives give no rows.
    """
    said = F.transform(folded_words("text"), stem)
    wanted = [F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.col("_stems"), w)) for words in alternatives if words]
    if not wanted:
        return fields.select("point_id", F.lit("").alias("relation")).limit(0)
    held = wanted[0]
    for more in wanted[1:]:
        held = held | more
    hits = fields.select("point_id", "is_about", said.alias("_stems")).where(held)
    return hits.groupBy("point_id").agg(F.when(F.bool_or("is_about"), "treats").otherwise("mentions").alias("relation"))


def contained_in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, last: str, target: str) -> DataFrame:
    """points with the target of the range of their keys that holds at; of several the one that starts last; null if two do.

    Places are whole numbers, such as pages. What each place of a range means is settled
    before points are met, so a point meets one row, however many ranges hold it. Points
    that no range holds go; points that are alike are one.
    """
    each = ranges.where(F.col(first) <= F.col(last)).select(*keys, F.col(first).alias("_first"), F.col(target).alias("_target"), F.explode(F.sequence(first, last)).alias(at))
    by_start = each.groupBy(*keys, at, "_first").agg(F.min("_target").alias("_one"), F.max("_target").alias("_other"))
    latest = by_start.groupBy(*keys, at).agg(F.max_by(F.struct("_one", "_other"), "_first").alias("_best"))
    met = points.distinct().join(latest, [*keys, at])
    return met.select(*points.columns, F.when(F.col("_best._one") == F.col("_best._other"), F.col("_best._one")).alias(target))


def matching_counts(lists: DataFrame, tallies: DataFrame, key: str, counts: Sequence[str], list_id: str, tally_id: str) -> DataFrame:
    """list_id and tally_id that agree in all counts within their key, where exactly one tally does.

    Tallies of the same counts are one row before lists meet them.
    """
    alike = tallies.groupBy(key, *counts).agg(F.min(tally_id).alias("_one"), F.max(tally_id).alias("_other"))
    met = lists.join(alike, [key, *counts]).groupBy(key, list_id).agg(F.min("_one").alias("_one"), F.max("_other").alias("_other"))
    return met.where(F.col("_one") == F.col("_other")).select(key, list_id, F.col("_one").alias(tally_id))


def unified_keys(keys: DataFrame, key: str, *, least: int = 5, common: Sequence[str] = ()) -> DataFrame:
    """key and unified: keys with the same first word are one, named by the shortest; short and common first words stay apart."""
    head = F.substring_index(key, " ", 1)
    shared = (F.length("_head") >= least) & ~F.col("_head").isin(*common) if common else F.length("_head") >= least
    headed = keys.select(key).distinct().withColumn("_head", head)
    least_of = headed.groupBy("_head").agg(F.min_by(key, F.struct(F.length(key), F.col(key))).alias("_named"))
    return headed.join(least_of, "_head").select(key, F.when(shared, F.col("_named")).otherwise(F.col(key)).alias("unified"))


def redirected(df: DataFrame, column: str, aliases: DataFrame, old: str, new: str) -> DataFrame:
    """df with the new key wherever an alias names the old one."""
    to = aliases.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(to, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def interrupted(numbers: DataFrame, partition: Sequence[str], at: str, number: str, known: DataFrame) -> DataFrame:
    """Rows between whose number and the next (by at) a known number of the same partition is missing.

    Rows and known numbers are one order from the largest down, in which the last known
    number before a row is the next above it; no row meets more than that one.
    """
    following = over_order(numbers.select(*partition, at, number), partition, [F.col(at).desc()], previous={"next": F.col(number)})
    spans = following.where(F.col("next") > F.col(number) + 1).withColumn("_known", F.lit(None).cast(known.schema[number].dataType))
    there = known.select(*partition, number, F.col(number).alias("_known"))
    both = spans.withColumn("_side", F.lit(0)).unionByName(there.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    met = over_order(both, partition, [F.col(number).desc(), "_side"], last={"_above": F.col("_known")})
    return met.where((F.col("_side") == 0) & (F.col("_above") < F.col("next"))).select(*partition, at, number, "next").distinct()


def rescued(df: DataFrame, scores: Sequence[str], most: int, key: str) -> DataFrame:
    """The first rows by each of several scores, each row once, with the best of its places."""
    parts = None
    for score in scores:
        top = df.orderBy(F.desc(score), key).limit(most)
        placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, "place")  # most rows
        parts = placed if parts is None else parts.unionByName(placed)
    return parts.groupBy(key).agg(F.min("place").alias("place"))


def _sharing(bank, k: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, postings = bank.value
        none = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for row, own in enumerate(batch["words"].to_pylist()):
                met = [postings[w] for w in own or () if w in postings]
                common = np.bincount(np.concatenate(met) if met else none, minlength=len(names))
                at = np.flatnonzero(common >= least)
                if k is not None and len(at) > k:
                    score = np.floor(common[at] / (len(own) + sizes[at] - common[at]) * 1e6 + 0.5)
                    at = at[np.lexsort((names[at], -score))[:k]]
                rows += [(row, names[i], common[i], len(own), sizes[i]) for i in at]
            columns = list(zip(*rows)) if rows else [[]] * 5
            key = batch[0].take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *(pa.array(c, pa.int64()) for c in columns[1:])], [batch.schema.names[0], "bank_id", "common", "of_own", "of_bank"])

    return run


def sharing_words(rows: DataFrame, key: str, bank: DataFrame, bank_key: str, *, k: int | None = None, least: int = 1, block: int = 5000) -> DataFrame:
    """key, bank_id, common, of_own, of_bank: entries of a bank that share at least so many words with a row.

    Both have words, distinct ones. With k only the most similar by Jaccard to six
    decimals, equal ones by bank_id. The bank goes to the tasks in blocks of so many
    entries, as lists of entries by word, so no pair but those that are returned is ever
    shuffled; each block reads rows once.
    """
    spark, parts = rows.sparkSession, None
    blocks = max(1, -(-bank.count() // block))
    for b in range(blocks):
        own = bank.where(F.pmod(F.xxhash64(bank_key), F.lit(blocks)) == b).select(bank_key, "words").collect()  # one block
        by_word: dict[str, list[int]] = defaultdict(list)
        for at, row in enumerate(own):
            for w in row["words"] or ():
                by_word[w].append(at)
        value = (np.array([r[bank_key] for r in own], np.int64), np.array([len(r["words"] or ()) for r in own], np.int64), {w: np.array(p) for w, p in by_word.items()})
        schema = f"{key} {rows.schema[key].dataType.simpleString()}, bank_id long, common long, of_own long, of_bank long"
        found = rows.select(key, "words").mapInArrow(_sharing(spark.sparkContext.broadcast(value), k, least), schema)
        parts = found if parts is None else parts.unionByName(found)
    if k is None or blocks == 1:
        return parts
    score = F.floor(F.col("common") / (F.col("of_own") + F.col("of_bank") - F.col("common")) * 1e6 + 0.5)
    return parts.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "bank_id"))).where(F.col("_rank") <= k).drop("_rank")


def _first_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, left, right, ...) whose left and right no row before them in their group has; groups follow each other."""
    last, used_left, used_right = None, set(), set()
    for batch in batches:
        kept = []
        for at, (group, left, right) in enumerate(zip(*(batch[k].to_pylist() for k in range(3)))):
            if group != last and (group == group or last == last):  # NaN is a group as well
                last, used_left, used_right = group, set(), set()
            if left not in used_left and right not in used_right:
                used_left.add(left)
                used_right.add(right)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int64()))


def matched_once(pairs: DataFrame, group: str, left: str, right: str, score: str, *, least: float = 0.34, most_pairs: int = 100_000) -> DataFrame:
    """Pairs of a group, best first, such that each left and each right is used once; equal scores go by left, then right.

    Groups of at most most_pairs pairs are sorted, and gone through as they pass by; a task
    holds what the group at hand has used. In a larger one, pairs
    that are the best of their left and of their right are taken, as whoever goes through
    all pairs from the best on has to take them as well, and pairs of what they use go;
    rounds of this leave the same matching, until no group is larger.
    """
    columns = [group, left, right, score]
    own = materialise(pairs.where(F.col(score) >= least).select(*columns), "pairs")  # read to count groups, and again
    settled = own.limit(0)
    sized = own.groupBy(group).count()
    if not sized.where(F.col("count") > most_pairs).isEmpty():
        own, rounds = own.withColumn("_key", F.struct(group)), []
        order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
        while True:
            large = own.groupBy("_key").count().where(F.col("count") > most_pairs).select("_key")
            if large.isEmpty():
                break
            open_ = own.join(F.broadcast(large), "_key")  # fewer groups than pairs by most_pairs
            best = [open_.groupBy("_key", side).agg(F.min(order).alias("_best")).select("_key", F.col("_best.l").alias(left), F.col("_best.r").alias(right)) for side in (left, right)]
            taken = materialise(open_.join(best[0], ["_key", left, right], "left_semi").join(best[1], ["_key", left, right], "left_semi"), "taken")
            rounds.append(taken)
            own = materialise(own.join(taken.select("_key", left), ["_key", left], "left_anti").join(taken.select("_key", right), ["_key", right], "left_anti"), "pairs")
        own = own.select(*columns)
        for taken in rounds:
            settled = settled.unionByName(taken.select(*columns))
    best_first = own.repartition(group).sortWithinPartitions(group, F.desc(score), left, right)
    return settled.unionByName(best_first.mapInArrow(_first_uses, own.schema))
