"""Retrieval as plans: channels of candidates, fused, reranked, diversified and cut to a budget.

A candidate has frag_id, channel and rank. Channels are plain DataFrames, so a
channel that does not exist is an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.text import folded, literal_pattern, searchable
from quorumframe.operators.postings import PostingsIndex
from quorumframe.operators.windows import char_budget, even_sample, filter_unless_few, first_seen, newest
from quorumframe.storage import materialise

#: How many candidates of each channel take part, in this order.
CAPS = {"semantic": 22, "thematic": 22, "keyword": 24, "proposals": None}
FILLER_SCORE, FLOOR = 0.02, 0.01


def keyword_channel(fragments: DataFrame, phrases: list[str], *, index: PostingsIndex | None = None, rarest: int = 3, cap: int = 3000, per_phrase: int = 40) -> DataFrame:
    """frag_id, rank: fragments that hold the rarest phrases, taken from their lists in turns.

    With an index of the fragments only its rows of the phrases' words are read. Without
    one, texts are read once: which phrases a fragment holds is written down, and
    counted and ranked from there. Counts above cap are equal.
    """
    if index is not None:
        held = index.phrases(phrases).withColumnRenamed("doc", "frag_id")
        hits = materialise(fragments.select("frag_id", "date").join(held, "frag_id"), "hits")
    else:
        text = searchable("text")
        found = F.array_compact(F.array(*(F.when(text.rlike(literal_pattern(p)), F.lit(k)) for k, p in enumerate(phrases))) if phrases else F.array().cast("array<int>"))
        hits = materialise(fragments.select("frag_id", "date", F.explode(found).alias("phrase")), "hits")
    counts = {r["phrase"]: r["n"] for r in hits.groupBy("phrase").agg(F.count("*").alias("n")).collect()}  # a row a phrase
    chosen = sorted(counts, key=lambda k: (min(counts[k], cap), -len(phrases[k]), phrases[k].lower()))[:rarest]
    listed = hits.where(F.col("phrase").isin(*chosen)).withColumn("list", F.array_position(F.array(*map(F.lit, chosen)), F.col("phrase"))) if chosen else hits.withColumn("list", F.lit(0).cast("long")).limit(0)
    top = newest(listed, ["list"], [F.desc("date"), "frag_id"], per_phrase)
    turn = Window.partitionBy("list").orderBy(F.desc("date"), "frag_id")
    ranked = first_seen(top.withColumn("turn", F.row_number().over(turn)), ["frag_id"], ["turn", "list"])
    return ranked.select("frag_id", F.row_number().over(Window.orderBy("turn", "list")).alias("rank"))  # per_phrase rows a phrase at most


def thematic_channel(fragments: DataFrame, theme: Column, *, k: int = 40) -> DataFrame:
    """frag_id, rank: fragments of a theme, spread evenly over time."""
    held = fragments.where(theme).select("frag_id", "date", F.lit(0).alias("all"))
    spread = even_sample(held, ["all"], ["date", "frag_id"], k, coarse="date")
    return spread.select("frag_id", F.row_number().over(Window.orderBy("date", "frag_id")).alias("rank"))  # k rows


def fuse(channels: Mapping[str, DataFrame], caps: Mapping[str, int | None] = CAPS) -> DataFrame:
    """frag_id, channel, rank, place: the channels in the order of caps, each up to its cap; of repeats the first stays."""
    parts = None
    for at, (name, cap) in enumerate(caps.items()):
        if name not in channels:
            continue
        part = channels[name].select("frag_id", "rank", F.lit(name).alias("channel"), F.lit(at).alias("_at"))
        part = part.where(F.col("rank") <= cap) if cap is not None else part
        parts = part if parts is None else parts.unionByName(part)
    once = first_seen(parts, ["frag_id"], ["_at", "rank"])
    return once.select("frag_id", "channel", "rank", (F.col("_at") * 1_000_000_000 + F.col("rank")).alias("place"))


def with_fillers(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the score of a reranker; keyword candidates it left out get a small one, others go."""
    met = candidates.join(scored.select("frag_id", "score"), "frag_id", "left")
    filler = F.col("score").isNull() & (F.col("channel") == "keyword")
    return met.select("*", filler.alias("is_filler")).withColumn("score", F.coalesce("score", F.when(F.col("is_filler"), F.lit(FILLER_SCORE)))).where("score is not null")


def relevant(ranked: DataFrame, floor: float = FLOOR) -> DataFrame:
    """All rows if the best score that is no filler reaches the floor; none otherwise."""
    best = ranked.agg(F.max(F.when(~F.col("is_filler"), F.col("score"))).alias("_best"))  # one row
    return ranked.join(F.broadcast(best)).where(F.col("_best") >= floor).drop("_best")


def topics(ranked: DataFrame, *, share: float = 0.4, least: float = 4.0, title: float = 20.0, penalty: Column | None = None) -> DataFrame:
    """topic, year, score: scores added up by topic, those far below the best left out; a title match always stays.

    penalty is a factor by topic, for those that are rarely meant.
    """
    by = ranked.groupBy("topic", "year").agg(F.sum("score").alias("score"))
    if penalty is not None:
        by = by.withColumn("score", F.col("score") * penalty)
    best = by.agg(F.max("score").alias("_best"))  # one row
    return by.join(F.broadcast(best)).where(((F.col("score") >= share * F.col("_best")) & (F.col("score") >= least)) | (F.col("score") >= title)).drop("_best")


def with_rescued(expanded: DataFrame, ranked: DataFrame, *, top: int = 8, keyword: int = 10) -> DataFrame:
    """expanded and, after it, the best reranked and the best keyword candidates it lacks."""
    order = Window.orderBy(F.desc("score"), "place")
    own = ranked.where("channel <> 'keyword' or not is_filler").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    kw = ranked.where("channel = 'keyword'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keyword)
    rescued = own.unionByName(kw).join(expanded.select("frag_id"), "frag_id", "left_anti").select("frag_id").distinct()
    return expanded.select("frag_id", F.lit(True).alias("expanded")).unionByName(rescued.withColumn("expanded", F.lit(False)))


def summaries(points: DataFrame, themes: DataFrame, *, most: int = 6) -> DataFrame:
    """point_id and text of each point (point_id, title, group_id) that has themes (point_id, label): its title, group and first labels, to be found by."""
    labels = themes.groupBy("point_id").agg(F.slice(F.array_sort(F.collect_set("label")), 1, most).alias("labels"))
    return points.join(labels, "point_id").select("point_id", F.concat_ws(" ", "title", "group_id", F.array_join("labels", " ")).alias("text"))


def about(fragments: DataFrame, *, themes: Sequence[str] = (), dates: DataFrame | None = None, party: str | None = None, topics_: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Fragments of one of the themes (main theme, or any of themes), of the dates (session_date), and of the party and topics as far as enough are left.

    A filter by party that leaves fewer than least fragments, or one by topic prefixes
    that leaves none, is not applied.
    """
    if themes:
        fragments = fragments.where(F.col("theme").isin(*themes) | F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    if dates is not None:
        fragments = fragments.join(dates.select(F.col("session_date").alias("_day")).distinct(), F.col("date") == F.col("_day"), "left_semi")
    if party is not None:
        fragments = filter_unless_few(fragments, F.coalesce(F.col("party") == party, F.lit(False)), least)
    if topics_:
        meant = F.lit(False)
        for t in topics_:
            meant = meant | folded("topic").startswith(t)
        fragments = filter_unless_few(fragments, F.coalesce(meant, F.lit(False)), 1)
    return fragments


def debates(fragments: DataFrame, chosen: DataFrame, *, most: int = 15) -> DataFrame:
    """frag_id of all fragments of the debates (date, topic, source) that the chosen fragments (frag_id, place) are from; the first chosen ones alone if they are of none."""
    met = fragments.join(chosen.select("frag_id"), "frag_id", "left_semi")
    own = met.where("topic is not null").select("date", "topic", "source").distinct()
    whole = fragments.join(own, ["date", "topic", "source"], "left_semi").select("frag_id")
    alone = met.where("topic is null").join(chosen, "frag_id").orderBy("place").limit(most).select("frag_id")
    return whole.unionByName(alone).distinct()


def citations(rows: DataFrame, sources: DataFrame, *, most: int = 15) -> DataFrame:
    """point_id, date, page, file and title of the points that the rows (point_id, pos) name, in the order of their first row."""
    first = rows.groupBy("point_id").agg(F.min("pos").alias("pos"))
    return first.join(sources, "point_id").orderBy("pos", "point_id").limit(most).select("point_id", "date", "page", "file", "title")


def context(fragments: DataFrame, chosen: DataFrame, *, budget: int = 20_000, cap: int = 3800) -> DataFrame:
    """Blocks by date, topic and source: their texts in order, capped, as far as the budget goes.

    Blocks that hold a leading fragment (chosen has frag_id, and lead if some lead) come
    first, in the order of their leads; the others follow, oldest first.
    """
    lead = F.col("lead") if "lead" in chosen.columns else F.lit(None).cast("int")
    own = fragments.join(chosen.select("frag_id", lead.alias("_lead")), "frag_id")
    piece = F.struct("chunk_index", "text")
    blocks = own.groupBy("date", "topic", "source").agg(F.min("_lead").alias("_lead"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.min_by("vote_result", F.when(F.col("vote_result").isNotNull(), F.col("chunk_index"))).alias("vote_result"))
    text = F.substring(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n"), 1, cap)
    shown = blocks.select("date", "topic", "source", "vote_result", text.alias("text"), "_lead", F.lit(0).alias("_all"))
    return char_budget(shown, ["_all"], [F.col("_lead").asc_nulls_last(), "date", "topic", "source"], F.char_length("text"), budget).drop("_all", "_lead")  # some tens of blocks
