"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Base rules find assigned values, access keys and long hex strings. A wider net
finds other tokens that mix letters and digits. The hash of every candidate is
then counted over the distinct owners and repositories that hold it: a value in
many owners' files is an example that was copied around, one that a single owner
has looks live. Live-looking values of the wider net are added as spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import hot_join, materialise, spans_text

#: Kind, pattern, the group that holds the value.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),  # a run is matched from its first AKIA on, so the least length can stand in the pattern
    ("hex", r"[0-9a-f]{24,}", 0),
)
WIDER = ("live", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}", 0)
_LEAST_ASSIGNED = 6

_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What combine makes of all values so far, at each place of an array; for combine such as a sum or a maximum.

    Each round combines what is a power of two apart, so n values take log2(n) rounds
    over the array and no array grows element by element.
    """
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda step: step < F.size(values))

    def doubled(so_far: Column, step: Column) -> Column:
        earlier = F.concat(F.array_repeat(F.lit(None).cast("int"), step), F.slice(so_far, F.lit(1), F.size(so_far) - step))
        return F.zip_with(so_far, earlier, lambda own, before: F.when(before.isNull(), own).otherwise(combine(own, before)))

    return F.aggregate(steps, values, doubled)


def _with_spans(df: DataFrame, order: int, kind: str, pattern: str, group: int) -> DataFrame:
    """df with the column kind: spans of the leftmost matches that do not overlap, in code points."""
    pieces, found, ends, values = (f"_{x}" for x in ("pieces", "found", "ends", "values"))
    none = F.array().cast("array<string>")
    hit = F.col("text").rlike(pattern)
    df = df.withColumn(found, F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col(found)
    df = df.withColumn(values, F.when(F.size(found) > 0, value).otherwise(none))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.col(found), lambda p, m: F.char_length(p) + F.char_length(m))
    df = df.withColumn(ends, F.when(F.size(found) > 0, steps).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(ends, F.when(F.size(found) > 1, running(F.col(ends), lambda a, b: a + b)).otherwise(F.col(ends)))
    spans = F.transform(
        F.arrays_zip(F.col(ends).alias("e"), F.col(found).alias("m"), F.col(values).alias("v")),
        lambda x: F.struct((x["e"] - F.char_length(x["m"])).alias("start"), F.lit(order).alias("ord"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")),
    )
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= _LEAST_ASSIGNED)
    return df.withColumn(kind, F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))).drop(pieces, found, ends, values)


def _with_apart(df: DataFrame) -> DataFrame:
    """df with the column apart: the live spans that no base span overlaps, by one sweep over both.

    At the end of a live span, the base spans that began before it must all have ended
    by its start; so the furthest end so far decides.
    """
    begun = F.transform("base", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("is_base"), s["end"].alias("end"), s.alias("span")))
    asked = F.transform("live", lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("is_base"), F.lit(0).alias("end"), s.alias("span")))
    df = df.withColumn("_sweep", F.when((F.size("live") > 0) & (F.size("base") > 0), F.array_sort(F.concat(begun, asked))))
    furthest = running(F.transform("_sweep", lambda e: e["end"]), F.greatest)
    kept = F.filter(F.arrays_zip(F.col("_sweep").alias("e"), furthest.alias("upto")), lambda x: (x["e"]["is_base"] == 0) & (x["upto"] <= x["e"]["span"]["start"]))
    return df.withColumn("apart", F.when(F.col("_sweep").isNull(), F.col("live")).otherwise(F.transform(kept, lambda x: x["e"]["span"]))).drop("_sweep")


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"), F.size(F.array_distinct(F.split(s["value"], ""))).alias("letters")))


def secrets(docs: DataFrame, *, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), example_owners: int = 3, least_letters: int = 8) -> DataFrame:
    """Secrets of each document, with what the rest of the corpus says about them.

    One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans
    and n_live, n_example. Base spans always stay; spans adds the tokens of the
    wider net that fewer than example_owners owners hold, that have at least
    least_letters different characters and that touch no base span. Null texts are
    empty; a null owner or repository counts as one more owner or repository.
    Repeated rows give repeated rows, which count once in the frequencies.
    """
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce(owner, F.lit("\0"))).alias("owner"), F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in repository)).alias("repository"))
    for order, rule in enumerate((*BASE, WIDER)):
        df = _with_spans(df, order, *rule)
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    df = _with_apart(df).select("doc_id", "owner", "repository", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, _, _ in BASE), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), _hashed(F.concat("base", "apart")).alias("candidates"), F.monotonically_increasing_id().alias("row"))
    found = materialise(df, "secrets")
    candidates = found.where(F.size("candidates") > 0).select("row", "owner", "repository", F.explode("candidates").alias("c"))
    held = candidates.select(F.col("c.hash").alias("hash"), "owner", "repository").groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
    owned = held.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("rows").alias("rows"))
    owned = materialise(owned, "owned")
    # a value that was copied everywhere is the very case of this method: its facts go to its rows
    judged = hot_join(candidates.withColumn("hash", F.col("c.hash")), owned, "hash", "rows").withColumn("example", F.col("n_owners") >= example_owners)
    kept = judged.where((F.col("c.kind") != "live") | (~F.col("example") & (F.col("c.letters") >= least_letters)))
    span = F.struct(*(F.col(f"c.{k}").alias(k) for k in ("start", "ord", "end", "kind")))
    marks = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"), F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"))
    return found.join(marks, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans_text(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example")
    )
