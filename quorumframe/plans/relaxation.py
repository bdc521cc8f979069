"""Subjects of questions: their alternatives, the themes that stand for them, and what is left out when nothing is found.

A subject is an array of alternatives, each an array of stems; a point holds it if one of
its fields holds all stems of one of them. Where no point does, fewer words are asked
for, step by step. All steps of all questions meet the fields at once, by the rarest
word of each; then the first step with hits counts, and only its rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.questions import QUESTION_WORDS
from quorumframe.functions.text import bound, col, folded, stem, words
from quorumframe.operators.skew import hot_join
from quorumframe.operators.vectors import assign_prototypes
from quorumframe.storage import materialise

#: Folded words that a subject follows, what ends it, and what joins its alternatives.
INTRODUCING = ("sobre", "acerca de", "relacionada con", "relacionado con", "relacionadas con", "relacionados con", "referente a", "referentes a", "en materia de", "respecto a", "respecto de", "en torno a", "hablado de", "hablo de", "debatido de", "tratado de")
ENDING = ("aprobo", "aprobaron", "aprobada", "aprobadas", "debatio", "durante", "ha", "han", "legislatura", "mandato", "opina", "opinan", "pleno", "por", "presentaron", "presento", "que", "rechazaron", "rechazo", "se", "voto", "votaron")
OR, AND, POSSESSIVES = ("o", "u"), ("y", "e"), ("su", "sus")
_ARTICLES = ("el", "la", "los", "las", "lo", "un", "una", "en", "con", "sobre")


def subject_phrase(question: Column | str) -> Column:
    """The words of a question that say what it is about, folded; null if it says so of nothing."""
    told = F.regexp_extract(folded(question), rf"\b{any_of(INTRODUCING)}l? ([^?.,;:]+)", 2)  # "del", "al"
    said = F.split(F.btrim(told), " ")
    # up to the first word that ends it, or a year with what leads to it
    stops = F.transform(said, lambda w, k: F.when(w.isin(*ENDING) | w.rlike(r"^(19|20)\d\d$"), k))
    end = F.coalesce(F.array_min(F.array_compact(stops)), F.size(said))
    own = F.slice(said, F.lit(1), F.greatest(end, F.lit(0)))
    trimmed = F.regexp_replace(F.array_join(own, " "), rf"(?: (?:en|entre|desde|hasta|de|del|y|el|la|los|las))+$", "")
    return F.when(trimmed != "", trimmed)


def alternatives(phrase: Column | str) -> Column:
    """The alternatives of a subject phrase, each the stems of its words, in order.

    "or" parts them. What "and" adds with a possessive is a part of what was named before
    and no subject of its own, so it goes. A complement that only the last alternative
    has ("the move or the repair of the market") belongs to all that are a word or two.
    """
    phrase = F.coalesce(col(phrase), F.lit(""))
    owned = F.regexp_replace(phrase, rf" {any_of(AND)} {any_of(POSSESSIVES)} .*?(?= {any_of(OR)} |$)", "")
    parts = F.filter(F.split(owned, rf" {any_of(OR)} "), lambda p: p != "")

    def completed(own: Column) -> Column:
        complement = F.regexp_extract(F.try_element_at(own, F.lit(-1)), r" (del? .*)$", 1)
        short = lambda p: (F.size(F.filter(F.split(p, " "), lambda w: ~w.isin(*_ARTICLES))) <= 2) & ~p.rlike(r"\bdel?\b")
        return F.transform(own, lambda p: F.when((F.size(own) > 1) & short(p) & (complement != ""), F.concat(p, F.lit(" "), complement)).otherwise(p))

    told = lambda p: F.array_distinct(F.transform(F.filter(words(p, 4), lambda w: ~w.isin(*QUESTION_WORDS)), stem))
    return F.filter(F.transform(bound(parts, completed), told), lambda a: F.size(a) > 0)


def with_themes(subjects: DataFrame, themes: DataFrame) -> DataFrame:
    """question_id, alternatives, themes: alternatives that are wholly the words of a theme are that theme, and are added to the others, not asked for beside them.

    subjects has question_id and alternatives, themes has question_id, theme_id and label,
    one row for each theme found in a question. Themes whose words stand in a more
    specific alternative are absorbed by it: they are in absorbed, and no filter.
    """
    found = themes.groupBy("question_id").agg(F.collect_list(F.struct("theme_id", F.array_distinct(F.transform(words("label", 4), stem)).alias("stems"))).alias("found"))
    met = subjects.join(found, "question_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<theme_id:long,stems:array<string>>>")))
    inside = lambda t, a: F.size(F.array_except(t["stems"], a)) == 0
    whole = lambda a: F.filter("found", lambda t: inside(t, a) & (F.size(F.array_except(a, t["stems"])) == 0))
    ids = lambda ts: F.array_sort(F.array_distinct(F.transform(ts, lambda t: t["theme_id"])))
    return met.select(
        "question_id",
        F.filter("alternatives", lambda a: F.size(whole(a)) == 0).alias("alternatives"),
        ids(F.flatten(F.transform("alternatives", whole))).alias("themes"),
        ids(F.filter("found", lambda t: F.exists("alternatives", lambda a: inside(t, a) & (F.size(F.array_except(a, t["stems"])) > 0)))).alias("absorbed"),
    )


def _stems(text: str) -> Column:
    return F.array_distinct(F.transform(F.concat(words(text), F.regexp_extract_all(folded(text), F.lit(r"\b\d+\b"), F.lit(0))), stem))


def ladder(subjects: DataFrame, counts: DataFrame, n_points: DataFrame, *, specific: float = 0.03, rare: float = 0.01) -> DataFrame:
    """question_id, step, criterion, alternative, words: what is asked for at each step; a step that asks for the same as one before it goes.

    Step 0 asks for all words of an alternative, step 1 for its specific ones (those that
    at most this share of points hold, or digits), step 2 for the rarest alone, if few
    enough hold it. counts has word and df; n_points is one row with n.
    """
    each = subjects.select("question_id", F.posexplode("alternatives").alias("alternative", "words"))
    known = each.select("question_id", "alternative", "words", F.explode("words").alias("word")).join(counts, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    said = known.groupBy("question_id", "alternative").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("df", "word"))).alias("held")).join(F.broadcast(n_points))
    plain = lambda held: F.array_sort(F.transform(held, lambda h: h["word"]))
    special = F.filter("held", lambda h: (h["df"] <= specific * F.col("n")) | h["word"].rlike(r"^\d+$"))
    first = F.filter(F.slice("held", 1, 1), lambda h: h["df"] <= rare * F.col("n"))
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(name).alias("criterion"), asked.alias("words")) for k, (name, asked) in enumerate((("all words", F.array_sort("words")), ("specific words", plain(special)), ("rarest word", plain(first))))))
    rows = said.select("question_id", "alternative", F.explode(steps).alias("s")).select("question_id", "alternative", "s.*").where("size(words) > 0")
    same = Window.partitionBy("question_id", "alternative", "words").orderBy("step")
    return rows.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


def relaxed_hits(subjects: DataFrame, fields: DataFrame, *, specific: float = 0.03, rare: float = 0.01, last_step: int = 2) -> DataFrame:
    """question_id, step, criterion, point_id, relation: the points of the first step of a question that has any.

    subjects has question_id and alternatives; fields has point_id, text and is_about. A
    point treats the subject if a field about it holds an alternative, else it mentions
    it; a question for which some points treat it leaves out those that only mention it.
    Questions without a hit at any step have no rows.
    """
    held = materialise(fields.where("text is not null").select("point_id", "is_about", _stems("text").alias("stems")), "stems")
    asked = subjects.select(F.explode(F.flatten("alternatives")).alias("word")).distinct()
    used = held.select("point_id", F.explode("stems").alias("word")).join(asked, "word", "left_semi").distinct()
    counts = materialise(used.groupBy("word").agg(F.count("*").alias("df")), "df")
    n_points = held.agg(F.count_distinct("point_id").alias("n"))  # one row
    steps = materialise(ladder(subjects, counts, n_points, specific=specific, rare=rare).where(F.col("step") <= last_step), "ladder")
    # fields and steps meet over the rarest word of a step; all its words are looked for in the field there
    rarest = steps.select("*", F.explode("words").alias("word")).join(counts, "word").groupBy("question_id", "step", "criterion", "alternative", "words").agg(F.min(F.struct("df", "word"))["word"].alias("word"), F.count("*").alias("n")).where(F.col("n") == F.size("words"))
    by_word = rarest.groupBy("word").agg(F.collect_list(F.struct("question_id", "step", "criterion", "words")).alias("asked")).join(counts, "word")
    placed = held.select("point_id", "is_about", "stems", F.explode("stems").alias("word"))
    met = hot_join(placed, materialise(by_word, "asked"), "word", "df").select("point_id", "is_about", "stems", F.explode("asked").alias("a"))
    hits = met.where(F.size(F.array_except("a.words", "stems")) == 0).groupBy("a.question_id", "a.step", "a.criterion", "point_id").agg(F.bool_or("is_about").alias("treats"))
    best = hits.groupBy("question_id").agg(F.max(F.struct((-F.col("step")).alias("s"), "treats")).alias("_best"))
    kept = hits.join(best, "question_id").where((F.col("step") == -F.col("_best.s")) & (F.col("treats") == F.col("_best.treats")))
    return kept.select("question_id", "step", "criterion", "point_id", F.when(F.col("treats"), "treats").otherwise("mentions").alias("relation"))


def subject_exists(subjects: DataFrame, fields: DataFrame) -> DataFrame:
    """question_id, step: whether anything is found by all words (0) or by the specific ones (1); null if not."""
    found = relaxed_hits(subjects, fields, last_step=1).select("question_id", "step").distinct()
    return subjects.select("question_id").distinct().join(found, "question_id", "left")


def known_themes(asked: DataFrame, themes: DataFrame, *, vectors: DataFrame | None = None, prototypes: DataFrame | None = None, least: float = 0.70, most_themes: int = 10_000) -> DataFrame:
    """slug, theme_id and by ("text", "meaning" or null) for each slug of asked: the theme that a name which is none may mean.

    By text: the longest slug of themes (theme_id, slug) that stands within the name, or
    else that the name begins, separators apart; of equally long ones the first. What text
    leaves open goes by meaning, where vectors (slug, embedding) has one: to the theme of
    the most similar of prototypes (theme_id, embedding) from least on, or to none. A slug
    is asked once however often it comes; a null or empty one means nothing. themes are
    a vocabulary of at most most_themes, one row that all names meet.
    """
    bare = lambda c: F.regexp_replace(c, "[-_ ]", "")
    own = themes.select(bare("slug").alias("s"), "theme_id").where("s <> ''").distinct()
    if (n := own.count()) > most_themes:
        raise ValueError(f"{n} themes are more than {most_themes}")
    every = own.agg(F.collect_list(F.struct("s", "theme_id")).alias("_themes"))  # one row
    said = asked.select("slug").distinct().withColumn("_s", bare("slug")).join(F.broadcast(every))
    named = F.filter("_themes", lambda t: (F.col("_s") != "") & (F.contains(F.col("_s"), t["s"]) | F.startswith(t["s"], F.col("_s"))))
    # the longest first: within the name it is long, and what the name begins is longer still
    first = F.array_min(F.transform(named, lambda t: F.struct((~F.contains(F.col("_s"), t["s"])).alias("begun"), (-F.length(t["s"])).alias("size"), t["s"].alias("s"), t["theme_id"].alias("theme_id"))))
    found = said.select("slug", first["theme_id"].alias("_text"))
    if vectors is None or prototypes is None:
        return found.select("slug", F.col("_text").alias("theme_id"), F.when(F.col("_text").isNotNull(), F.lit("text")).alias("by"))
    # one vector a slug; only slugs that are still open are compared
    open_ = found.where("_text is null and slug is not null").select("slug")
    meant = vectors.join(open_, "slug").groupBy("slug").agg(F.min("embedding").alias("embedding")).withColumnRenamed("slug", "vec_id")
    near = assign_prototypes(meant, prototypes.select(F.col("theme_id").cast("string").alias("name"), "embedding"), least=least)
    by_meaning = near.select(F.col("vec_id").alias("slug"), F.col("prototype").alias("_meant"))
    met = found.join(by_meaning, "slug", "left")
    theme = F.coalesce(F.col("_text").cast("string"), "_meant")
    return met.select("slug", theme.alias("theme_id"), F.when(F.col("_text").isNotNull(), "text").when(F.col("_meant").isNotNull(), "meaning").alias("by"))
