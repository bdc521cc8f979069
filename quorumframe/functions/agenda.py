"""Cutting minutes into the points of their agenda.

A heading is a line that begins with a number and a sign. Whether it opens a point is
decided by accepted_headings, as it depends on the numbering so far; what stands
between two accepted headings is a segment, and a point keeps all its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.minutes import accepted_headings
from quorumframe.functions.text import col, folded

#: Words that open the title of a point, folded.
TITLE_WORDS = ("proposicion", "propuesta", "mocion", "aprobar", "aprobacion", "dar cuenta", "se da cuenta", "dictamen", "ratificacion", "declaracion", "iniciativa", "preguntas", "ruegos", "toma de", "modificacion", "ordenanza", "presupuesto")
#: Lines that are furniture of a page, folded.
FURNITURE = ("ayuntamiento de bilbao", "bilboko udala", "egiaztatzeko", "verificacion", "https", "csv", "pagina", "orrialdea")
_HEADING = r"(?m)^[ \t]*(?:PUNTO[ \t]+)?-?[ \t]*(\d{1,3})[ \t]*(?:\.-|\.|-|\))[ \t]*(\S[^\n]*)"


def without_furniture(c: Column | str) -> Column:
    """Text without lines of page furniture and lines of digits and signs alone; blank lines as they are."""
    kept = F.filter(F.split(col(c), "\n"), lambda line: ~folded(line).rlike(f"^{any_of(FURNITURE)}") & ~folded(line).rlike(r"^[^a-z]*\d[^a-z]*$"))
    return F.array_join(kept, "\n")


def session_of(file: Column | str) -> Column:
    """date, kind and extraordinary of the session that a file name tells; the date is null if there is no such day."""
    name = folded(file)
    day = F.coalesce(F.try_to_date(F.regexp_extract(name, r"(\d{2}-\d{2}-\d{4})", 1), "dd-MM-yyyy"), F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))
    kind = F.when(name.rlike("constituti"), "constitutive").when(name.rlike("extraordinari"), "extraordinary").when(name.rlike("urgen"), "urgent").otherwise("ordinary")
    return F.struct(day.alias("date"), kind.alias("kind"))


def heading_candidates(texts: DataFrame, key: str, text: str, is_old: Column) -> DataFrame:
    """key, place, number, title and the signs that accepted_headings asks for, of each line that may open a point."""
    numbers, titles = (F.regexp_extract_all(text, F.lit(_HEADING), F.lit(k)) for k in (1, 2))
    pieces = F.split(text, _HEADING, -1)
    whole = F.regexp_extract_all(text, F.lit(_HEADING), F.lit(0))
    each = texts.select(key, is_old.alias("is_old"), F.posexplode(F.arrays_zip(numbers.alias("n"), titles.alias("t"), whole.alias("w"), F.slice(pieces, F.lit(1), F.size(numbers)).alias("gap"))).alias("k", "h"))
    by_key = Window.partitionBy(key).orderBy("k")
    place = F.sum(F.length("h.gap") + F.length("h.w")).over(by_key) - F.length("h.w")
    title = folded("h.t")
    opens = title.rlike(f"^{any_of(TITLE_WORDS)}")
    strong = opens | F.col("h.t").rlike(r"^\p{Lu}[\p{Lu} ]{9,}")
    found = each.select(key, place.cast("int").alias("place"), F.length("h.w").alias("_long"), F.col("h.n").cast("int").alias("number"), F.col("h.t").alias("title"), "is_old", strong.alias("is_strong"), opens.alias("opens"), title.rlike(r"^(?:aprob|lectura).{0,90}\bactas?\b").alias("is_minutes"))
    return found.where("number > 0")


def segments(texts: DataFrame, key: str, text: str, *, is_old: Column | None = None) -> DataFrame:
    """key, ord, number, title, start, end and text of each segment of the minutes; what stands before the first heading is none.

    A segment ends where the next begins, the last one with its text.
    """
    headings = accepted_headings(heading_candidates(texts, key, text, F.lit(False) if is_old is None else is_old), key)
    by_key = Window.partitionBy(key).orderBy("place")
    bounds = headings.select(key, F.row_number().over(by_key).alias("ord"), "number", "title", F.col("place").alias("start"), F.lead("place").over(by_key).alias("_next"))
    met = bounds.join(texts.select(key, F.col(text).alias("_text")), key)
    end = F.coalesce("_next", F.length("_text"))
    return met.select(key, "ord", "number", "title", "start", end.alias("end"), F.expr("substring(_text, start + 1, coalesce(_next, length(_text)) - start)").alias("text"))


def point_title(c: Column | str, most: int = 300) -> Column:
    """The title that a segment opens with: up to the end of its first sentence or a blank line, in one line, without the number."""
    first = F.regexp_extract(F.regexp_replace(col(c), r"^\s*(?:PUNTO\s+)?-?\s*\d{1,3}\s*(?:\.-|\.|-|\))\s*", ""), r"(?s)^(.*?)(?:(?<=[\p{Ll}\p{Lu}\"”)])\.\s|\n\s*\n|$)", 1)
    return F.substring(F.btrim(F.regexp_replace(first, r"\s+", " ")), 1, most)


def points(segments_: DataFrame, key: str, number: str = "number") -> DataFrame:
    """One row for each point of a document: the title of its longest segment (the first of equal ones) and all its text in order."""
    piece = F.array_sort(F.collect_list(F.struct("ord", "text")))
    longest = F.max_by("title", F.struct(F.length("text"), -F.col("ord")))
    return segments_.groupBy(key, number).agg(F.min("ord").alias("ord"), longest.alias("title"), F.array_join(F.transform(piece, lambda p: p["text"]), "\n").alias("text"))


def only_point_title(c: Column | str) -> Column:
    """The title of the only point of an extraordinary session, from the words that announce it; null if none does."""
    flat = F.regexp_replace(col(c), r"\s+", " ")
    pieces = F.split(flat, r"(?iu)(?:único punto|punto único|orden del día(?: es)?|objeto de la sesión)[^:.]{0,60}: ?", -1)
    title = F.when(F.size(pieces) > 1, F.btrim(F.regexp_extract(F.element_at(pieces, -1), r"^([^.;]{5,300})", 1)))
    return F.when(title != "", title)


def agenda_number(title: Column | str) -> Column:
    """The number that a title opens with; null if it opens with none."""
    return F.regexp_extract(col(title), r"^\W*(\d{1,3})\s*[.)-]", 1).try_cast("int")


def topic_prefix(title: Column | str, most: int = 80) -> Column:
    """What tells a topic: its agenda number, else the beginning of its folded title."""
    return F.coalesce(agenda_number(title).cast("string"), F.substring(folded(title), 1, most))


# Titles of courtesy before names in lists of those present.
_COURTESY = r"(?:\bD\.ª|\bDª\.?|\bDña\.?|\bDoña\b|\bDon\b|\bSra\.|\bSr\.|\bD\.)\s*"


def present(c: Column | str, excluded: tuple[str, ...] = ()) -> Column:
    """Names of those present: what stands after each title of courtesy up to the next sign, in order; names that hold an excluded word (folded) go."""
    names = F.transform(F.slice(F.split(F.regexp_replace(col(c), r"\s+", " "), _COURTESY, -1), 2, 10_000_000), lambda p: F.btrim(F.regexp_extract(p, r"^([\p{Lu}][\p{L}'-]+(?: (?:de |del |de la |y )?[\p{Lu}][\p{L}'-]+){0,5})", 1)))
    kept = F.filter(names, lambda n: n != "")
    return F.filter(kept, lambda n: ~folded(n).rlike(any_of(excluded))) if excluded else kept
