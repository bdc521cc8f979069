"""Text functions as column expressions: folding, stems, keys, keywords, regex builders, overlap."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks of Latin alphabets and what they fold to, pairwise.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it, also in branches."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unmarked(c: Column | str) -> Column:
    """Without accents; case and white space as they are."""
    return F.translate(col(c), MARKED, PLAIN)


def _lowered(c: Column | str) -> Column:
    """Lower case, no accents. The dotted capital I is an i: in lower case it would be one and a mark that parts words."""
    return F.lower(F.translate(col(c), MARKED + "İ", PLAIN + "i"))


def folded(c: Column | str) -> Column:
    """Lower case, no accents, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_lowered(c), r"\s+", " "))


def ascii_only(c: Column | str) -> Column:
    """No accents, and nothing that is not ASCII."""
    return F.regexp_replace(unmarked(c), r"[^\x00-\x7F]", "")


def simplified(c: Column | str) -> Column:
    """Lower-case ASCII letters, digits and white space only."""
    return F.regexp_replace(F.lower(ascii_only(c)), r"[^a-z0-9\s]", "")


def without_spaces(c: Column | str) -> Column:
    """Folded, without any white space; for text whose words were torn apart."""
    return F.regexp_replace(F.lower(unmarked(c)), r"\s+", "")


def slug(c: Column | str, most: int = 60) -> Column:
    """Runs of other characters than ASCII letters and digits become one underscore; x if nothing is left."""
    cut = F.substring(F.trim(F.regexp_replace(F.lower(ascii_only(c)), r"[^a-z0-9]+", "_"), F.lit("_")), 1, most)
    return F.when(F.length(cut) > 0, cut).otherwise("x")


#: Letters that sound alike: a pattern for each sound, and the letter that stands for it.
SOUNDS = {"tx": "ch", "qu": "k", "gu": "g", "v": "b", "tz|z|ss": "s", "[iy]+": "i"}


def sounds(c: Column | str) -> Column:
    """A key under which spellings that sound alike meet; c is folded already. No sound's letter is part of another pattern, so their order says nothing."""
    for alike, sound in SOUNDS.items():
        c = F.regexp_replace(col(c), alike, sound)
    return c


def stem(word: Column | str) -> Column:
    """Words of more than five letters without their ending of number and gender."""
    return F.when(F.length(col(word)) > 5, F.regexp_replace(col(word), r"(es|as|os|s|a|o|e)$", "")).otherwise(col(word))


def words(c: Column | str, least: int = 1) -> Column:
    """Runs of letters of a folded text that have the least length, repeats included."""
    return F.regexp_extract_all(_lowered(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def keywords(c: Column | str, stop: tuple[str, ...], least: int = 4) -> Column:
    """Distinct words without stop words, in text order."""
    return F.array_distinct(F.filter(words(c, least), lambda w: ~w.isin(*stop) if stop else F.lit(True)))


def count_of(words_: Column | str, wanted: tuple[str, ...]) -> Column:
    """How many words, repeats included, are among the wanted ones."""
    return F.size(F.filter(col(words_), lambda w: w.isin(*wanted))).cast("long")


def jaccard(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.lit(1), F.size(F.array_union(col(a), col(b))))


def overlap(a: Column | str, b: Column | str) -> Column:
    """How many words both sets share."""
    return F.size(F.array_intersect(col(a), col(b)))


def searchable(c: Column | str) -> Column:
    """Lower case, no accents but the tilde of ñ; what literal_pattern is matched against."""
    keep = {ord(m): p for m, p in zip(MARKED, PLAIN) if m not in "ñÑ"}
    return F.translate(F.lower(col(c)), "".join(map(chr, keep)), "".join(keep.values()))


def literal_pattern(phrase: str) -> str:
    """A pattern for a phrase in searchable text: whole words, the last in singular or plural.

    An ñ in the phrase also finds n, as it is often lost; an n never finds ñ.
    """
    keep = str.maketrans({m: p for m, p in zip(MARKED, PLAIN) if m not in "ñÑ"})
    *before, last = phrase.lower().translate(keep).split()
    if last.endswith("es") and len(last) > 5:
        last, ending = last[:-2], "(?:es?)?"
    elif last.endswith("s") and len(last) > 4:
        last, ending = last[:-1], "s?"
    else:
        ending = "(?:e?s)?"
    spelled = [re.escape(w).replace("ñ", "[nñ]") for w in (*before, last)]
    return r"(?:^|[^\pL\pN_])" + r"\s+".join(spelled) + ending + r"(?:$|[^\pL\pN_])"


def literal_variants(phrase: str) -> list[list[str]]:
    """For each word of a phrase the words that literal_pattern takes for it; a phrase is of words only."""
    keep = str.maketrans({m: p for m, p in zip(MARKED, PLAIN) if m not in "ñÑ"})
    words_ = phrase.lower().translate(keep).split()
    if not words_ or not all(re.fullmatch(r"\w+", w) for w in words_):
        raise ValueError(f"a phrase of words was asked for, not {phrase!r}")
    last = words_[-1]
    if last.endswith("es") and len(last) > 5:
        ended = [last[:-2] + e for e in ("", "e", "es")]
    elif last.endswith("s") and len(last) > 4:
        ended = [last[:-1], last]
    else:
        ended = [last + e for e in ("", "s", "es")]
    lost = lambda w: ["".join(x) for x in product(*(("ñ", "n") if c == "ñ" else (c,) for c in w))]
    return [[v for f in forms for v in lost(f)] for forms in [*([w] for w in words_[:-1]), ended]]


def short_id(*parts: Column | str, method: str = "md5") -> Column:
    """The first 16 hex digits of the digest of the parts; md5 joins them with two bars, sha1 with one."""
    joined = F.concat_ws("||" if method == "md5" else "|", *(col(p).cast("string") for p in parts))
    return F.substring(F.md5(joined) if method == "md5" else F.sha1(joined), 1, 16)


def date_of_label(c: Column | str) -> Column:
    """The date of a DD-MM-YYYY label; null if there is no such day."""
    return F.try_to_date(F.regexp_extract(col(c), r"(\d{2}-\d{2}-\d{4})", 1), "dd-MM-yyyy")


def head_and_tail(c: Column | str, head: int, tail: int, mark: str = "\n[...]\n") -> Column:
    c = col(c)
    return F.when(F.char_length(c) <= head + tail, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(tail))))


def page_range(first: Column | str, last: Column | str) -> Column:
    return F.when(col(first) == col(last), col(first).cast("string")).otherwise(F.concat_ws("-", col(first), col(last)))


def source_url(year: Column | str, filename: Column | str, page: Column | str) -> Column:
    """Where a page of a source file is shown; blanks are %20."""
    quoted = F.replace(F.url_encode(col(filename)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/acta/"), col(year), F.lit("/"), quoted, F.lit("#page="), col(page))
