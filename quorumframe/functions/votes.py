"""Votes in the prose of minutes: the text of a result, and each vote that is taken."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.functions.decisions import AGREED, OBJECTS, OUTCOMES, SETTLED, any_of, count_labels, counts, decisions, meant
from quorumframe.functions.text import bound, col, folded

#: What stands where a result has ended: rules, footers, the hour.
ENDINGS = (r"-{3,}", r" - ", "https?://", "Egiaztatzeko", "Verificaci", "Siendo las ")
#: Folded verbs by which a plenary agrees.
AGREEING = ("aprueba", "aprueban", "acuerda", "desestima", "desestiman", "rechaza", "rechazan", "aprobar", "pleno")

_DECIDES = rf"(?i)\b(?:{any_of(SETTLED)}\s+|se\s+)?{any_of(w for ws in OUTCOMES.values() for w in ws)}\b.*"


def _told(sentence: Column) -> Column:
    """A sentence up to the first ending."""
    return F.btrim(F.element_at(F.split(F.btrim(sentence), "|".join(ENDINGS)), 1))


def _last(sentences: Column) -> Column:
    return F.try_element_at(sentences, F.lit(-1))


def result_text(c: Column | str) -> Column:
    """What a segment says of its result, with its last figures; null if it says nothing.

    The segment is read sentence by sentence. The last one that decides counts from the
    words that do; without figures only if it settles the matter, as a decision that is
    only quoted in the debate does not. Else the last sentence that tells of unanimity.
    """
    def told(x: Column) -> Column:
        phrase, figures = x["phrase"], x["figures"]
        shown = F.concat_ws(", ", *(F.concat(F.lit(f"{label}: "), figures[k]) for label, k in (("a favor", "favour"), ("en contra", "against"), ("abstenciones", "abstain"))))
        tally = F.when(figures["cast"].isNotNull() & figures["favour"].isNotNull(), F.concat(F.lit("Votos emitidos: "), figures["cast"], F.lit(" | "), shown))
        settled = F.exists(decisions(phrase), lambda d: d["settled"] | (d["outcome"] == "decae")) | folded(phrase).rlike(any_of(AGREED))
        return F.coalesce(F.when(phrase.isNotNull() & tally.isNotNull(), F.concat(phrase, F.lit(" ("), tally, F.lit(")"))), tally, F.when(settled, phrase), x["agreed"])

    def read(sentences: Column) -> Column:
        deciding = F.filter(F.transform(sentences, lambda s: _told(F.regexp_extract(s, _DECIDES, 0))), lambda s: s != "")
        agreed = F.filter(sentences, lambda s: folded(s).rlike(rf"\b{any_of(AGREED)}\b") & folded(s).rlike(rf"\b{any_of(AGREEING)}\b"))
        return F.struct(_last(deciding).alias("phrase"), counts(c).alias("figures"), _told(_last(agreed)).alias("agreed"))

    return bound(bound(F.regexp_extract_all(F.regexp_replace(col(c), r"\s+", " "), F.lit("[^.]+"), F.lit(0)), read), told)


def vote_object(c: Column | str) -> Column:
    """What a vote is on, by the noun that stands first: an amendment, single points, the point itself, or something else."""
    noun = F.regexp_substr(folded(c), F.lit(rf"\b{any_of(w for ws in OBJECTS.values() for w in ws)}\b"))
    return F.coalesce(meant(noun, OBJECTS), F.lit("otro"))


#: Folded words of putting something to the vote, of telling how it went, and of concluding from it.
PUTTING, VOTING = ("somete", "someten", "sometida", "sometido", "sometidas", "sometidos"), ("votacion", "votaciones")
TELLING, CONCLUDING = ("computo", "resultado", "votos", "emitidos"), ("virtud", "consecuencia", "consiguiente")
_VOWELS = {"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uúü]", "n": "[nñ]"}


def _spelled(words: Iterable[str]) -> str:
    """A pattern for any of the folded words in text as it is written."""
    return any_of("".join(_VOWELS.get(c, c) for c in w) for w in words).replace("(", "(?:", 1)


#: A clause that puts something to the vote, as far as the noun, and an adjective of it.
_PUT = rf"(?i)(?:\bse )?\b{_spelled(PUTTING)} (?:\p{{L}}+ ){{0,3}}?{_spelled(VOTING)}(?: nominal(?:es)?)?\b"
#: The clause that tells how it went: all from the last stop or comma before its noun.
_TELLS = rf"(?i)[,;:.]?[^,;:.]*\b{_spelled(TELLING)}\b"


def vote_pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord (from 1) and piece: the text after each place where something is put to the vote, as far as it tells how it went."""
    flat = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " ")
    pieces = F.split(flat, _PUT, -1)
    taken = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p.rlike(_TELLS) & (F.size(count_labels(p)) > 0))
    return df.select(key, F.posexplode(taken).alias("_at", "piece")).select(key, (F.col("_at") + 1).alias("ord"), "piece")


def vote_events(df: DataFrame, key: str, text: str, *, most: int = 400) -> DataFrame:
    """key, ord (from 1), object, description, cast, favour, against, abstain, decision of each vote taken in the text.

    A text is cut where something is put to the vote. What is voted on stands before the
    clause that tells how it went; a piece without such a clause, or without any figure,
    is no vote. The decision is what follows from it: the rest of the sentence that
    concludes. Where the votes cast are stated, a figure that is not is zero.
    Descriptions and decisions are shown up to so many characters.
    """
    each = vote_pieces(df, key, text).withColumnRenamed("piece", "_piece")
    told = F.split("_piece", _TELLS, 2)
    concluded = rf"(?i)\b{_spelled(CONCLUDING)}\b,? ([^.]*)"
    each = each.select(key, "ord", F.btrim(F.element_at(told, 1)).alias("_on"), F.regexp_extract(F.element_at(told, 2), concluded, 1).alias("_then"), counts("_piece").alias("_n"))
    zero = lambda k: F.coalesce(F.col(f"_n.{k}"), F.when(F.col("_n.cast").isNotNull(), F.lit(0)))
    decision = F.substring(F.btrim(F.coalesce("_then", F.lit(""))), 1, most)
    return each.select(key, "ord", vote_object("_on").alias("object"), F.substring("_on", 1, most).alias("description"), F.col("_n.cast").alias("cast"), *(zero(k).alias(k) for k in ("favour", "against", "abstain")), decision.alias("decision"))
