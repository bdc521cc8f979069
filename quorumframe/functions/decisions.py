"""What minutes say was decided: verbs with their objects, and counts with their labels.

Vocabularies are plain words; patterns are put together from them. Counts are read
from text without any white space, so words that a scan tore apart do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumframe.functions.text import bound, col, folded, without_spaces

#: Folded words that decide, by what they decide, the most final first.
OUTCOMES = {
    "retirada": ("retirada", "retirado", "retiradas", "retirados"),
    "decae": ("decae", "decaen"),
    "rechazada": ("rechaza", "rechazan", "rechazada", "rechazado", "rechazadas", "rechazados", "desestima", "desestiman", "desestimada", "desestimado", "desestimadas", "desestimados", "deniega", "denegada", "denegadas"),
    "aprobada": ("aprueba", "aprueban", "aprobada", "aprobado", "aprobadas", "aprobados", "acepta", "aceptan", "aceptada", "aceptado", "aceptadas", "aceptados"),
}
#: Folded words for what is decided on.
OBJECTS = {
    "enmienda": ("enmienda", "enmiendas"),
    "por_puntos": ("punto", "puntos"),
    "punto": ("proposicion", "proposiciones", "propuesta", "propuestas", "mocion", "mociones", "iniciativa", "dictamen", "presupuesto", "proyecto", "acuerdo", "modificacion", "mozio", "mozioa", "proposamen", "proposamena"),
}
#: Words that show that a decision is taken, not only talked about.
SETTLED = ("queda", "quedan", "resulta", "resultan")
AGREED = ("unanimidad", "asentimiento")
#: Labels of counts, folded and without spaces.
LABELS = {"cast": ("emitidos",), "favour": ("afirmativos", "afavor"), "against": ("negativos", "encontra"), "abstain": ("abstenciones", "abstencion")}


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, the longest first."""
    return "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def meant(word: Column, table: dict[str, Iterable[str]]) -> Column:
    """The key of the table under which a word stands; null if none."""
    return F.create_map(*(F.lit(x) for key, words in table.items() for w in words for x in (w, key)))[word]


_VERB, _OBJECT = any_of(w for ws in OUTCOMES.values() for w in ws), any_of(w for ws in OBJECTS.values() for w in ws)
_CLAUSE = rf"\b(?:{any_of(SETTLED)} )?{_VERB}\b(?: (?:[a-z]+ ){{0,4}}?{_OBJECT}\b)?"


def decisions(c: Column | str) -> Column:
    """settled, outcome and object of each verb that decides, in text order; the object is the next one named within five words of the clause."""
    text = folded(F.coalesce(col(c), F.lit("")))
    settled, verb, of = (F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(k)) for k in (1, 2, 3))
    each = F.arrays_zip(settled.alias("s"), verb.alias("v"), of.alias("o"))
    return F.transform(each, lambda x: F.struct((x["s"] != "").alias("settled"), meant(x["v"], OUTCOMES).alias("outcome"), meant(x["o"], OBJECTS).alias("object")))


def final_decision(c: Column | str) -> Column:
    """The outcome that the text gives the point itself, the most final of several; null if it gives none.

    That anything lapses is said of the point, as an amendment lapses with it.
    """
    rank = {outcome: k for k, outcome in enumerate(reversed(OUTCOMES))}
    own = F.filter(decisions(c), lambda d: (d["object"] == "punto") | (d["outcome"] == "decae"))
    order = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    return F.array_max(F.transform(own, lambda d: F.struct(order[d["outcome"]].alias("rank"), d["outcome"].alias("outcome"))))["outcome"]


def count_labels(c: Column | str) -> Column:
    """label and number of each labelled count, in text order."""
    tight = without_spaces(F.coalesce(col(c), F.lit("")))
    pattern = any_of(w for ws in LABELS.values() for w in ws) + r"[:=.]?(\d+)"
    said, number = (F.regexp_extract_all(tight, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(said.alias("w"), number.alias("n")), lambda x: F.struct(meant(x["w"], LABELS).alias("label"), x["n"].try_cast("int").alias("number")))


def counts(c: Column | str) -> Column:
    """cast, favour, against, abstain of the last count that states the votes cast, or of any; null where the text does not say."""

    def of_last(every: Column) -> Column:
        last = F.array_position(F.reverse(F.transform(every, lambda x: x["label"])), F.lit("cast"))
        return F.when(last > 0, F.slice(every, F.size(every) - last.cast("int") + 1, last.cast("int"))).otherwise(every)

    def told(own: Column) -> Column:
        first = lambda label: F.try_element_at(F.filter(own, lambda x: x["label"] == label), F.lit(1))["number"]
        return F.struct(*(first(label).alias(label) for label in LABELS))

    return bound(bound(count_labels(c), of_last), told)
