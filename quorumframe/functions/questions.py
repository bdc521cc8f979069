"""What a question asks for, as column expressions over its text: dates, periods, results, groups, and the form of its answer.

The form is found by what the question shows: a form names the features that it needs,
and of those whose features are all there the one that needs most is meant.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.minutes import MONTHS
from quorumframe.functions.text import bound, col, folded, stem, words

#: The months that a season stands for.
SEASONS = {"primavera": (3, 4, 5, 6), "verano": (6, 7, 8, 9), "otono": (9, 10, 11, 12), "invierno": (12, 1, 2, 3)}


def day_of(c: Column | str) -> Column:
    """The day that a text names in words or digits; null if it names none, or one that does not exist."""
    text = folded(c)
    worded, dashed = rf"\b(\d{{1,2}}) de {any_of(MONTHS)} del? (\d{{4}})\b", r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b"
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, worded, 2)).cast("string")
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")
    in_words = date(F.regexp_extract(text, worded, 3), number, F.regexp_extract(text, worded, 1))
    return F.when(text.rlike(worded), in_words).when(text.rlike(dashed), date(*(F.regexp_extract(text, dashed, k) for k in (3, 2, 1))))


def months_of(c: Column | str) -> Column:
    """The months that a text names, by themselves or by their season, in order; "mayoria" is not May."""
    table = {name: (k,) for k, name in enumerate(MONTHS, 1)} | SEASONS
    named = F.regexp_extract_all(folded(c), F.lit(rf"\b{any_of(table)}\b"), F.lit(1))
    numbers = F.create_map(*(x for name, ms in table.items() for x in (F.lit(name), F.array(*map(F.lit, ms)))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda w: numbers[w]))))


def years_of(c: Column | str, first: int, last: int) -> Column:
    """The years that a text names, in order; a number well outside the collection's years is part of a name."""
    return bound(folded(c), lambda text: _years(text, first, last))


def _years(text: Column, first: int, last: int) -> Column:
    said = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.filter(F.transform(said, lambda y: y.cast("int")), lambda y: y.between(first - 1, last + 1))


#: Words before a year that say what it bounds, folded.
CUES = {
    "term": ("legislatura", "mandato", "corporacion"),
    "budget": ("presupuesto", "presupuestos"),
    "from": ("desde",),
    "to": ("hasta",),
    "between": ("entre", "de"),
}
#: What joins two years, and words that point at the present.
LINKS = ("y", "a", "hasta", "-", "/")
PRESENT = ("ahora", "actualmente", "actualidad", "hoy")
#: What a term of office is called that is the present one, before and after the noun.
THIS, NOT_THIS = ("esta", "este", "la", "el", "del", "actual", "presente"), ("anterior", "pasada", "pasado", "previa", "previo")
#: How far from its cue a year may stand, in words.
_REACH = {"budget": 4, "term": 1, "from": 1, "to": 1, "between": 1}
#: Kinds of mentions, the least telling first.
_KINDS = ("plain", "open", "span", "term", "budget")


def _mentions(text: Column) -> Column:
    """Years in text order: cue (what the word before says), year, link and other (the year that is joined to it, if any)."""
    cued = "|".join(rf"\b{any_of(words_)} (?:[a-z]+ ){{0,{_REACH[cue]}}}?" for cue, words_ in CUES.items())
    each = rf"(?:{cued})?\b(\d{{4}})\b(?:(?= ?{any_of(LINKS)} ?(?:el )?(\d{{4}})\b))?"
    groups = len(CUES)
    found = [F.regexp_extract_all(text, F.lit(each), F.lit(k)) for k in range(1, groups + 4)]
    zipped = F.arrays_zip(*(x.alias(f"g{k}") for k, x in enumerate(found)))

    def mention(m: Column) -> Column:
        cue = F.coalesce(*(F.when(m[f"g{k}"] != "", F.lit(name)) for k, name in enumerate(CUES)))
        return F.struct(cue.alias("cue"), m[f"g{groups}"].cast("int").alias("year"), m[f"g{groups + 1}"].alias("link"), m[f"g{groups + 2}"].try_cast("int").alias("other"))

    return F.transform(zipped, mention)


def period_of(c: Column | str, first: int, last: int, terms: Sequence[tuple[dt.date, dt.date | None]] = ()) -> Column:
    """since, until (years, inclusive), start, end (dates, half-open), compared and fiscal.

    Each year that a text mentions spans some time: itself, all up to or from it, all
    between it and the one joined to it, or a term of office. The most telling kind of
    mention counts, and plain years are taken together. Several single years, two that
    "and" joins, or a year and the present are compared. terms are in order, the last one
    open; a term is named by the year it begins in, alone or with the one it ends in, and
    without a year the present one is meant. A budget's year is not that of its session,
    so it is no period.
    """
    return bound(folded(c), lambda text: bound(F.struct(_mentions(text).alias("m"), text.alias("t")), lambda x: _period(x["m"], x["t"], first, last, terms)))


def _period(mentions: Column, text: Column, first: int, last: int, terms: Sequence[tuple[dt.date, dt.date | None]]) -> Column:
    within = lambda m: m["year"].between(first - 1, last + 1)
    known = {begun.year: (begun, ended) for begun, ended in terms}
    of_term = lambda m: (m["cue"] == "term") & m["year"].isin(*known) & (m["other"].isNull() | (m["other"] == m["year"] + 4)) if known else F.lit(False)
    kind = lambda m: (
        F.when(m["cue"] == "budget", "budget").when(of_term(m), "term").when(m["other"].isNotNull(), "span").when(within(m) & m["cue"].isin("from", "to"), "open").when(within(m), "plain")
    )
    rank = F.create_map(*(F.lit(x) for k, name in enumerate(_KINDS) for x in (name, k)))
    low = lambda m, k: F.when(k == "span", F.least(m["year"], m["other"])).when((k == "open") & (m["cue"] == "to"), F.lit(first)).otherwise(m["year"])
    high = lambda m, k: F.when(k == "span", F.greatest(m["year"], m["other"])).when((k == "open") & (m["cue"] == "from"), F.lit(last)).when(k == "term", m["year"] + 4).otherwise(m["year"])
    spans = F.filter(F.transform(mentions, lambda m: bound(kind(m), lambda k: F.struct(rank[k].alias("rank"), k.alias("kind"), low(m, k).alias("low"), high(m, k).alias("high"), m["year"].alias("year"), ((k == "span") & (m["link"] == "y") & m["cue"].isNull()).alias("apart")))), lambda x: x["kind"].isNotNull())
    office, now = any_of(CUES["term"]), text.rlike(rf"\b{any_of(PRESENT)}\b")
    present = text.rlike(rf"\b{any_of(THIS)} {office}\b(?! {any_of(NOT_THIS)})")

    def date_of(year: Column, which: int) -> Column:
        dates = [F.when(year == y, F.lit(pair[which])) for y, pair in known.items() if pair[which] is not None]
        return F.coalesce(F.lit(None).cast("date"), *dates)

    def told(own: Column) -> Column:
        best = F.array_max(F.transform(own, lambda x: x["rank"]))
        chosen = F.filter(own, lambda x: x["rank"] == best)
        plain, head = chosen[0]["kind"] == "plain", chosen[0]
        since = F.when(plain, F.array_min(F.transform(chosen, lambda x: x["low"]))).otherwise(head["low"])
        until = F.when(plain, F.array_max(F.transform(chosen, lambda x: x["high"]))).otherwise(head["high"])
        several = (plain & (F.size(F.array_distinct(F.transform(chosen, lambda x: x["year"]))) > 1)) | head["apart"]
        budget, term = head["kind"] == "budget", head["kind"] == "term"
        return F.struct(
            F.when(~budget, since).alias("since"), F.when(~budget, until).alias("until"),
            F.when(term, date_of(head["year"], 0)).alias("start"), F.when(term, date_of(head["year"], 1)).alias("end"),
            (~budget & (several | now)).alias("compared"), F.when(budget, head["year"]).alias("fiscal"),
        )

    null = lambda kind_: F.lit(None).cast(kind_)
    begun = F.lit(terms[-1][0]) if terms else null("date")
    holds = present & F.lit(bool(terms))
    otherwise = F.struct(F.when(holds, F.year(begun)).alias("since"), F.when(holds, F.lit(last)).alias("until"), F.when(holds, begun).alias("start"), null("date").alias("end"), F.lit(False).alias("compared"), null("int").alias("fiscal"))
    return bound(spans, lambda own: F.when(F.size(own) > 0, told(own)).otherwise(otherwise))


#: Openings of words that ask for a year's budget, and how many months before the year it is voted in.
BUDGET_STEMS, BUDGET_MONTHS = ("presupuest", "ejercicio"), 3


def session_months(c: Column | str, first: int, last: int) -> Column:
    """year and month of all sessions that a question may mean; empty if it names no year.

    Months are counted through from year to year. A day means its month, should there
    have been no session on it; a year means those of its months that are named, or all
    of them, then from as many months before as its budget is voted ahead, if that is
    asked for.
    """
    told = F.struct(day_of(c).alias("day"), months_of(c).alias("months"), F.try_element_at(years_of(c, first, last), F.lit(1)).alias("year"), folded(c).rlike(any_of(BUDGET_STEMS)).alias("budget"))
    return bound(told, _session_months)  # what is read from the text is read once, not for each month


def _session_months(told: Column) -> Column:
    day, months, year = told["day"], told["months"], told["year"]
    every = F.size(months) == 0
    ahead = F.when(every & told["budget"], F.lit(BUDGET_MONTHS)).otherwise(F.lit(0))
    of_day = F.year(day) * 12 + F.month(day) - 1
    begin, end = F.coalesce(of_day, year * 12 - ahead), F.coalesce(of_day, year * 12 + 11)
    through = F.coalesce(F.sequence(begin, end), F.array().cast("array<int>"))
    meant_ = F.filter(through, lambda n: day.isNotNull() | every | F.array_contains(months, n % 12 + 1))
    return F.transform(meant_, lambda n: F.struct(F.floor(n / 12).cast("int").alias("year"), (n % 12 + 1).cast("int").alias("month")))


#: Openings of folded words that ask for a result: those that end a point without a vote, and those of votes.
RESULT_STEMS = ({"decae": ("decae", "decaid", "decayer"), "retirada": ("retirad",)}, {"rechazada": ("rechaz",), "aprobada": ("aprob",)})


def result_asked(c: Column | str) -> Column:
    """The result that a question filters by; null if it asks for none, or which of two it was.

    What ends a point without a vote says more than what its vote was.
    """
    text = folded(c)
    said = [F.array_compact(F.array(*(F.when(text.rlike(rf"\b{any_of(stems)}"), F.lit(name)) for name, stems in kind.items()))) for kind in RESULT_STEMS]
    told = F.try_element_at(F.filter(F.array(*said), lambda names: F.size(names) > 0), F.lit(1))
    return F.when(F.size(told) == 1, told[0])


#: How questions call the groups, as words of folded text.
GROUP_WORDS = {
    "ARALAR": ("aralar",),
    "EAJ-PNV": ("eaj pnv", "pnv", "nacionalista vasco", "nacionalistas vascos"),
    "EH BILDU": ("eh bildu", "bildu"),
    "ELKARREKIN BILBAO": ("elkarrekin",),
    "EQUIPO DE GOBIERNO": ("equipo de gobierno", "gobierno municipal"),
    "EZKER BATUA-IU": ("ezker batua", "izquierda unida"),
    "GOAZEN BILBAO": ("goazen",),
    "GRUPO MIXTO": ("grupo mixto",),
    "PP": ("partido popular", "pp", "los populares", "las populares"),
    "PSE-EE": ("pse ee", "pse", "psoe", "socialista", "socialistas"),
    "UDALBERRI": ("udalberri", "bilbao en comun"),
    "VOX": ("vox",),
}
#: Groups that one word names together.
SHARED_WORDS = {r" podemos (?![a-z]+[aei]r )": ("ELKARREKIN BILBAO", "UDALBERRI")}
_MOTION = r" (?:mocion|propuesta|proposicion|iniciativa)(?:es)? (?:que presento |presentadas? por |de )(?:el |la |los )?(?:grupo )?(?:municipal )?"


def _line(c: Column | str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", " "), r"\bdel\b", "de el")), F.lit(" "))


def groups_of(c: Column | str) -> Column:
    """The groups that a question names, in the order of their names; common words count only as they are used for a group."""

    def named(line: Column) -> Column:
        each = [F.when(line.rlike(f" {any_of(said)} "), F.array(F.lit(name))) for name, said in GROUP_WORDS.items()]
        each += [F.when(line.rlike(pattern), F.array(*map(F.lit, names))) for pattern, names in SHARED_WORDS.items()]
        return F.flatten(F.array_compact(F.array(*each)))

    capital = F.when(col(c).rlike(r"\b(?:Ciudadanos|Cs)\b"), F.array(F.lit("CIUDADANOS"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(bound(_line(c), named), capital)))


def submitters_of(c: Column | str) -> Column:
    """Those of the groups that a question names as submitting a motion; the others are those it asks the votes of."""

    def after(line: Column) -> Column:
        return F.array_compact(F.array(*(F.when(line.rlike(rf"{_MOTION}{any_of(said)} "), F.lit(name)) for name, said in GROUP_WORDS.items())))

    return F.array_sort(bound(_line(c), after))


#: What a question may show, as patterns over its folded words; "asks" is the noun that its question word asks for.
_ASKED = r"^(?: y| pero)? (?:en |a |de |por )?(?:que|cual|cuales)(?: ha sido| fue| es| son| fueron)?(?: el| la| los| las)?(?: dos| tres| cinco| diez)? "
FEATURES = {
    "asks group": _ASKED + any_of(("grupo", "grupos", "partido", "partidos")) + " ",
    "asks submitter": _ASKED + any_of(("asociacion", "asociaciones", "colectivo", "colectivos", "entidad", "entidades", "plataforma", "plataformas", "organizacion", "organizaciones")) + " ",
    "asks place": _ASKED + any_of(("barrio", "barrios")) + " ",
    "asks district": _ASKED + any_of(("distrito", "distritos")) + " ",
    "asks session": _ASKED + any_of(("pleno", "sesion")) + " ",
    "asks term": _ASKED + any_of(("legislatura", "mandato")) + " ",
    "asks year": _ASKED + "ano ",
    "asks theme": _ASKED + any_of(("tema", "temas", "asunto")) + " ",
    "asks points": _ASKED + any_of(("propuestas", "mociones", "proposiciones", "iniciativas")) + " ",
    "asks person": r"^ (?:quien|quienes|que (?:concejal|concejala|orador|oradora|persona))s? ",
    "asks how": " como ",
    "asks when or what": "^ (?:cuando|cual|que) ",
    "asks amount": " (?:cuanto dinero|importe|importes|cuanto costo|cuanto cuesta|cuantia|partida presupuestaria) | euros? ",
    "counts": "^ (?:en )?cuant[oa]s ",
    "counts part": " y cuant[oa]s ",
    "of sessions": " (?:plenos|sesiones) (?:hubo|se|ha|han|ordinari|extraordinari|urgente)|^ cuant[oa]s (?:plenos|sesiones) ",
    "first session": " (?:primer pleno|primera sesion) ",
    "most": " (?:mas|menos|mayor|menor|mejor|peor) ",
    "spoke": " (?:interven|intervin|habl)[a-z]*",
    "speeches counted": " cuant[oa]s (?:veces |intervenciones |debates ).*(?:interven|intervin|habl)?",
    "voted": " vot(?:o|aron|ado|aba|os|aciones|acion|ar) ",
    "signed": " firm(?:ado|o|aron|ada) ",
    "amendments": " enmiendas? ",
    "by group": " (?:cada (?:grupo|partido)|por (?:grupo|grupos|partido|partidos)) ",
    "by year": " (?:cada ano|por ano|por anos|a lo largo de los anos|evolucion) ",
    "share": " (?:porcentaje|proporcion|tasa) ",
    "latest": " ultim[oa]s? | mas reciente ",
    "any": "^ (?:se ha|se han|ha habido|hay|han|existe|consta) | alguna vez ",
    "said": "^ que .*(?:opin|dijo|dijeron|coment|debati|postura|penso)",
}
#: The features that a form needs; none is a part of another's with the same size, so at most one needs most.
NEEDS = {
    "rank_group_speeches": ("asks group", "most", "spoke"),
    "rank_speaker": ("asks person", "most", "spoke"),
    "count_speeches": ("counts", "spoke"),
    "sessions": ("counts", "of sessions"),
    "votes": ("asks how", "voted"),
    "group_votes": ("asks group", "voted"),
    "person_votes": ("asks person", "most", "voted"),
    "rank_signers": ("asks person", "most", "signed"),
    "rank_group": ("asks group", "most"),
    "rank_amendments": ("asks group", "most", "amendments"),
    "count_amendments": ("counts", "amendments"),
    "rank_person": ("asks submitter", "most"),
    "rank_place": ("asks place", "most"),
    "rank_district": ("asks district", "most"),
    "rank_session": ("asks session", "most"),
    "rank_term": ("asks term", "most"),
    "rank_year": ("asks year", "most"),
    "theme_extreme": ("asks theme", "most"),
    "first_session": ("first session",),
    "breakdown_group": ("by group", "counts"),
    "trend_year": ("by year", "counts"),
    "ratio": ("share",),
    "ratio_groups": ("share", "asks group", "most"),
    "amounts": ("asks amount",),
    "last": ("latest", "asks when or what"),
    "count": ("counts",),
    "list": ("asks points",),
    "exists": ("any",),
    "contents": ("said", "asks when or what"),
}
#: Features that turn a count into a ratio of those with a result.
_PARTS = {"ratio": ("counts", "counts part")}


def form_of(c: Column | str) -> Column:
    """The form of answer that a question asks for; null if it shows none."""

    def shown(line: Column) -> Column:
        return F.array_compact(F.array(*(F.when(line.rlike(pattern), F.lit(name)) for name, pattern in FEATURES.items())))

    def meant(features: Column) -> Column:
        fits = lambda needs: F.size(F.array_intersect(features, F.array(*map(F.lit, needs)))) == len(needs)
        forms = [F.when(fits(needs), F.struct(F.lit(len(needs)).alias("n"), F.lit(form).alias("form"))) for table in (NEEDS, _PARTS) for form, needs in table.items()]
        return F.array_max(F.array_compact(F.array(*forms)))["form"]

    return bound(bound(_line(c), shown), meant)


#: Folded words that set a condition, and openings of words that tell of attendance.
CONDITIONS = {"latest": ("ultima", "ultimo", "ultimas", "ultimos", "reciente", "recientemente"), "unanimous": ("unanimidad", "unanime", "unanimes"), "opposition": ("oposicion",)}
ATTENDANCE = ("falt", "ausen", "asisten", "acudi")
CITIZENS = ("vecinal", "vecinales", "ciudadana", "ciudadanas", "vecino", "vecinos", "vecina", "vecinas", "vecindario", "asociacion", "asociaciones", "ciudadanos", "ciudadania")
_INITIATIVES = ("proposicion", "proposiciones", "iniciativa", "iniciativas", "presentada", "presentadas", "presentado", "presentados")


def _any_word(said: Column, table: Sequence[str]) -> Column:
    return F.arrays_overlap(said, F.array(*map(F.lit, table)))


def flags_of(c: Column | str) -> Column:
    """Further conditions of a question: latest, unanimous, opposition, by citizens, and what is out of scope (amounts, attendance)."""
    return bound(_line(c), lambda line: bound(F.split(F.btrim(line), " "), lambda said: _flags(line, said)))


def _flags(line: Column, said: Column) -> Column:
    """An initiative is of citizens if one of the next two words beside articles and "por" says so."""
    bare = F.filter(said, lambda w: ~w.isin("por", "el", "la", "los", "las", "de", "una", "un"))
    of_citizens = F.exists(F.transform(bare, lambda w, k: w.isin(*_INITIATIVES) & _any_word(F.slice(bare, k + 2, F.lit(1)), CITIZENS)), lambda x: x)
    return F.struct(
        *(_any_word(said, table).alias(name) for name, table in CONDITIONS.items()),
        of_citizens.alias("by_citizens"),
        F.when(line.rlike(FEATURES["asks amount"]), "importes").when(F.exists(said, lambda w: w.rlike(f"^{any_of(ATTENDANCE)}")), "asistencia").alias("out_of_scope"),
    )


#: Words of questions that say nothing of their subject, folded.
QUESTION_WORDS = tuple(
    "cuantas cuantos cuanto cuanta cual cuales quien quienes como cuando donde sobre total todas todos desde hasta entre durante tiene tienen tenido hubo habido este esta estos estas cada alguna vez mas menos mejor "
    "proposicion proposiciones propuesta propuestas mocion mociones iniciativa iniciativas pleno plenos sesion sesiones grupo grupos partido partidos municipal municipales politico ayuntamiento bilbao concejal concejala alcalde barrio barrios distrito distritos tema temas asunto enmienda enmiendas "
    "presento presentado presentaron presentadas presentada aprobo aprobado aprobaron aprobada aprobadas rechazo rechazado rechazaron rechazada rechazadas retirada retiradas decae voto votado votaron votos vota hablado habla hablo hablaron intervenido intervino intervenciones debatido debatio trato tratado firmado "
    "ultima ultimo ultimas ultimos reciente recientemente porcentaje proporcion tasa legislatura mandato presupuesto presupuestos ejercicio contra favor unanimidad oposicion gobierno equipo incluyendo subtemas".split()
)


def subject_words(c: Column | str, covered: Column | None = None) -> Column:
    """Stems of the words that tell what a question is about, in order: without question words, months and what covered (stems) already says."""
    stops = (*QUESTION_WORDS, *MONTHS, *SEASONS, *(w for said in GROUP_WORDS.values() for phrase in said for w in phrase.split()))
    said = F.transform(F.filter(words(c, 4), lambda w: ~w.isin(*stops)), stem)
    return F.array_distinct(said if covered is None else F.array_except(said, covered))
