"""Who submits a point: groups, the executive, citizens and their organisations, from title and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.minutes import UNKNOWN, group_mark, group_name, known_group, title_letters, title_phrase
from quorumframe.functions.text import bound, col, folded, without_spaces

EXECUTIVE = "EQUIPO DE GOBIERNO"

#: Words after which a text names the group that submits it, folded, without spaces.
CUES = ("presentaelgrupo", "presentanlosgrupos", "formulaelgrupo", "formulanlosgrupos", "presentadaporelgrupo", "presentadoporelgrupo", "presentadaporlosgrupos", "delgrupo", "delosgrupos")
#: Words before which it does.
CUES_AFTER = ("udaltalde",)
#: Names that mean a group wherever they stand, as words of folded text.
NAMES = ("eh bildu", "euskal herria bildu", "herri batasuna", "elkarrekin", "goazen", "ezker batua", "izquierda unida", "pse ee", "partido socialista", "sozialista abertzaleak", "grupo socialista", "eaj pnv", "partido nacionalista vasco", "partido popular", "grupo popular", "p p", "pp", "udalberri", "aralar", "vox", "equipo de gobierno", "gobierno municipal", "gorbernu taldea", "grupo mixto")
#: Names that are common words unless they are written with capitals, and what stands before them then.
CAPITAL_NAMES = {"ELKARREKIN BILBAO": r"\bBilbao en Com[uú]n\b", "CIUDADANOS": r"(?<=[\p{Ll},] )Ciudadanos\b|\bCIUDADANOS\b(?=.*\p{Ll})"}
#: Openings of titles that the executive submits, folded, without spaces.
EXECUTIVE_OPENINGS = ("propuesta", "proposamen", "laalcald", "medianteacuerdo", "mediantedecreto", "elareade", "elplenodelacorporacion", "elexcmoayuntamientopleno", "elexcelentisimoayuntamientopleno", "lajuntadegobierno", "elarticulo", "daciondecuenta")
#: Types of points, as title_phrase tells them, that nobody in the council submits.
NOBODYS = ("tramite", "proposicion_ciudadana", "informe_iniciativa", "enmienda_articulado")


def torn_pattern(word: str) -> str:
    """A pattern for a word that a scan may have torn apart anywhere."""
    return r"\s?".join(word)


def _named(c: Column) -> Column:
    """The group that a text names after or before a cue, else by a name that means no other thing, else by one with its capitals."""
    tight = without_spaces(F.regexp_replace(c, r"(?i)\bp\.\s?p\.?", "PP "))
    after = F.regexp_extract(tight, any_of(CUES) + r"(?:politicos?)?(?:municipal(?:es)?)?([^,;.]{2,60})", 2)
    before = F.regexp_extract(tight, rf"([^;.]{{3,60}}?){any_of(CUES_AFTER)}", 1)
    line = F.concat(F.lit(" "), F.regexp_replace(folded(c), "[^a-z0-9]+", " "), F.lit(" "))
    name = F.regexp_substr(line, F.lit(f" {any_of(NAMES)} "))
    capital = [F.when(c.rlike(pattern), group) for group, pattern in CAPITAL_NAMES.items()]
    found = [F.when(known_group(x) != UNKNOWN, known_group(x)) for x in (after, before)]
    return F.coalesce(*found, F.when(name.isNotNull(), known_group(F.trim(name))), *capital)


def submitting_group(title: Column | str, text: Column | str, *, upto: int = 900) -> Column:
    """The canonical group that submits a point, by its title first, then by the beginning of its text; unknown if nobody is named.

    Formalities and what citizens submit belong to no group, what is reported only to
    the executive if the report is its own.
    """
    title, body = F.coalesce(col(title), F.lit("")), F.substring(F.coalesce(col(text), F.lit("")), 1, upto)
    told, letters = title_phrase(title), title_letters(title)
    by_executive = F.regexp_replace(letters, "[^a-z]", "").rlike("^" + any_of(EXECUTIVE_OPENINGS))
    reported = F.when(group_mark(F.concat(title, F.lit(" "), body)).isin("ALCALD", "GOBIERNO", "EQUIPODEGOBIERNO", "GORBERNU") | letters.rlike("delega|ordenforal"), EXECUTIVE)
    return (
        F.when(told.isin("tramite", "informe_iniciativa") | ((told == "proposicion_ciudadana") & _named(title).isNull()), UNKNOWN)
        .when(told == "dacion_cuenta", F.coalesce(reported, F.lit(UNKNOWN)))
        .otherwise(F.coalesce(_named(title), _named(body), F.when(by_executive & ~F.coalesce(told.isin(*NOBODYS), F.lit(False)), EXECUTIVE), F.lit(UNKNOWN)))
    )


#: Words that a private submitter's name begins with or follows, and words that end it.
ORGANISATIONS = ("asociación", "asociacion", "ampa", "comunidad de propietarios", "plataforma", "federación", "federacion", "coordinadora", "fundación", "fundacion")
PERSONS = ("don", "doña", "dona")
NAME_ENDS = (",", r"\.", " mediante ", " para pedir ", " para solicitar ", " en la que ", " relativa a ", " denominada ", " en representación ", " en representacion ", " correspondiente ")
_CAPITAL_WORDS = r"^\p{Lu}[\p{L}.'-]+(?: \p{Lu}[\p{L}.'-]+){0,4}"


def private_submitter(title: Column | str) -> Column:
    """name and kind (organizacion or persona) of a private submitter; null if none is named or the name was blackened with #.

    An organisation's name goes from its kind to the next words that end it; a person's
    is made of the capitalised words after the title of courtesy.
    """
    cut = lambda c: F.btrim(F.regexp_replace(c, rf"(?s)(?:{'|'.join(NAME_ENDS)}).*", ""))
    named = lambda name, kind: bound(name, lambda n: F.when((n != "") & (F.length(n) <= 90) & ~n.contains("#"), F.struct(n.alias("name"), F.lit(kind).alias("kind"))))

    def either(flat: Column) -> Column:
        organisation = cut(F.regexp_extract(flat, rf"((?i:\b{any_of(ORGANISATIONS)} (?:de )?)[\p{{Lu}}0-9].*)", 1))
        person = F.regexp_extract(cut(F.regexp_extract(flat, rf"(?i:\b{any_of(PERSONS)} )(\p{{Lu}}.*)", 2)), _CAPITAL_WORDS, 0)
        return F.coalesce(named(organisation, "organizacion"), named(person, "persona"))

    return bound(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"\s+", " "), either)


def group_in_disguise(name: Column | str) -> Column:
    """Whether an entity's name is mostly that of a group: the word that names it covers over two fifths of it."""
    covered = F.length(group_mark(name)) / F.length(without_spaces(name))
    return F.coalesce((covered > 0.4) & (group_name(name) != UNKNOWN), F.lit(False))


def surname_variants(name: Column | str) -> Column:
    """Forms under which a person's surnames appear: all of them, the first, the last, the first two; from upper-case letters without accents."""
    words = F.split(F.upper(folded(name)), " ")
    own = F.slice(words, F.when(F.size(words) <= 3, 2).otherwise(3), F.size(words))
    forms = F.array(F.array_join(own, " "), F.element_at(own, 1), F.element_at(own, -1), F.array_join(F.slice(own, 1, 2), " "))
    return F.array_sort(F.array_distinct(F.filter(F.when(F.size(words) < 2, F.array(F.upper(folded(name)))).otherwise(forms), lambda f: F.length(f) >= 3)))
