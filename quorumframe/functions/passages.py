"""Passages of bilingual minutes: which are Spanish, which phrases they name, what to show of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.text import col, count_of, folded, words

#: Function words of the two languages, folded.
SPANISH = ("de", "la", "que", "el", "en", "y", "los", "las", "se", "por", "con", "para", "una", "del")
BASQUE = ("eta", "da", "ez", "du", "hau", "dela", "dira", "dugu", "ere", "bat", "izan", "dute", "zen", "baina")
#: Endings of Basque words, folded.
BASQUE_ENDINGS = ("aren", "aren", "ako", "etako", "ekin", "arekin", "tzen", "tzeko", "ketan", "rako", "eko", "ean", "etan", "tasuna", "ztea")
#: Words that join those of a name.
JOINING = ("de", "del", "la", "las", "los", "el", "y", "en")
#: Nouns that a named place or body begins with, folded.
HEADS = ("plaza", "calle", "avenida", "parque", "barrio", "plan", "programa", "centro", "mercado", "puente", "estacion", "colegio", "hospital", "museo", "teatro", "fundacion", "asociacion", "polideportivo", "biblioteca", "ordenanza", "ley", "proyecto")


def is_spanish(c: Column | str) -> Column:
    """Whether a passage has no Basque function words, or more than twice as many Spanish ones."""
    said = words(c)
    basque = count_of(said, BASQUE)
    return (basque == 0) | (count_of(said, SPANISH) > 2 * basque)


def is_basque_name(c: Column | str) -> Column:
    """Whether a word of a name is a Basque function word or ends as Basque words do."""
    said = words(c)
    return F.exists(said, lambda w: w.isin(*BASQUE) | (w.rlike(f"{any_of(BASQUE_ENDINGS)}$") & (F.length(w) > 5)))


def sentences(c: Column | str) -> Column:
    """Sentences of a passage in order: they end with . ! or ? before white space and a capital, or with a line break."""
    cut = F.split(F.regexp_replace(col(c), r"[ \t]+", " "), r"(?<=[.!?])\s+(?=[\p{Lu}¿¡\"“«])|\n+", -1)
    return F.filter(F.transform(cut, F.trim), lambda s: s != "")


def spanish_sentences(c: Column | str) -> Column:
    return F.filter(sentences(c), is_spanish)


def proper_phrases(c: Column | str) -> Column:
    """Names of two capitalised words or more, with the words that join them, distinct in text order."""
    name = r"\p{Lu}[\p{L}]+"
    begun = rf"(?!{any_of(w.capitalize() for w in JOINING)}\b)"  # a joining word that only begins a sentence
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(rf"(?<![\p{{L}}]){begun}({name}(?: (?:{any_of(JOINING)} )*{name})+)"), F.lit(2)))


def named_phrases(c: Column | str) -> Column:
    """Phrases that a noun such as street or plan begins and capitalised words go on, folded, distinct in text order."""
    flat = F.regexp_replace(col(c), r"\s+", " ")
    heads = any_of((*HEADS, "estación", "fundación", "asociación"))
    found = F.regexp_extract_all(flat, F.lit(rf"(?<![\p{{L}}])((?i:{heads})(?: (?:{any_of(JOINING)}))* \p{{Lu}}[\p{{L}}]+(?: (?:{any_of(JOINING)} )*\p{{Lu}}[\p{{L}}]+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, folded))


def literal_words(c: Column | str, stop: tuple[str, ...] = (), least: int = 4) -> Column:
    """Words to look for literally, as they are written: of so many letters, or acronyms in capitals; once each by their folded form."""
    each = F.filter(F.regexp_extract_all(col(c), F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.char_length(w) >= least) | w.rlike(r"^\p{Lu}{2,}$"))
    kept = F.filter(each, lambda w: ~folded(w).isin(*stop)) if stop else each
    plain = F.transform(kept, folded)
    return F.filter(kept, lambda w, k: F.array_position(plain, folded(w)) == k + 1)


def without_repeats(c: Column | str, separator: str = "\n\n", least: int = 0) -> Column:
    """Parts of a text without those that stood before, however they are spaced and cased; empty and short parts stay."""
    parts = F.split(col(c), separator, -1)
    plain = F.transform(parts, folded)
    kept = F.filter(parts, lambda p, k: (F.length(folded(p)) <= least) | (F.array_position(plain, folded(p)) == k + 1))
    return F.array_join(kept, separator)


def without_loops(c: Column | str) -> Column:
    """Text without lines of more than 25 letters that stood before, as models that loop repeat them."""
    return without_repeats(c, "\n", 25)


def without_empty_blocks(c: Column | str) -> Column:
    """Text without headings that nothing follows before the next heading."""
    return F.regexp_replace(col(c), r"(?m)^#+[^\n]*\n\s*(?=^#|\z)", "")


def highlights(c: Column | str, pattern: str, *, before: int = 200, after: int = 600, mark: str = " […] ") -> Column:
    """What stands around the hits of a pattern (without groups) in a text: so much before the first of each stretch and after it; null without a hit."""
    found = F.regexp_extract_all(col(c), F.lit(rf"(?s)(.{{0,{before}}}(?:{pattern}).{{0,{after}}})"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, mark))


def percent_text(c: Column | str) -> Column:
    """A share in percent with one decimal and a comma-free point, as in 12.5%."""
    return F.format_string("%.1f%%", col(c))


def as_list(c: Column | str) -> Column:
    """An array of texts from JSON that holds a list, or from a text that is one item; empty for null and empty texts."""
    c = col(c)
    parsed = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<string>")).when(F.ltrim(c).startswith("["), F.coalesce(parsed, F.array(c))).otherwise(F.array(c))


def repaired_json(c: Column | str) -> Column:
    """The JSON object in prose: from the first brace to the last, without code fences and commas before a closing sign; null if there is none."""
    inner = F.regexp_extract(F.regexp_replace(col(c), r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(inner != "", F.regexp_replace(inner, r",\s*([}\]])", "$1"))


def sort_day(c: Column | str) -> Column:
    """The date of a DD-MM-YYYY label to sort by; 1900-01-01 where there is none."""
    found = F.try_to_date(F.regexp_extract(col(c), r"(\d{2}-\d{2}-\d{4})", 1), "dd-MM-yyyy")
    return F.coalesce(found, F.lit("1900-01-01").cast("date"))


def document_key(source: Column | str, chunk_index: Column | str, text: Column | str) -> Column:
    """What makes a fragment one: its source and place, or the beginning of its text where it has none."""
    return F.concat_ws("|", col(source), F.coalesce(col(chunk_index).cast("string"), F.substring(col(text), 1, 50)))


def rerooted(path: Column | str, root: str) -> Column:
    """A path under another root: its last two parts, year and file."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -2))


def cut_label(c: Column | str, most: int = 70) -> Column:
    """A label of at most so many letters, cut at a word, with an ellipsis where it was cut."""
    c = F.trim(col(c))
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.rtrim(F.regexp_extract(c, rf"(?s)^(.{{1,{most - 1}}})(?=\s)", 1)), F.lit("…")))


#: What is said of an amendment's result, folded, and the result it stands for.
AMENDMENT_RESULTS = {"aprobada": ("aceptada", "aprobada", "admitida", "incorporada", "estimada"), "rechazada": ("rechazada", "desestimada", "no aceptada", "inadmitida"), "retirada": ("retirada",), "decae": ("decae", "decaida"), "transaccionada": ("transaccionada", "transaccional")}


def amendment_result(c: Column | str) -> Column:
    """The canonical result of an amendment, by the longest wording that it holds; null if it holds none."""
    said = F.regexp_substr(folded(c), F.lit(rf"\b{any_of(w for ws in AMENDMENT_RESULTS.values() for w in ws)}\b"))
    return F.create_map(*(F.lit(x) for name, ws in AMENDMENT_RESULTS.items() for w in ws for x in (w, name)))[said]


def is_heading(c: Column | str) -> Column:
    """Whether a title is only the heading of a section: a word or two in capitals, or a number without a title."""
    return col(c).rlike(r"^\W*(?:[IVXLC]+|\d+)?\W*$|^\W*\p{Lu}{4,}(?: \p{Lu}+)?\W*$")


def explicit_result(c: Column | str) -> Column:
    """The outcome of the first decision that settles a matter in a text; null if none does."""
    from quorumframe.functions.decisions import decisions

    return F.try_element_at(F.filter(decisions(c), lambda d: d["settled"] | (d["outcome"] == "decae")), F.lit(1))["outcome"]


def without_scan_noise(c: Column | str) -> Column:
    """A name as a scan should have read it: digits that look like letters are letters, signs inside words go, single letters join their word."""
    spelled = F.btrim(F.translate(col(c), "0158|", "OISBI"), F.lit(" .,;:-"))
    joined = F.regexp_replace(F.regexp_replace(spelled, r"(?<=\p{L})[._~^*]+(?=\p{L})", ""), r"(?<=\p{Lu}{2}) (?=\p{Lu}(?: |$))", "")
    return F.regexp_replace(joined, r"\s+", " ")


def citizen_entity(c: Column | str) -> Column:
    """Who of the citizens a title names: what stands in quotation marks, an organisation, a person; null if nobody."""
    from quorumframe.functions.submitters import private_submitter

    quoted = F.regexp_extract(col(c), r"[\"“«]([^\"”»]{3,90})[\"”»]", 1)
    return F.coalesce(F.when(quoted != "", quoted), private_submitter(c)["name"])


def relevant_source(shared: Column | str, single_date: Column | str, *, least: int = 4) -> Column:
    """Whether a source is shown: so many shared keywords where all sources are of one date, as all else would be; any one otherwise."""
    return F.when(col(single_date), col(shared) >= least).otherwise(col(shared) >= 1)
