"""What the functions read out of texts, over texts that are written from the columns of orders and parts.

A text has slots that columns fill, so each row's differs in what is to be read: days,
amounts, counts, names and things. The SQL fills the slots of what each text holds from
the same columns by its own rules. Functions of whole texts read the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumframe.functions import agenda as A
from quorumframe.functions import decisions as D
from quorumframe.functions import minutes as M
from quorumframe.functions import passages as P
from quorumframe.functions import questions as Q
from quorumframe.functions import submitters as S
from quorumframe.functions import text as T
from quorumframe.functions import votes as V
from quorumframe.registry import query, read
from quorumframe.storage import spread


#: Slots by what fills them, in Spark and in SQL.
_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
SLOTS: dict[str, tuple[Callable[[], Column], str]] = {
    "k": (lambda: F.col("o_orderkey").cast("string"), "CAST(o_orderkey AS VARCHAR)"),
    "n": (lambda: (F.col("o_custkey") % 57 + 30).cast("string"), "CAST(o_custkey % 57 + 30 AS VARCHAR)"),
    "a": (lambda: (F.col("o_custkey") % 13 + 16).cast("string"), "CAST(o_custkey % 13 + 16 AS VARCHAR)"),
    "b": (lambda: (F.col("o_orderkey") % 9 + 1).cast("string"), "CAST(o_orderkey % 9 + 1 AS VARCHAR)"),
    "d": (lambda: F.dayofmonth("o_orderdate").cast("string"), "CAST(day(o_orderdate) AS VARCHAR)"),
    "mes": (lambda: F.element_at(F.array(*map(F.lit, _MONTHS)), F.month("o_orderdate")), f"(ARRAY{list(_MONTHS)})[month(o_orderdate)]"),
    "y": (lambda: F.year("o_orderdate").cast("string"), "CAST(year(o_orderdate) AS VARCHAR)"),
    "iso": (lambda: F.date_format("o_orderdate", "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    "dmy": (lambda: F.date_format("o_orderdate", "dd-MM-yyyy"), "strftime(o_orderdate, '%d-%m-%Y')"),
    "eur": (lambda: F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), "translate(format('{:,.2f}', o_totalprice), ',.', '.,')"),
    "dec": (lambda: F.format_string("%.2f", "o_totalprice"), "printf('%.2f', o_totalprice)"),
    "who": (lambda: F.initcap("p_name"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    "cosa": (lambda: F.col("p_name"), "p_name"),
    "uno": (lambda: F.split_part("p_name", F.lit(" "), F.lit(1)), "split_part(p_name, ' ', 1)"),
    "dos": (lambda: F.split_part("p_name", F.lit(" "), F.lit(2)), "split_part(p_name, ' ', 2)"),
}


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _filled(template: str | None) -> Column:
    """A text with its slots filled from the columns."""
    if template is None:
        return F.lit(None).cast("string")
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(F.lit(""), *(SLOTS[x][0]() if k % 2 else F.lit(x) for k, x in enumerate(pieces) if x))


def _filled_sql(template: str | None) -> str:
    if template is None:
        return "NULL"
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(["''", *(SLOTS[x][1] if k % 2 else _sql(x) for k, x in enumerate(pieces) if x)])


def reading(name: str, build: Callable[[Column], Column], cases: Sequence[tuple[str | None, str | None]]) -> None:
    """Registers a query of o_orderkey and value: what build makes of a text about each order and its part, as a string."""
    rules = " ".join(f"WHEN {k} THEN {_filled_sql(value)}" for k, (_, value) in enumerate(cases))
    sql = f"SELECT o_orderkey, CASE o_orderkey % {len(cases)} {rules} END AS value FROM orders JOIN part ON p_partkey = o_custkey"

    def run(spark, folder):
        text = F.when(F.lit(False), F.lit(None).cast("string"))
        for k, (template, _) in enumerate(cases):
            text = text.when(F.col("o_orderkey") % len(cases) == k, _filled(template))
        rows = read(spark, folder, "orders").join(read(spark, folder, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("o_custkey"))
        return rows.select("o_orderkey", T.bound(text, lambda c: build(c)).alias("value"))

    query(name, sql)(run)


def _joined(c: Column, separator: str = "|") -> Column:
    """An array as a string, null for null."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def _fields(*names: str) -> Callable[[Column], Column]:
    """Fields of a struct as a string, a dash for each null."""
    return lambda c: T.bound(c, lambda x: F.concat_ws("|", *(F.coalesce(x[n].cast("string"), F.lit("-")) for n in names)))


reading("read_groups", M.group_name, [("GANEMOS ({cosa})", "GOAZEN BILBAO"), ("Grupo BIL DU", "EH BILDU"), ("Grupo Municipal P P", "PP"), ("Sozialista Abertzaleak", "PSE-EE"), ("Udalberri - Bilbao en Común", "UDALBERRI"), ("Vecinos {who}", "Vecinos {who}"), (" ", "Desconocido"), (None, "Desconocido"), ("Izquierda  Unida", "EZKER BATUA-IU")])
reading("read_known_groups", M.known_group, [("los ciudadanos de {who} piden", "CIUDADANOS"), ("Vecinos {who}", "Desconocido"), ("E A J - P N V", "EAJ-PNV"), ("la Alcaldía", "EQUIPO DE GOBIERNO")])
reading("read_results", M.result_name, [("Desestimación de {cosa}", "rechazada"), ("aprobada inicialmente con condiciones", "aprobada"), ("Decayó", "decae"), ("Ez onartua", "rechazada"), ("Retirada", "retirada"), ("{k}", "sin resultado"), (None, "sin resultado")])
reading("read_crossed_results", lambda c: M.crossed_result(c, F.lit("rechazada")), [("queda retirada la proposición de {cosa} del {dmy}, por lo que decae la enmienda", "retirada"), ("se aprueba la enmienda y decae la proposición", "decae"), ("se aprueba la proposición", "aprobada"), ("otra cosa, {cosa}", "rechazada"), (None, "rechazada")])
reading("read_decisions", lambda c: _joined(F.transform(D.decisions(c), lambda d: F.concat_ws(" ", d["outcome"], d["object"]))), [("Queda rechazada la enmienda {k} de {who}, y se aprueba por unanimidad la proposición; decae el resto.", "rechazada enmienda|aprobada punto|decae"), ("nada", ""), ("resultan aprobados los puntos {b} y {n}", "aprobada por_puntos")])
reading("read_tallies", lambda c: _fields("cast", "favour", "against", "abstain")(M.tally(c)), [("Votos emitidos: {n} | a favor: {a}, en contra: {b}, abstenciones: 3", "{n}|{a}|{b}|3"), ("unanimidad", "-|-|-|-"), ("votos emi tidos: 5, votos afirmati vos: 5. Votos emitidos: {n}, votos negativos: {b}", "{n}|-|{b}|-")])
reading("read_tally_subjects", M.tally_subject, [("queda aceptada la enmienda de {who} (Votos emitidos: {n}", "enmienda"), ("se aprueba la moción (votos emitidos: 2", "proposicion"), ("{cosa}. Votos emitidos: {n}", None)])
reading("read_recovered_results", lambda c: _fields("result", "source")(M.recovered_result(c, F.lit(False))), [("Votos emitidos: 29 | a favor: 19, en contra: 7, abstenciones: 3", "aprobada|recuento"), ("Votos emitidos: 29 | a favor: 19, en contra: 7", "-|-"), ("Se rechaza la proposición de {cosa} (votos emitidos: {n})", "rechazada|votoTexto"), ("votos emitidos: 9, a favor: 4, en contra: 5", "rechazada|recuento")])
reading("read_amounts", lambda c: _joined(M.amounts(c)), [("gastos de {eur} € y 2.000 € en {cosa}", "{dec}|2000.00"), ("{d} euros por {cosa}", ""), ("en {k} pasos", ""), ("el {d} de {mes} de {y} se pagaron {eur} euros", "{dec}")])
reading("read_main_amounts", lambda c: M.main_amount(c).cast("string"), [("un gasto de 1.200 euros y otro por importe de {eur} € y 9.300.000 €", "{dec}"), ("gastos de {eur} € y 120 €", "{dec}"), ("la moción {k} del {dmy}", None)])
reading("read_beneficiaries", M.beneficiary, [("subvención a favor de la Asociación {who} Vecinal, por importe de {eur} €", "Asociación {who} Vecinal"), ("subvención directa al {who} Club para obras", "{who} Club"), ("a favor de nadie, x", None), ("nada", None)])
reading("read_submission_dates", lambda c: M.submitted_on(c, F.lit(2021)).cast("string"), [("Proposición {k} de fecha {d} de {mes} de {y}", "{iso}"), ("presentada el 31 de febrero por {who}", None), ("presentada el día 3 de marzo por {who}", "2021-03-03"), ("{cosa}", None)])
reading("read_point_types", lambda c: M.point_type(c, F.lit("Desconocido")), [("INICIATIVA VECINAL presentada por {who}", "proposicion_ciudadana"), ("{k}. Preguntas orales", "pregunta"), ("Proposición de fecha {d} de {mes} de {y} presentada por {who}", "informe_iniciativa"), ("Se da cuenta del informe de {cosa}", "dacion_cuenta"), ("A probar el a cta de la sesión", "tramite"), ("Toma de conocimiento de la renuncia", "tramite"), ("Dictamen sobre la ordenanza", "propuesta_gobierno"), ("Otros {cosa}", "otro"), (None, "otro")])
reading("read_group_points", lambda c: M.point_type(c, F.lit("PP")), [("{k}. Proposición que presenta el Grupo Municipal X", "proposicion_grupo"), ("Moción sobre {cosa}", "proposicion_grupo"), ("Propuesta de enmienda número {k}", "enmienda_articulado"), ("Cosas", "propuesta_gobierno")])
reading("read_speakers", M.speaker_key, [("SRA. {who}", "{uno}{dos}"), ("SR. ALCALDE", "alcalde"), ("ALKATE JN.", "alcalde"), ("SR. SECRETARIO GENERAL", "secretario"), ("SRES. GIL Y SÁEZ", "gilysaez")])
reading("read_junk_entities", lambda c: M.is_junk_entity(c, own_names=["Ayuntamiento de {k}"]).cast("string"), [("los servicios", "true"), ("a. t. e.", "true"), ("Asociación de Vecinos {who}", "false"), ("Área", "true"), ("bcdf {k}", "true")])
reading("read_entity_keys", M.entity_key, [("Construcciones {who} {k}, S.A.", "construcciones_{uno}_{dos}_{k}"), ("Ría {k}", "ria_{k}"), ("Obras, S. Coop., S.L.", "obras")])
reading("read_name_lists", lambda c: _joined(M.named_list(c)), [("Ana Ruiz, {who} y Jon Sáez", "Ana Ruiz|{who}|Jon Sáez"), ("{k}; el resto; Eva  Mora", "Eva Mora"), ("", "")])
reading("read_declared_lists", lambda c: F.concat(_joined(M.declared_list(c, "Votos a favor")["names"]), F.lit("|"), M.declared_list(c, "Votos a favor")["agrees"].cast("string")), [("Votos a favor: 3: Ana Ruiz, {who} y Jon Sáez. Otros {k}", "Ana Ruiz|{who}|Jon Sáez|true"), ("Votos a favor: 5: Ana Ruiz y Luis Gil. x", "Ana Ruiz|Luis Gil|false"), ("Votos a favor: 1: Ana Ruiz, Luis Gil y Jon Sáez. x", "Ana Ruiz|true")])
reading("read_submitting_groups", lambda c: S.submitting_group(c, F.lit("")), [("{k}. Proposición que presenta el Grupo Municipal EH BIL DU, cuya parte", "EH BILDU"), ("Proposición que p resenta el g rupo municipal Partido Popular. x", "PP"), ("4. Proposición vecinal de {who}", "Desconocido"), ("-5- Se da cuenta de la resolución de Alcaldía", "EQUIPO DE GOBIERNO"), ("-5- Se da cuenta de otra cosa", "Desconocido"), ("Propuesta de aprobación de {cosa}", "EQUIPO DE GOBIERNO"), ("EAJ-PNV udal taldeak aurkezten duen proposizioa", "EAJ-PNV"), ("Moción de VOX sobre {cosa}", "VOX"), ("los ciudadanos piden", "Desconocido"), ("Moción de Ciudadanos sobre el empleo", "CIUDADANOS"), (None, "Desconocido")])
reading("read_submitters_of_texts", lambda c: S.submitting_group(F.lit("Proposición"), c), [("que presenta el Grupo Municipal Socialista, por {cosa}", "PSE-EE"), ("de nadie, {cosa}", "Desconocido")])
reading("read_private_submitters", lambda c: T.bound(S.private_submitter(c), lambda x: F.when(x.isNotNull(), _fields("name", "kind")(x))), [("Proposición de la Asociación Vecinal {who}, para pedir", "Asociación Vecinal {who}|organizacion"), ("presentada por don Juan {who} mediante escrito", "Juan {who}|persona"), ("presentada por doña ##### , x", None), ("nada", None)])
reading("read_disguised_groups", lambda c: S.group_in_disguise(c).cast("string"), [("Grupo PARTIDO POPULAR", "true"), ("Asociación de amigos del partido popular de aquí", "false"), ("Ría {who}", "false")])
reading("read_surnames", lambda c: _joined(S.surname_variants(c)), [("Ana Ruiz Bujedo", "BUJEDO|RUIZ|RUIZ BUJEDO"), ("María Luisa Gil De Sáez", "GIL|GIL DE|GIL DE SAEZ|SAEZ"), ("Ana", "ANA")])
reading("read_torn_words", lambda c: c.rlike(S.torn_pattern("proposición")).cast("string"), [("la propo sición de {cosa}", "true"), ("la p roposició n del {dmy}", "true"), ("la proposi-ción de {cosa}", "false")])
reading("read_result_texts", V.result_text, [("Votos emitidos: 5 x Votos afirmativos: 5 y más. Votos emitidos: {n} y Votos afirmativos: {a} y Votos negativos: {b}. Queda rechazada la\n proposición de {cosa} --- pie. Fin", "Queda rechazada la proposición de {cosa} (Votos emitidos: {n} | a favor: {a}, en contra: {b})"), ("se aprueba la propuesta citada en el debate", None), ("Antes de todo, queda aprobada la moción {k} de {who}. x", "queda aprobada la moción {k} de {who}"), ("El Pleno Municipal acuerda por unanimidad lo dicho el {d} de {mes}. x", "El Pleno Municipal acuerda por unanimidad lo dicho el {d} de {mes}"), ("nada", None)])
reading("read_vote_objects", V.vote_object, [("la enmienda de {who} a la moción", "enmienda"), ("la proposición de {cosa} con su enmienda", "punto"), ("los puntos {b} y {n}", "por_puntos"), ("{cosa}", "otro")])
reading("read_seats", lambda c: _joined(A.present(c, ("perez",))), [("Asisten D. Juan Pérez Gil, Dña. Ana {who} y D. Luis de la Torre Sáez.", "Ana {who}|Luis de la Torre Sáez"), ("{k}", "")])
reading("read_only_points", A.only_point_title, [("Orden del día: ÚNICO PUNTO: Debate sobre {cosa} en la ría {k}. Fin", "Debate sobre {cosa} en la ría {k}"), ("nada", None)])
reading("read_sessions_of_files", lambda c: _fields("date", "kind")(A.session_of(c)), [("{dmy} extraordinaria.pdf", "{iso}|extraordinary"), ("{iso} sesión constitutiva.pdf", "{iso}|constitutive"), ("{dmy} {cosa}.pdf", "{iso}|ordinary"), ("31-02-2019 {k}.pdf", "-|ordinary")])
reading("read_titles", A.point_title, [("7.- Moción {k} sobre\nla {cosa}. Se debate", "Moción {k} sobre la {cosa}"), ("PUNTO 3.- Ruegos\n\nNo hay", "Ruegos")])
reading("read_label_dates", lambda c: T.date_of_label(c).cast("string"), [("acta {dmy} {cosa}.pdf", "{iso}"), ("31-02-{y}", None), ("{iso}", None), ("{k}", None)])
reading("read_sort_days", lambda c: P.sort_day(c).cast("string"), [("acta {dmy} {cosa}.pdf", "{iso}"), ("31-02-{y} {k}", "1900-01-01"), (None, "1900-01-01")])
reading("read_heads_and_tails", lambda c: T.head_and_tail(c, 3, 2, "~"), [("abc{cosa}gh", "abc~gh"), ("{d}", "{d}"), (None, None)])
reading("read_source_urls", lambda c: T.source_url(F.lit(2020), c, F.lit(7)), [("{uno} {dos} {dmy}.pdf", "/acta/2020/{uno}%20{dos}%20{dmy}.pdf#page=7"), ("ñ.pdf", "/acta/2020/%C3%B1.pdf#page=7")])
reading("read_page_ranges", lambda c: T.page_range(c, F.lit("7")), [("7", "7"), ("p{k}", "p{k}-7"), ("{d}x", "{d}x-7")])
reading("read_labels_cut", lambda c: P.cut_label(c, 12), [("una etiqueta de {cosa}", "una…"), ("{mes}", "{mes}")])
reading("read_sounds", T.sounds, [("etxebarria", "echebarria"), ("goytia", "goitia"), ("zubizarreta", "subisarreta"), ("quintana", "kintana"), ("villa {k} del {d}", "billa {k} del {d}")])
reading("read_folds", T.folded, [("  Año\n NUEVO {who}  {mes}", "ano nuevo {cosa} {mes}"), (None, None)])
reading("read_plain_letters", T.simplified, [("¡Ñandú, {who}: {k}º!", "nandu {cosa} {k}")])
reading("read_keywords", lambda c: _joined(T.keywords(c, ("sobre",))), [("Sobre los patinetes y los Patinetes eléctricos {k} del {y}", "patinetes|electricos"), ("Sobre {mes} y los {mes}, sobre {dmy}", "{mes}")])
reading("read_literal_words", lambda c: _joined(P.literal_words(c, ("sobre",))), [("¿Sobre la OPE y las Becas? becas; Ñandú ZBE {k}", "OPE|Becas|Ñandú|ZBE")])
reading("read_languages", lambda c: P.is_spanish(c).cast("string"), [("el pleno de la villa {k}", "true"), ("eta da ez du", "false"), ("de la que el en y eta", "true")])
reading("read_basque_names", lambda c: P.is_basque_name(c).cast("string"), [("Udal Langileen Elkartea eta", "true"), ("Asociación de Vecinos {who}", "false"), ("Bilboko herritarren {k}", "false")])
reading("read_spanish_sentences", lambda c: _joined(P.spanish_sentences(c)), [("Primera frase de {cosa} de la sesión. Hau ez da eta du.\nLa última de {mes}", "Primera frase de {cosa} de la sesión.|La última de {mes}")])
reading("read_headings", lambda c: P.is_heading(c).cast("string"), [("PREGUNTAS ORALES", "true"), ("IV.", "true"), ("Moción {k} sobre {cosa}", "false")])
reading("read_proper_phrases", lambda c: _joined(P.proper_phrases(c)), [("En la Zona de Bajas Emisiones y San Mamés, con Ana {k}", "Zona de Bajas Emisiones y San Mamés"), ("nada", "")])
reading("read_named_phrases", lambda c: _joined(P.named_phrases(c)), [("el Parque de Doña Casilda, la calle Autonomía y la calle\n Autonomía; el plan {k}", "parque de dona casilda|calle autonomia")])
reading("read_without_repeats", P.without_repeats, [("Uno {cosa}\n\nTres {k}\n\nuno  {who}\n\nfin", "Uno {cosa}\n\nTres {k}\n\nfin"), (None, None)])
reading("read_without_loops", P.without_loops, [("una línea de {cosa} que se repite muchas veces\nsí\nuna línea de {cosa} que se repite muchas veces\nsí", "una línea de {cosa} que se repite muchas veces\nsí\nsí")])
reading("read_without_empty_blocks", P.without_empty_blocks, [("# A\n\n# {who}\ntexto {cosa}\n# C\n", "# {who}\ntexto {cosa}\n")])
reading("read_highlights", lambda c: P.highlights(c, "xx", before=3, after=2), [("abcdefxxghij 12345xx", "defxxgh […] 345xx"), ("nada {cosa}", None)])
reading("read_lists", lambda c: _joined(P.as_list(c)), [('["{cosa}", "b{k}"]', "{cosa}|b{k}"), ("{cosa} {k}", "{cosa} {k}"), (" ", ""), ("[broken", "[broken")])
reading("read_repaired_json", lambda c: F.from_json(P.repaired_json(c), "a int, b array<int>")["a"].cast("string"), [('Claro:\n```json\n{"a": {k}, "b": [1, 2,],}\n``` fin', "{k}"), ("nada", None)])
reading("read_document_keys", lambda c: P.document_key(c, F.lit(None), F.lit("t" * 60)), [("{cosa} {dmy}.pdf", "{cosa} {dmy}.pdf|" + "t" * 50)])
reading("read_rerooted", lambda c: P.rerooted(c, "/data/"), [("C:\\x\\{y}\\{cosa}{k}.pdf", "/data/{y}/{cosa}{k}.pdf"), ("/y/{y}/{dmy}.pdf", "/data/{y}/{dmy}.pdf")])
reading("read_amendment_results", P.amendment_result, [("Enmienda de {who} no aceptada", "rechazada"), ("queda aceptada", "aprobada"), ("Transaccional de {cosa}", "transaccionada"), ("{cosa}", None)])
reading("read_explicit_results", P.explicit_result, [("se aprueba la moción de {cosa}, y queda rechazada la enmienda {k}", "rechazada"), ("se aprueba", None), ("todo decae", "decae")])
reading("read_scan_noise", P.without_scan_noise, [("RUIZ BUJED O,", "RUIZ BUJEDO"), ("G1L  P~EREZ", "GIL PEREZ")])
reading("read_citizens", P.citizen_entity, [("Proposición de “Bilbo {who} {k}” sobre x", "Bilbo {who} {k}"), ("presentada por don Juan {who} mediante", "Juan {who}"), ("nada", None)])
reading("read_forms", Q.form_of, [("¿Cuántas proposiciones sobre {cosa} se presentaron en {y}?", "count"), ("¿Qué grupo ha presentado más enmiendas?", "rank_amendments"), ("¿En qué año se presentaron más proposiciones?", "rank_year"), ("¿Cómo votó el PP la última proposición de Elkarrekin?", "votes"), ("Gracias por {cosa}", None)])
reading("read_question_groups", lambda c: _joined(Q.groups_of(c)), [("los populares y EH Bildu en {mes} de {y}", "EH BILDU|PP"), ("un acto popular", ""), ("¿podemos saber algo?", ""), ("Podemos presentó {k}", "ELKARREKIN BILBAO|UDALBERRI"), ("la moción de Ciudadanos", "CIUDADANOS")])
reading("read_question_results", Q.result_asked, [("se aprobaron las de {cosa} en {y}", "aprobada"), ("fue aprobada o rechazada", None), ("decayó o decae", "decae"), ("retiradas", "retirada")])
reading("read_subjects", lambda c: _joined(Q.subject_words(c)), [("¿Cuántas proposiciones sobre los patinetes eléctricos se aprobaron en {mes} de {y}?", "patinet|electric"), ("¿Qué grupo ha presentado más?", "")])


_FOLD_SQL = "translate({0}, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY')"


def of_documents(name: str, build: Callable[[Column], Column], sql: str) -> None:
    """Registers a query of doc_id and value over whole texts; sql is the value of text in SQL."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, folder: spread(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", build(F.col("text")).alias("value")))


_PARTS = r"regexp_split_to_array(text, '\n\s*\n')"
_PART_KEYS = r"list_transform(" + _PARTS + r", lambda p: trim(regexp_replace(lower(" + _FOLD_SQL.format("p") + r"), '\s+', ' ', 'g')))"
of_documents("documents_folded", lambda c: F.md5(T.folded(c)), rf"md5(trim(regexp_replace(lower({_FOLD_SQL.format('text')}), '\s+', ' ', 'g')))")
of_documents("documents_plain_letters", lambda c: F.md5(T.simplified(c)), rf"md5(regexp_replace(lower(regexp_replace({_FOLD_SQL.format('text')}, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9\s]', '', 'g'))")
of_documents("documents_heads_and_tails", lambda c: T.head_and_tail(c, 300, 200), "CASE WHEN length(text) <= 500 THEN text ELSE left(text, 300) || chr(10) || '[...]' || chr(10) || right(text, 200) END")
of_documents("documents_keywords", lambda c: F.array_join(F.array_sort(T.keywords(c, ("the", "para"), 6)), " "), f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({_FOLD_SQL.format('text')}), '[a-z]{{6,}}'), lambda w: w NOT IN ('the', 'para')))), ' ')")
of_documents("documents_dated_ids", lambda c: T.short_id(F.substring(c, 1, 40), F.char_length(c)), "left(md5(left(text, 40) || '||' || length(text)), 16)")
of_documents("documents_years", lambda c: F.size(Q.years_of(c, 1900, 2030)), r"len(list_filter(regexp_extract_all(text, '\b(?:19|20)\d{2}\b'), lambda y: CAST(y AS INTEGER) BETWEEN 1899 AND 2031))")
