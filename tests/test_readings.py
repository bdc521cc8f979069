"""What functions read out of single texts, by hand; {k} stands for a number that differs from text to text."""

from __future__ import annotations

from collections.abc import Callable

import pytest
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

CASES: dict[str, tuple] = {}


def reading(name, build, cases):
    CASES[name] = (build, cases)


def _joined(c: Column, separator: str = "|") -> Column:
    """An array as a string, null for null."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def _fields(*names: str) -> Callable[[Column], Column]:
    """Fields of a struct as a string, a dash for each null."""
    return lambda c: F.concat_ws("|", *(F.coalesce(c[n].cast("string"), F.lit("-")) for n in names))


reading("read_groups", M.group_name, [("GANEMOS ({k})", "GOAZEN BILBAO"), ("Grupo BIL DU", "EH BILDU"), ("Grupo Municipal P P", "PP"), ("Sozialista Abertzaleak", "PSE-EE"), ("Udalberri - Bilbao en Común", "UDALBERRI"), ("Vecinos {k}", "Vecinos {k}"), (" ", "Desconocido"), (None, "Desconocido"), ("Izquierda  Unida", "EZKER BATUA-IU")])
reading("read_known_groups", M.known_group, [("los ciudadanos piden", "CIUDADANOS"), ("Vecinos {k}", "Desconocido"), ("E A J - P N V", "EAJ-PNV"), ("la Alcaldía", "EQUIPO DE GOBIERNO")])
reading("read_results", M.result_name, [("Desestimación {k}", "rechazada"), ("aprobada inicialmente con condiciones", "aprobada"), ("Decayó", "decae"), ("Ez onartua", "rechazada"), ("Retirada", "retirada"), ("{k}", "sin resultado"), (None, "sin resultado")])
reading("read_crossed_results", lambda c: M.crossed_result(c, F.lit("rechazada")), [("queda retirada la proposición {k}, por lo que decae la enmienda", "retirada"), ("se aprueba la enmienda y decae la proposición", "decae"), ("se aprueba la proposición", "aprobada"), ("otra cosa {k}", "rechazada"), (None, "rechazada")])
reading("read_decisions", lambda c: _joined(F.transform(D.decisions(c), lambda d: F.concat_ws(" ", d["outcome"], d["object"]))), [("Queda rechazada la enmienda {k}, y se aprueba por unanimidad la proposición; decae el resto.", "rechazada enmienda|aprobada punto|decae"), ("nada", ""), ("resultan aprobados los puntos 1 y {k}", "aprobada por_puntos")])
reading("read_tallies", lambda c: _fields("cast", "favour", "against", "abstain")(M.tally(c)), [("Votos emitidos: {k} | a favor: 19, en contra: 7, abstenciones: 3", "{k}|19|7|3"), ("unanimidad", "-|-|-|-"), ("votos emi tidos: 5, votos afirmati vos: 5. Votos emitidos: {k}, votos negativos: 2", "{k}|-|2|-")])
reading("read_tally_subjects", M.tally_subject, [("queda aceptada la enmienda del equipo (Votos emitidos: {k}", "enmienda"), ("se aprueba la moción (votos emitidos: 2", "proposicion"), ("Votos emitidos: {k}", None)])
reading("read_recovered_results", lambda c: _fields("result", "source")(M.recovered_result(c, F.lit(False))), [("Votos emitidos: 29 | a favor: 19, en contra: 7, abstenciones: 3", "aprobada|recuento"), ("Votos emitidos: 29 | a favor: 19, en contra: 7", "-|-"), ("Se rechaza la proposición (votos emitidos: {k})", "rechazada|votoTexto"), ("votos emitidos: 9, a favor: 4, en contra: 5", "rechazada|recuento")])
reading("read_amounts", lambda c: _joined(M.amounts(c)), [("gastos de 1 500,5 € y 2.000 €", "1500.50|2000.00"), ("50 euros", ""), ("en {k} pasos", "")])
reading("read_main_amounts", lambda c: M.main_amount(c).cast("string"), [("un gasto de 1.200 euros y otro por importe de 275.000,00 € y 300.000 €", "275000.00"), ("gastos de 1 500,5 € y 2.000 €", "2000.00"), ("la moción {k}", None)])
reading("read_beneficiaries", M.beneficiary, [("subvención a favor de la Asociación {k} Vecinal, por importe de 3.000 €", "Asociación {k} Vecinal"), ("subvención directa al Athletic Club para obras", "Athletic Club"), ("a favor de nadie, x", None), ("nada", None)])
reading("read_submission_dates", lambda c: M.submitted_on(c, F.lit(2021)).cast("string"), [("Proposición {k} de fecha 4 de enero de 2020", "2020-01-04"), ("presentada el 31 de febrero", None), ("presentada el día 3 de marzo", "2021-03-03"), ("{k}", None)])
reading("read_point_types", lambda c: M.point_type(c, F.lit("Desconocido")), [("INICIATIVA VECINAL presentada por {k}", "proposicion_ciudadana"), ("{k}. Preguntas orales", "pregunta"), ("Proposición de fecha 4 de enero de 2021 presentada por W", "informe_iniciativa"), ("Se da cuenta del informe {k}", "dacion_cuenta"), ("A probar el a cta de la sesión", "tramite"), ("Toma de conocimiento de la renuncia", "tramite"), ("Dictamen sobre la ordenanza", "propuesta_gobierno"), ("Otros {k}", "otro"), (None, "otro")])
reading("read_group_points", lambda c: M.point_type(c, F.lit("PP")), [("{k}. Proposición que presenta el Grupo Municipal X", "proposicion_grupo"), ("Moción sobre {k}", "proposicion_grupo"), ("Propuesta de enmienda número {k}", "enmienda_articulado"), ("Cosas", "propuesta_gobierno")])
reading("read_speakers", M.speaker_key, [("SRA. RUIZ BUJEDO", "ruizbujedo"), ("SR. ALCALDE", "alcalde"), ("ALKATE JN.", "alcalde"), ("SR. SECRETARIO GENERAL", "secretario"), ("SRES. GIL Y SÁEZ", "gilysaez")])
reading("read_junk_entities", lambda c: M.is_junk_entity(c, own_names=["Ayuntamiento de {k}"]).cast("string"), [("los servicios", "true"), ("a. t. e.", "true"), ("Asociación de Vecinos {k}", "false"), ("Área", "true"), ("bcdf {k}", "true")])
reading("read_entity_keys", M.entity_key, [("Construcciones Pérez {k}, S.A.", "construcciones_perez_{k}"), ("Ría {k}", "ria_{k}"), ("Obras, S. Coop., S.L.", "obras")])
reading("read_name_lists", lambda c: _joined(M.named_list(c)), [("Ana Ruiz, Luis Gil y Jon Sáez", "Ana Ruiz|Luis Gil|Jon Sáez"), ("{k}; el resto; Eva  Mora", "Eva Mora"), ("", "")])
reading("read_declared_lists", lambda c: F.concat(_joined(M.declared_list(c, "Votos a favor")["names"]), F.lit("|"), M.declared_list(c, "Votos a favor")["agrees"].cast("string")), [("Votos a favor: 3: Ana Ruiz, Luis Gil y Jon Sáez. Otros {k}", "Ana Ruiz|Luis Gil|Jon Sáez|true"), ("Votos a favor: 5: Ana Ruiz y Luis Gil. x", "Ana Ruiz|Luis Gil|false"), ("Votos a favor: 1: Ana Ruiz, Luis Gil y Jon Sáez. x", "Ana Ruiz|true")])
reading("read_submitting_groups", lambda c: S.submitting_group(c, F.lit("")), [("{k}. Proposición que presenta el Grupo Municipal EH BIL DU, cuya parte", "EH BILDU"), ("Proposición que p resenta el g rupo municipal Partido Popular. x", "PP"), ("4. Proposición vecinal de {k}", "Desconocido"), ("-5- Se da cuenta de la resolución de Alcaldía", "EQUIPO DE GOBIERNO"), ("-5- Se da cuenta de otra cosa", "Desconocido"), ("Propuesta de aprobación {k}", "EQUIPO DE GOBIERNO"), ("EAJ-PNV udal taldeak aurkezten duen proposizioa", "EAJ-PNV"), ("Moción de VOX sobre {k}", "VOX"), ("los ciudadanos piden", "Desconocido"), ("Moción de Ciudadanos sobre el empleo", "CIUDADANOS"), (None, "Desconocido")])
reading("read_submitters_of_texts", lambda c: S.submitting_group(F.lit("Proposición"), c), [("que presenta el Grupo Municipal Socialista, x {k}", "PSE-EE"), ("de nadie {k}", "Desconocido")])
reading("read_private_submitters", lambda c: F.when(S.private_submitter(c).isNotNull(), _fields("name", "kind")(S.private_submitter(c))), [("Proposición de la Asociación Vecinal {k}, para pedir", "Asociación Vecinal {k}|organizacion"), ("presentada por don Juan Pérez Gil mediante escrito", "Juan Pérez Gil|persona"), ("presentada por doña ##### , x", None), ("nada", None)])
reading("read_disguised_groups", lambda c: S.group_in_disguise(c).cast("string"), [("Grupo PARTIDO POPULAR", "true"), ("Asociación de amigos del partido popular de aquí", "false"), ("Ría {k}", "false")])
reading("read_surnames", lambda c: _joined(S.surname_variants(c)), [("Ana Ruiz Bujedo", "BUJEDO|RUIZ|RUIZ BUJEDO"), ("María Luisa Gil De Sáez", "GIL|GIL DE|GIL DE SAEZ|SAEZ"), ("Ana", "ANA")])
reading("read_torn_words", lambda c: c.rlike(S.torn_pattern("proposición")).cast("string"), [("la propo sición {k}", "true"), ("la p roposició n", "true"), ("la proposi-ción", "false")])
reading("read_result_texts", V.result_text, [("Votos emitidos: 5 x Votos afirmativos: 5 y más. Votos emitidos: 29 y Votos afirmativos: 19 y Votos negativos: 7. Queda rechazada la\n proposición --- pie. Fin", "Queda rechazada la proposición (Votos emitidos: 29 | a favor: 19, en contra: 7)"), ("se aprueba la propuesta citada en el debate", None), ("Antes de todo, queda aprobada la moción {k}. x", "queda aprobada la moción {k}"), ("El Pleno Municipal acuerda por unanimidad lo dicho. x", "El Pleno Municipal acuerda por unanimidad lo dicho"), ("nada", None)])
reading("read_vote_objects", V.vote_object, [("la enmienda de {k}", "enmienda"), ("la proposición con su enmienda", "punto"), ("los puntos 1 y 2", "por_puntos"), ("{k}", "otro")])
reading("read_seats", lambda c: _joined(A.present(c, ("perez",))), [("Asisten D. Juan Pérez Gil, Dña. Ana Ruiz Bujedo y D. Luis de la Torre Sáez.", "Ana Ruiz Bujedo|Luis de la Torre Sáez"), ("{k}", "")])
reading("read_only_points", A.only_point_title, [("Orden del día: ÚNICO PUNTO: Debate sobre la ría {k}. Fin", "Debate sobre la ría {k}"), ("nada", None)])
reading("read_sessions_of_files", lambda c: _fields("date", "kind")(A.session_of(c)), [("22-03-2019 extraordinaria.pdf", "2019-03-22|extraordinary"), ("2019-06-15 sesión constitutiva.pdf", "2019-06-15|constitutive"), ("31-02-2019 {k}.pdf", "-|ordinary")])
reading("read_titles", A.point_title, [("7.- Moción {k} sobre\nla ría. Se debate", "Moción {k} sobre la ría"), ("PUNTO 3.- Ruegos\n\nNo hay", "Ruegos")])
reading("read_label_dates", lambda c: T.date_of_label(c).cast("string"), [("acta 31-01-2020.pdf", "2020-01-31"), ("31-02-2020", None), ("{k}", None)])
reading("read_sort_days", lambda c: P.sort_day(c).cast("string"), [("acta 31-01-2020.pdf", "2020-01-31"), ("31-02-2020 {k}", "1900-01-01"), (None, "1900-01-01")])
reading("read_heads_and_tails", lambda c: T.head_and_tail(c, 3, 2, "~"), [("abcdefgh", "abc~gh"), ("abcde", "abcde"), (None, None)])
reading("read_source_urls", lambda c: T.source_url(F.lit(2020), c, F.lit(7)), [("a {k}.pdf", "/acta/2020/a%20{k}.pdf#page=7"), ("ñ.pdf", "/acta/2020/%C3%B1.pdf#page=7")])
reading("read_page_ranges", lambda c: T.page_range(c, F.lit("7")), [("7", "7"), ("3", "3-7")])
reading("read_labels_cut", lambda c: P.cut_label(c, 12), [("una etiqueta larga", "una…"), ("corta", "corta")])
reading("read_sounds", T.sounds, [("etxebarria", "echebarria"), ("goytia", "goitia"), ("zubizarreta", "subisarreta"), ("quintana", "kintana"), ("villa {k}", "billa {k}")])
reading("read_folds", T.folded, [("  Año\n NUEVO {k}", "ano nuevo {k}"), (None, None)])
reading("read_plain_letters", T.simplified, [("¡Ñandú, {k}º!", "nandu {k}")])
reading("read_keywords", lambda c: _joined(T.keywords(c, ("sobre",))), [("Sobre los patinetes y los Patinetes eléctricos {k}", "patinetes|electricos")])
reading("read_literal_words", lambda c: _joined(P.literal_words(c, ("sobre",))), [("¿Sobre la OPE y las Becas? becas; Ñandú ZBE {k}", "OPE|Becas|Ñandú|ZBE")])
reading("read_languages", lambda c: P.is_spanish(c).cast("string"), [("el pleno de la villa {k}", "true"), ("eta da ez du", "false"), ("de la que el en y eta", "true")])
reading("read_basque_names", lambda c: P.is_basque_name(c).cast("string"), [("Udal Langileen Elkartea eta", "true"), ("Asociación de Vecinos {k}", "false"), ("Bilboko herritarren", "false")])
reading("read_spanish_sentences", lambda c: _joined(P.spanish_sentences(c)), [("Primera frase {k} de la sesión. Hau ez da eta du.\nLa última", "Primera frase {k} de la sesión.|La última")])
reading("read_headings", lambda c: P.is_heading(c).cast("string"), [("PREGUNTAS ORALES", "true"), ("IV.", "true"), ("Moción {k} sobre la ría", "false")])
reading("read_proper_phrases", lambda c: _joined(P.proper_phrases(c)), [("En la Zona de Bajas Emisiones y San Mamés, con Ana {k}", "Zona de Bajas Emisiones y San Mamés"), ("nada", "")])
reading("read_named_phrases", lambda c: _joined(P.named_phrases(c)), [("el Parque de Doña Casilda, la calle Autonomía y la calle\n Autonomía; el plan {k}", "parque de dona casilda|calle autonomia")])
reading("read_without_repeats", P.without_repeats, [("Uno dos\n\nTres {k}\n\nuno  DOS\n\nfin", "Uno dos\n\nTres {k}\n\nfin"), (None, None)])
reading("read_without_loops", P.without_loops, [("una línea que se repite muchas veces\nsí\nuna línea que se repite muchas veces\nsí", "una línea que se repite muchas veces\nsí\nsí")])
reading("read_without_empty_blocks", P.without_empty_blocks, [("# A\n\n# B\ntexto {k}\n# C\n", "# B\ntexto {k}\n")])
reading("read_highlights", lambda c: P.highlights(c, "xx", before=3, after=2), [("abcdefxxghij 12345xx", "defxxgh […] 345xx"), ("nada {k}", None)])
reading("read_lists", lambda c: _joined(P.as_list(c)), [('["a", "b{k}"]', "a|b{k}"), ("a {k}", "a {k}"), (" ", ""), ("[broken", "[broken")])
reading("read_repaired_json", lambda c: F.from_json(P.repaired_json(c), "a int, b array<int>")["a"].cast("string"), [('Claro:\n```json\n{"a": {k}, "b": [1, 2,],}\n``` fin', "{k}"), ("nada", None)])
reading("read_document_keys", lambda c: P.document_key(c, F.lit(None), F.lit("t" * 60)), [("a{k}.pdf", "a{k}.pdf|" + "t" * 50)])
reading("read_rerooted", lambda c: P.rerooted(c, "/data/"), [("C:\\x\\2020\\a{k}.pdf", "/data/2020/a{k}.pdf"), ("/y/2021/b.pdf", "/data/2021/b.pdf")])
reading("read_amendment_results", P.amendment_result, [("Enmienda {k} no aceptada", "rechazada"), ("queda aceptada", "aprobada"), ("Transaccional", "transaccionada"), ("{k}", None)])
reading("read_explicit_results", P.explicit_result, [("se aprueba la moción, y queda rechazada la enmienda {k}", "rechazada"), ("se aprueba", None), ("todo decae", "decae")])
reading("read_scan_noise", P.without_scan_noise, [("RUIZ BUJED O,", "RUIZ BUJEDO"), ("G1L  P~EREZ", "GIL PEREZ")])
reading("read_citizens", P.citizen_entity, [("Proposición de “Bilbo Zaharra {k}” sobre x", "Bilbo Zaharra {k}"), ("presentada por don Juan Pérez mediante", "Juan Pérez"), ("nada", None)])
reading("read_forms", Q.form_of, [("¿Cuántas proposiciones sobre movilidad se presentaron en {k}?", "count"), ("¿Qué grupo ha presentado más enmiendas?", "rank_amendments"), ("¿En qué año se presentaron más proposiciones?", "rank_year"), ("¿Cómo votó el PP la última proposición de Elkarrekin?", "votes"), ("Gracias {k}", None)])
reading("read_question_groups", lambda c: _joined(Q.groups_of(c)), [("los populares y EH Bildu {k}", "EH BILDU|PP"), ("un acto popular", ""), ("¿podemos saber algo?", ""), ("Podemos presentó {k}", "ELKARREKIN BILBAO|UDALBERRI"), ("la moción de Ciudadanos", "CIUDADANOS")])
reading("read_question_results", Q.result_asked, [("se aprobaron {k}", "aprobada"), ("fue aprobada o rechazada", None), ("decayó o decae", "decae"), ("retiradas", "retirada")])
reading("read_subjects", lambda c: _joined(Q.subject_words(c)), [("¿Cuántas proposiciones sobre los patinetes eléctricos se aprobaron en mayo de {k}?", "patinet|electric"), ("¿Qué grupo ha presentado más?", "")])


@pytest.fixture(scope="module")
def found(spark):
    """All functions over all their texts, in one query each table of cases."""
    every = {}
    for name, (build, cases) in CASES.items():
        rows = [(k, number, None if text is None else text.replace("{k}", str(number))) for number in (7, 1204) for k, (text, _) in enumerate(cases)]
        frame = spark.createDataFrame(rows, "case int, number int, text string").coalesce(1).select("case", "number", F.lit(name).alias("name"), build(F.col("text")).alias("value"))
        every[name] = frame
    return every


@pytest.mark.parametrize("name", sorted(CASES))
def test_reading(found, name):
    got = {(r.case, r.number): r.value for r in found[name].collect()}
    assert got == {(k, n): None if v is None else v.replace("{k}", str(n)) for n in (7, 1204) for k, (_, v) in enumerate(CASES[name][1])}
