import datetime as dt

import pytest
from pyspark.sql import functions as F

import quorumframe.queries as own
from quorumframe.functions import questions as Q
from quorumframe.plans import questions as P
from quorumframe.plans.facts import star_schema_facts
from quorumframe.plans.spec import NotExpressible, compiled
from quorumframe.operators.matching import subject_hits

TERMS = [(dt.date(2015, 6, 13), dt.date(2019, 6, 15)), (dt.date(2019, 6, 15), dt.date(2023, 6, 17)), (dt.date(2023, 6, 17), None)]
#: Questions of the kinds that people ask, and the form of their answer.
BANK = {
    "¿Cuántas proposiciones sobre movilidad y transporte se presentaron en 2019?": "count",
    "¿Cuántas proposiciones presentó el Partido Popular en 2015 y cuántas se aprobaron?": "ratio",
    "¿Qué porcentaje de las proposiciones sobre vivienda se han aprobado?": "ratio",
    "¿Qué grupo tiene mejor tasa de aprobación de sus proposiciones, EH Bildu o el PP?": "ratio_groups",
    "¿Qué tres grupos han presentado más proposiciones sobre medio ambiente?": "rank_group",
    "¿En qué año se presentaron más proposiciones sobre seguridad?": "rank_year",
    "¿Cuántas proposiciones sobre vivienda ha presentado cada grupo?": "breakdown_group",
    "¿Qué concejal o concejala ha presentado (firmado) más proposiciones?": "rank_signers",
    "¿Qué concejal o concejala ha votado más veces en contra de las proposiciones?": "person_votes",
    "¿En cuántos debates del Pleno ha intervenido Xabier Otxandiano?": "count_speeches",
    "¿Cuántas enmiendas ha presentado el Partido Popular en total?": "count_amendments",
    "¿Qué grupo ha presentado más enmiendas?": "rank_amendments",
    "¿Quién ha intervenido más veces en los plenos?": "rank_speaker",
    "¿Qué grupo ha intervenido más?": "rank_group_speeches",
    "¿Cuántos plenos ordinarios hubo en 2016?": "sessions",
    "¿Cómo votó el PP la última proposición de Elkarrekin?": "votes",
    "¿Qué asociación ha presentado más proposiciones vecinales?": "rank_person",
    "¿Qué barrio ha tenido más propuestas?": "rank_place",
    "¿Qué distritos han tenido más propuestas?": "rank_district",
    "¿Cuál ha sido el pleno con más proposiciones?": "rank_session",
    "¿En qué legislatura se presentaron más mociones?": "rank_term",
    "¿Cuál fue el primer pleno de la legislatura 2023-2027?": "first_session",
    "¿Cuándo se habló por última vez de la ría?": "last",
    "¿Qué mociones ha presentado Vox?": "list",
    "¿Se ha hablado alguna vez de los patinetes?": "exists",
    "¿Qué se dijo sobre el metro?": "contents",
    "¿Cuánto dinero se destinó a fiestas?": "amounts",
    "¿Qué tema se ha tratado más en 2019?": "theme_extreme",
    "¿Cuántas proposiciones se presentan por año?": "trend_year",
    "Gracias": None,
}


@pytest.fixture(scope="module")
def value(spark):
    def run(build, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", build(F.col("x")).alias("v")).orderBy("k").collect()
        return [r.v for r in rows]

    return run


def test_forms(value):
    assert dict(zip(BANK, value(Q.form_of, *BANK))) == BANK
    assert value(Q.form_of, None, "") == [None, None]


def test_days_and_months(value):
    got = value(Q.day_of, "el pleno del 15 de agosto de 2016", "el 24-09-2015", "el 24/9/2015", "31 de febrero de 2020", "1 de Mayo del 2019", "en mayo", None)
    assert got == [dt.date(2016, 8, 15), dt.date(2015, 9, 24), dt.date(2015, 9, 24), None, dt.date(2019, 5, 1), None, None]
    assert value(Q.months_of, "en mayo o Marzo", "la mayoría", "el otoño", "invierno y enero", None) == [[3, 5], [], [9, 10, 11, 12], [1, 2, 3, 12], None]


def test_periods(value):
    period = lambda x: Q.period_of(x, 2007, 2026, TERMS)
    texts = ("entre 2015 y 2017", "de 2015 a 2017", "2017-2015", "en 2015 y 2017", "desde 2020", "hasta el 2010", "en 2019", "Bilbao Ría 2000", "la legislatura 2019-2023", "el mandato de 2015", "esta legislatura", "¿en qué legislatura?", "la legislatura anterior", "los presupuestos municipales de 2016", "en 2012 y ahora", "nada")
    got = [(p.since, p.until, str(p.start) if p.start else None, str(p.end) if p.end else None, p.compared, p.fiscal) for p in value(period, *texts)]
    none = (None, None, None, None, False, None)
    assert got == [
        (2015, 2017, None, None, False, None), (2015, 2017, None, None, False, None), (2015, 2017, None, None, False, None), (2015, 2017, None, None, True, None), (2020, 2026, None, None, False, None), (2007, 2010, None, None, False, None),
        (2019, 2019, None, None, False, None), none, (2019, 2023, "2019-06-15", "2023-06-17", False, None), (2015, 2019, "2015-06-13", "2019-06-15", False, None), (2023, 2026, "2023-06-17", None, False, None), none, none,
        (None, None, None, None, False, 2016), (2012, 2012, None, None, True, None), none,
    ]


def test_results_groups_and_flags(value):
    assert value(Q.result_asked, "se aprobaron", "fue aprobada o rechazada", "rechazadas", "decayó o decae", "retiradas", "nada") == ["aprobada", None, "rechazada", "decae", "retirada", None]
    assert value(Q.groups_of, "los populares y EH Bildu", "un acto popular", "Podemos presentó", "¿podemos saber algo?", "los ciudadanos", "la moción de Ciudadanos", "PSE-EE") == [["EH BILDU", "PP"], [], ["ELKARREKIN BILBAO", "UDALBERRI"], [], [], ["CIUDADANOS"], ["PSE-EE"]]
    assert value(Q.submitters_of, "¿Cómo votó el PP la última proposición de Elkarrekin?", "¿Qué votó el PNV en la moción presentada por el PSE-EE?", "¿votó el PP?") == [["ELKARREKIN BILBAO"], ["PSE-EE"], []]
    got = value(Q.flags_of, "por unanimidad", "la oposición", "proposiciones vecinales", "la última vez", "cuánto dinero", "quién faltó al pleno", "subvenciones a asociaciones vecinales")
    assert [next((k for k, v in f.asDict().items() if v), None) for f in got] == ["unanimous", "opposition", "by_citizens", "latest", "out_of_scope", "out_of_scope", None]


def test_subject_words(value):
    assert value(Q.subject_words, "¿Cuántas proposiciones sobre los patinetes eléctricos se aprobaron en mayo de 2019?", "¿Qué grupo ha presentado más?") == [["patinet", "electric"], []]


def _analysed(spark, *questions):
    themes = spark.createDataFrame([(1, "Movilidad"), (2, "movilidad y transporte"), (3, "Vivienda"), (4, "Zona 30")], "theme_id int, label string")
    rows = spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    return P.analysed(rows, themes, first_year=2007, last_year=2026, terms=TERMS).orderBy("question_id").collect()


RESULTS = {"aprobada": ("aprobada", "aprobada con enmienda"), "rechazada": ("rechazada",)}


def test_specifications(spark):
    rows = _analysed(spark, "¿Cuántas proposiciones sobre movilidad y transporte rechazó EH Bildu entre 2015 y 2019?", "¿Cuántas proposiciones presentó el PP en 2015 y cuántas se aprobaron?", "¿Cómo votó el PP la proposición de Elkarrekin sobre la zona 30?", "¿Quién faltó?", "Gracias", "¿Cuántas proposiciones de la oposición se aprobaron por unanimidad en la legislatura 2019-2023?", "¿Cuántas mociones sobre patinetes hubo en los presupuestos de 2016?")
    specs = []
    for row in rows:
        try:
            specs.append(P.spec_of(row, results=RESULTS, unanimous=("a favor", "en contra", "abstención"), government=("EAJ-PNV",)))
        except NotExpressible:
            specs.append(None)
    first, ratio, votes, *nothing, opposed, free = specs
    assert (first.form, first.themes, first.groups, first.years, first.results) == ("count", (2,), ("EH BILDU",), (2015, 2019), ("rechazada",))
    assert (ratio.form, ratio.subset, ratio.results, ratio.groups) == ("ratio", RESULTS["aprobada"], (), ("PP",))
    assert (votes.form, votes.groups, votes.voters, votes.themes) == ("votes", ("ELKARREKIN BILBAO",), ("PP",), (4,))
    assert nothing == [None, None]
    assert (opposed.opposition_to, opposed.dates, opposed.unanimous) == (("EAJ-PNV",), (dt.date(2019, 6, 15), dt.date(2023, 6, 17)), ("a favor", "en contra", "abstención"))
    assert [P.uncovered(rows[k], s) for k, s in enumerate(specs) if s] == [[], [], [], [], ["fiscal", "subject"]]
    assert rows[-1].words == ["patinet"]


def test_questions_are_answered_from_tables(spark):
    facts = star_schema_facts(spark, "/root/testdata/sf0.001")
    questions = spark.createDataFrame([(1, "¿Cuántas proposiciones sobre EUROPE se presentaron entre 1996 y 1998?")], "question_id int, question string")
    row = P.analysed(questions, facts.theme, first_year=1995, last_year=2001).first()
    spec = P.spec_of(row, results={})
    assert (spec.themes, spec.years, P.uncovered(row, spec)) == ((1003,), (1996, 1998), [])
    assert compiled(spec, facts).first().n > 0


def test_sessions_of_questions(spark):
    days = spark.createDataFrame([(dt.date(y, m, d),) for y, m, d in ((2015, 10, 1), (2015, 11, 3), (2016, 1, 28), (2016, 3, 3), (2016, 3, 31), (2017, 3, 1))], "session_date date")
    asked = ["el 3 de marzo de 2016", "el 4-3-2016", "en primavera de 2016", "los presupuestos de 2016", "en 2017", "siempre", "el 5 de mayo de 2016"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    got = {}
    for r in P.sessions_of(questions, days, first_year=2007, last_year=2026).collect():
        got.setdefault(r.question_id, []).append(str(r.session_date))
    assert {k: sorted(v) for k, v in got.items()} == {0: ["2016-03-03"], 1: ["2016-03-03", "2016-03-31"], 2: ["2016-03-03", "2016-03-31"], 3: ["2015-10-01", "2015-11-03", "2016-01-28", "2016-03-03", "2016-03-31"], 4: ["2017-03-01"]}


def test_subjects_are_relaxed_step_by_step(spark):
    fields = spark.createDataFrame([(k, f"obras en la calle {k}", True) for k in range(100)] + [(200, "patinetes en la calle", True), (201, "zona30 y patinetes", False)], "point_id int, text string, is_about boolean")
    asked = spark.createDataFrame([(1, ["patinet", "calle", "nuev"])], "question_id int, words array<string>")
    rare = [r.word for r in P.specific_words(asked, fields).orderBy("df", "word").collect()]
    assert rare == ["nuev", "patinet"]
    ladder = P.alternatives_of(["patinet", "calle", "nuev"], ["patinet"])
    assert ladder == [[["patinet", "calle", "nuev"]], [["patinet"]]]
    assert [subject_hits(fields, step).count() for step in ladder] == [0, 2]
    hit = spark.createDataFrame([("Carril bici", "los carriles bicis"), ("Huerta", "huerto")], "label string, t string").select(F.expr("t").rlike("x").alias("x"), F.regexp_like("t", P.label_pattern("label")).alias("hit")).collect()
    assert [r.hit for r in hit] == [True, False]


def test_pairs_of_questions_and_sessions_are_whole_and_not_shuffled(spark):
    df = own.QUERIES["question_sessions"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["question_id", "session_date"]  # each pair, not a count of them
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(") < plan.index("Exchange")  # nothing is dealt again once a question has its sessions
