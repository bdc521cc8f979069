import pytest
from pyspark.sql import functions as F

from quorumframe.functions import minutes as M
from quorumframe.functions import submitters as S
from quorumframe.functions import votes as V


@pytest.fixture(scope="module")
def value(spark):
    def run(build, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", build(F.col("x")).alias("v")).orderBy("k").collect()
        return [r.v for r in rows]

    return run


def test_submitting_groups(value):
    titles = (
        "3. Proposición que presenta el Grupo Municipal EH BIL DU, cuya parte dispositiva", "Proposición que p resenta el g rupo municipal Partido Popular. x", "4. Proposición vecinal de Z", "-5- Se da cuenta de la resolución de Alcaldía",
        "-5- Se da cuenta de otra cosa", "Propuesta de aprobación", "Propuesta de enmienda número 3", "EAJ-PNV udal taldeak aurkezten duen proposizioa", "Moción de VOX sobre y", "los ciudadanos piden", None,
    )
    got = value(lambda x: S.submitting_group(x, F.lit(None).cast("string")), *titles)
    assert got == ["EH BILDU", "PP", "Desconocido", "EQUIPO DE GOBIERNO", "Desconocido", "EQUIPO DE GOBIERNO", "Desconocido", "EAJ-PNV", "VOX", "Desconocido", "Desconocido"]
    more = ("Moción de Ciudadanos sobre el empleo", "Proposición de Bilbao en Común para pedir", "Proposición del Grupo Municipal de Ezkerrak, a", "Bilbao en común y con ciudadanos", "Aprobación del acta")
    assert value(lambda x: S.submitting_group(x, F.lit("")), *more) == ["CIUDADANOS", "ELKARREKIN BILBAO", "Desconocido", "Desconocido", "Desconocido"]
    assert value(lambda x: S.submitting_group(F.lit("Proposición"), x), "que presenta el Grupo Municipal Socialista, x") == ["PSE-EE"]


def test_private_submitters(value):
    got = value(S.private_submitter, "Proposición de la Asociación Vecinal Uno, para pedir", "presentada por don Juan Pérez Gil mediante escrito", "presentada por doña ##### , x", "nada")
    assert [tuple(g) if g else None for g in got] == [("Asociación Vecinal Uno", "organizacion"), ("Juan Pérez Gil", "persona"), None, None]
    assert value(S.group_in_disguise, "Grupo PARTIDO POPULAR", "Asociación de amigos del partido popular de aquí", "Ría") == [True, False, False]
    assert value(S.surname_variants, "Ana Ruiz Bujedo", "María Luisa Gil De Sáez", "Ana") == [["BUJEDO", "RUIZ", "RUIZ BUJEDO"], ["GIL", "GIL DE", "GIL DE SAEZ", "SAEZ"], ["ANA"]]


def test_a_private_submitters_patterns_run_once(spark):
    plan = spark.createDataFrame([("a",)], "x string").select(S.private_submitter("x").alias("v"))._jdf.queryExecution().analyzed().toString()
    assert [plan.count(word) for word in ("propietarios", "doña", "representación")] == [1, 1, 2]


def test_a_private_submitters_name_ends_at_the_first_end(value):
    got = value(S.private_submitter, "Asociación A B relativa a C, D. E", "AMPA 1. 2 mediante x", "don , Ana", "don Ana\u2028Gil, x", "Asociación " + "A" * 91 + " de don Luis Gil.")
    assert [r and tuple(r) for r in got] == [("Asociación A B", "organizacion"), ("AMPA 1", "organizacion"), None, ("Ana", "persona"), ("Luis Gil", "persona")]



def test_result_texts(value):
    got = value(
        V.result_text,
        "Votos emitidos: 5 x Votos afirmativos: 5 " + "palabra " * 100 + " Votos emitidos: 29 y Votos afirmativos: 19 y Votos negativos: 7. Queda rechazada la\n proposición --- pie. Fin",
        "se aprueba la propuesta citada en el debate", "Queda aprobada la moción. x", "El Pleno Municipal acuerda por unanimidad lo dicho. x", "nada", None,
    )
    assert got == ["Queda rechazada la proposición (Votos emitidos: 29 | a favor: 19, en contra: 7)", None, "Queda aprobada la moción", "El Pleno Municipal acuerda por unanimidad lo dicho", None, None]


def test_vote_events(spark):
    text = "Se somete a votación la enmienda de X, con el siguiente resultado: votos emitidos: 28, votos afirmati vos: 21, votos negativos: 7. En su virtud, queda aceptada la enmienda. Se somete a votación nominal la proposición presentada por Y: votos emitidos: 3"
    rows = V.vote_events(spark.createDataFrame([("a", text), ("b", "nada"), ("c", None)], "k string, t string"), "k", "t").orderBy("ord").collect()
    assert [(r.k, r.ord, r.object, r.cast, r.favour, r.against, r.abstain) for r in rows] == [("a", 1, "enmienda", 28, 21, 7, 0), ("a", 2, "punto", 3, 0, 0, 0)]
    assert rows[0].decision == "queda aceptada la enmienda" and rows[1].description == "la proposición presentada por Y"


def test_entities_with_their_kind(spark):
    rows = [
        ("Bilbao Kirolak,  S.A.U.", "EMPRESA", ("Bilbao Kirolak, S.A.U.", "organizacion", "bilbao_kirolak")), ("Ría", "barrio", None), ("Rekalde", " Barrio", ("Rekalde", "lugar", "rekalde")),
        ("Sr. Basagoiti", "persona", None), ("La señora Gil Paz", "Concejala", ("La senora Gil Paz", "persona", "la_senora_gil_paz")), ("Dolores Ibarruri", "persona", ("Dolores Ibarruri", "persona", "dolores_ibarruri")),
        ("los servicios", "x", None), ("Plan General", None, ("Plan General", "entidad", "plan_general")), (None, "persona", None), ("", None, None), ("A. B.", "lugar", None),
    ]
    df = spark.createDataFrame([(k, n, t) for k, (n, t, _) in enumerate(rows)], "k int, name string, kind string")
    got = {r.k: r.e and tuple(r.e) for r in df.select("k", M.entity("name", "kind").alias("e")).collect()}
    assert got == {k: e for k, (_, _, e) in enumerate(rows)}
