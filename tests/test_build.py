import datetime as dt

from pyspark.sql import functions as F

from quorumframe.functions import agenda as A
from quorumframe.plans import build, census
from quorumframe.plans.spec import QuerySpec, compiled

MINUTES = """AYUNTAMIENTO DE BILBAO
Acta de la sesión ordinaria. Asisten D. Juan Pérez Gil, Dña. Ana Ruiz Bujedo y D. Luis de la Torre Sáez.
1.- Aprobar el acta de la sesión anterior. El Pleno Municipal acuerda por unanimidad aprobarla.
2.- Proposición que presenta el Grupo Municipal EH Bildu, sobre vivienda, por importe de 275.000,00 €.
SRA. RUIZ BUJEDO: Defiendo la proposición y cito el apartado 7.- de la norma. SR. ALCALDE: Gracias.
Página 3
Se somete a votación la proposición, con el siguiente resultado: votos emitidos: 29, votos afirmativos: 10, votos negativos: 19. En su virtud, queda rechazada la proposición.
3.- Preguntas orales. No hay.
Egiaztatzeko kodea 123
"""


def test_segments_and_points(spark):
    texts = spark.createDataFrame([("a", MINUTES), ("b", "sin puntos"), ("c", None)], "file string, text string")
    rows = A.segments(texts, "file", "text").orderBy("ord").collect()
    assert [(r.file, r.number) for r in rows] == [("a", 1), ("a", 2), ("a", 3)]
    assert all(MINUTES[r.start : r.end] == r.text for r in rows) and rows[-1].end == len(MINUTES)
    held = A.points(spark.createDataFrame([("a", 1, 2, "Long title", "x" * 9), ("a", 2, 2, "Short", "y"), ("a", 3, 2, "Other of nine", "z" * 9)], "file string, ord int, number int, title string, text string"), "file").first()
    assert (held.title, held.text) == ("Long title", "x" * 9 + "\ny\n" + "z" * 9)
    one = spark.createDataFrame([(MINUTES, "13. Moción x", "Orden del día: ÚNICO PUNTO: Debate sobre la ría. Fin", "22-03-2019 extraordinaria.pdf")], "t string, n string, o string, f string")
    got = one.select(A.present("t").alias("p"), A.present("t", ("perez",)).alias("q"), A.agenda_number("n").alias("n"), A.only_point_title("o").alias("o"), A.session_of("f").alias("s"), A.without_furniture("t").alias("w"), A.topic_prefix("n").alias("k"), A.topic_prefix("o").alias("l"), A.point_title(F.lit("7.- Moción sobre\nla ría. Se debate")).alias("title")).first()
    assert got.p == ["Juan Pérez Gil", "Ana Ruiz Bujedo", "Luis de la Torre Sáez"] and got.q == got.p[1:] and got.n == 13 and got.o == "Debate sobre la ría" and got.title == "Moción sobre la ría"
    assert (got.s.date, got.s.kind) == (dt.date(2019, 3, 22), "extraordinary") and "Egiaztatzeko" not in got.w and "Página" not in got.w and got.k == "13" and got.l.startswith("orden del dia")


def test_minutes_become_tables(spark):
    texts = spark.createDataFrame([("28-03-2019 ordinaria.pdf", MINUTES), ("no day.pdf", MINUTES)], "file string, text string")
    points = build.agenda_points(texts)
    rows = {r.number: r for r in build.typed_points(points).collect()}
    assert {k: r.point_type for k, r in rows.items()} == {1: "tramite", 2: "proposicion_grupo", 3: "pregunta"}
    assert (rows[2].group_id, rows[2].result, rows[2].result_source, str(rows[2].amount), rows[2].year) == ("EH BILDU", "rechazada", "votoTexto", "275000.00", 2019) and rows[1].group_id is None
    vote = build.votes(points).first()
    assert (vote.point_id, vote.object, vote.cast, vote.favour, vote.against, vote.is_decisive) == (rows[2].point_id, "punto", 29, 10, 19, True)
    assert [(r.speaker, r.text[:8]) for r in build.speeches(points).orderBy("ord").collect()] == [("ruizbujedo", "Defiendo"), ("alcalde", "Gracias.")]
    fixed = spark.createDataFrame([(rows[2].point_id, 1, "aprobada")], "point_id string, at int, result string")
    facts = build.facts_of(texts, fixed)
    assert compiled(QuerySpec("count", groups=("EH BILDU",), results=("aprobada",), years=(2019, 2019)), facts).first().n == 1
    assert compiled(QuerySpec("sessions"), facts).first().n == 1 and compiled(QuerySpec("rank_speaker"), facts).count() == 2


def test_census(spark):
    d = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rows = [("Juan María Aburto Rique", "PNV", d(k), True) for k in range(5)] + [("JUAN MARIA ABURTO R IQUE", "PNV", d(9), False), ("Juan Maria Aburtn Rique", None, d(10), None), ("Ana Ruiz Bujedo", "PP", d(0), False), ("Ana Ruiz Bujedo", "PP", d(20), False), ("Eva Ruiz Gil", "VOX", d(15), False), (None, "PP", d(1), False)]
    people = census.census(spark.createDataFrame(rows, "name string, group string, date date, is_mayor boolean"))
    got = {r.name: r for r in people.collect()}
    assert set(got) == {"Juan María Aburto Rique", "Ana Ruiz Bujedo", "Eva Ruiz Gil"}
    mayor = got["Juan María Aburto Rique"]
    assert (mayor.group, mayor.first, mayor.last, mayor.n, mayor.ever_mayor) == ("PNV", d(0), d(10), 7, True)
    asked = spark.createDataFrame([("Ruiz", d(2), None), ("Ruiz", d(15), None), ("Ruiz", d(15), "VOX"), ("ABURTO", d(99), None), ("Nadie", d(1), None)], "surname string, date date, group string")
    named = {(r.surname, r.date, r.group): r.person for r in census.people_named(asked, people).collect()}
    assert named == {("RUIZ", d(2), None): "anaruizbujedo", ("RUIZ", d(15), None): None, ("RUIZ", d(15), "VOX"): "evaruizgil", ("ABURTO", d(99), None): "juanmariaaburtorique"}
    groups = {(r.surname, r.date): r.group for r in census.groups_named(asked, people).collect()}
    assert groups == {("RUIZ", d(2)): "PP", ("RUIZ", d(15)): None, ("ABURTO", d(99)): "PNV"}
    entities = spark.createDataFrame([(1, "ana ruiz bujedo"), (2, "Ría 2000")], "entity_id int, label string")
    assert {r.label: (r.entity_id, r.is_person) for r in census.entities_as_people(entities, people).collect()} == {"ana ruiz bujedo": ("anaruizbujedo", True), "Ría 2000": ("2", False)}
