"""Lists of names on votes, persons and groups of names, and counts that are put right."""

import datetime as dt

from quorumframe.plans import build, nominal

DAY = dt.date(2019, 3, 28)
TEXT = (
    "Se somete a votación la enmienda del PP, con el siguiente resultado: votos emitidos: 5, votos afirmativos: 2: señores Ruiz y Gil, votos negativos: 3: señoras Mora, Saez y Ortiz. En su virtud, queda rechazada la enmienda. "
    "Se somete a votación nominal la proposición, con el siguiente resultado: votos emitidos: 5, votos afirmativos: 3: Sres. Mora, Saez y Ortiz, votos negativos: 1: Sr. Ruiz, abstenciones: 1: Sra. Gil. En su virtud, queda aprobada."
)


def _people(spark):
    rows = [("Ana Mora", "EAJ-PNV"), ("Luis Saez", "EAJ-PNV"), ("Jon Ortiz", "EAJ-PNV"), ("Eva Ruiz", "PP"), ("Pau Ruiz", "VOX"), ("Kim Gil", "PP")]
    days = {"Pau Ruiz": (dt.date(2023, 1, 1), None)}
    made = [(n.lower().replace(" ", ""), n, g, *days.get(n, (dt.date(2015, 1, 1), None)), 9, False) for n, g in rows]
    return spark.createDataFrame(made, "person string, name string, `group` string, first date, last date, n int, ever_mayor boolean")


def test_votes_of_persons_and_groups(spark):
    cut = TEXT[: TEXT.index("señoras Mora") + 20]  # a fragment that ends within a list
    points = spark.createDataFrame([("p", DAY, TEXT), ("p", DAY, cut), ("q", DAY, "nada"), ("r", DAY, None)], "point_id string, session_date date, text string")
    votes = build.votes(spark.createDataFrame([("p", TEXT)], "point_id string, text string"))
    got = nominal.person_votes(points, votes, _people(spark))
    rows = {(r.ord, r.name): (r.direction, r.person, r.group) for r in got.collect()}
    assert rows == {
        (1, "Ruiz"): ("favour", "evaruiz", "PP"), (1, "Gil"): ("favour", "kimgil", "PP"), (1, "Mora"): ("against", "anamora", "EAJ-PNV"), (1, "Saez"): ("against", "luissaez", "EAJ-PNV"), (1, "Ortiz"): ("against", "jonortiz", "EAJ-PNV"),
        (2, "Mora"): ("favour", "anamora", "EAJ-PNV"), (2, "Saez"): ("favour", "luissaez", "EAJ-PNV"), (2, "Ortiz"): ("favour", "jonortiz", "EAJ-PNV"), (2, "Ruiz"): ("against", "evaruiz", "PP"), (2, "Gil"): ("abstain", "kimgil", "PP"),
    }
    groups = {(r.ord, r.group): r.direction for r in nominal.group_votes(got).collect()}
    assert groups[1, "EAJ-PNV"] == "against" and groups[2, "EAJ-PNV"] == "favour"


def test_lists_go_to_the_nearest_vote(spark):
    votes = spark.createDataFrame([("p", 1, 10, 5, 0), ("p", 2, 10, 5, 0), ("p", 3, 9, 6, None), ("q", 1, 3, 0, 0)], "point_id string, ord int, favour int, against int, abstain int")
    lists = spark.createDataFrame([("p", 11, 1, 10, 5, 0), ("p", 12, 2, 10, 4, 0), ("p", 13, 3, 9, 6, 0), ("p", 14, 3, 1, 1, 1), ("z", 15, 1, 1, 1, 1)], "point_id string, list_id long, at int, favour int, against int, abstain int")
    assert {(r.point_id, r.ord, r.list_id) for r in nominal.placed_lists(lists, votes).collect()} == {("p", 1, 11), ("p", 2, 12), ("p", 3, 13)}
    assert nominal.placed_lists(lists.where("false"), votes).count() == 0


def test_counts_are_put_right_where_one_telling_agrees(spark):
    schema = "point_id string, ord int, cast int, favour int, against int, abstain int"
    votes = spark.createDataFrame([("p", 1, 29, 19, 0, 3), ("p", 2, 29, 19, 7, 3), ("p", 3, 28, None, 5, None), ("q", 1, 10, 1, 1, 1), ("r", 1, None, 1, 1, 1)], schema)
    told = spark.createDataFrame([("p", 0, 29, 19, 7, 3), ("p", 0, 29, 19, 7, 3), ("p", 0, 29, 12, 14, 3), ("p", 0, 28, 20, 5, 3), ("p", 0, 28, 21, 5, 2), ("q", 0, 10, 9, 2, 0)], schema)
    got = {(r.point_id, r.ord): (r.favour, r.against, r.abstain, r.corrected) for r in nominal.corrected_counts(votes, told).collect()}
    assert got == {("p", 1): (19, 7, 3, True), ("p", 2): (19, 7, 3, False), ("p", 3): (None, 5, None, False), ("q", 1): (1, 1, 1, False), ("r", 1): (1, 1, 1, False)}


def test_minutes_with_people_and_places(spark):
    text = f"1. Moción sobre la ría de Deusto\nSRA. RUIZ: Defiendo la propuesta de mi grupo.\nSR. ALCALDE: Gracias.\n{TEXT}\n2. Ruegos y preguntas\nNo hay."
    facts = build.facts_of(
        spark.createDataFrame([("28-03-2019 ordinaria.pdf", text)], "file string, text string"),
        people=_people(spark), places=spark.createDataFrame([("b1", "Deusto"), ("b2", "Zorroza")], "place_id string, name string"),
    )
    points = {r.title: r.place_id for r in facts.point.collect()}
    assert [v for t, v in points.items() if "Deusto" in t] == ["b1"] and set(points.values()) == {"b1", None}
    assert {(r.speaker, r.group_id) for r in facts.speech.collect()} == {("ruiz", "PP"), ("alcalde", None)}
    votes = {(r.ord, r.group_id): (r.direction, r.is_decisive) for r in facts.vote.collect()}
    assert votes[1, "EAJ-PNV"] == ("against", False) and votes[2, "EAJ-PNV"] == ("favour", True) and (1, None) not in votes
