"""Subjects: their phrase, their alternatives, the themes that stand for them, and the steps of their ladder."""

import pytest
from pyspark.sql import functions as F

from quorumframe.plans import relaxation as R


def test_phrases_and_alternatives(spark):
    asked = [
        "¿Cuántas mociones sobre el traslado o la reforma del Mercado de San Antón se aprobaron?", "¿Qué se dijo acerca del Metro de Bilbao y sus estaciones?", "¿Qué se ha hablado de los patinetes eléctricos en 2019?",
        "¿Cuántas propuestas relacionadas con el ruido o las terrazas presentó el PP?", "¿Cuántos plenos hubo?", "propuestas sobre vivienda desde 2015", None, "¿Qué opina sobre que se vote?",
    ]
    rows = spark.createDataFrame(list(enumerate(asked)), "k int, q string").select("k", R.subject_phrase("q").alias("p")).withColumn("x", R.alternatives("p")).orderBy("k").collect()
    assert [r.x for r in rows][2:] == [[["patinet", "electric"]], [["ruido"], ["terraz"]], [], [["viviend"]], [], []]
    assert rows[0].x[0][0] == "traslad" and rows[0].x[0][1:] == rows[0].x[1][1:] and len(rows[0].x) == 2
    assert len(rows[1].x) == 1 and not any("estacion" in w for w in rows[1].x[0])
    assert rows[5].p == "vivienda" and rows[4].p is None and rows[6].p is None


def test_themes_that_stand_for_alternatives(spark):
    subjects = spark.createDataFrame([(1, [["medi", "ambient"], ["zona", "verd"]]), (2, [["barri", "otxark"]]), (3, [])], "question_id int, alternatives array<array<string>>")
    themes = spark.createDataFrame([(1, 7, "Medio ambiente"), (2, 8, "Barrios")], "question_id int, theme_id long, label string")
    stems = {r.theme_id: r.s for r in themes.select("theme_id", F.array_distinct(F.transform(R.words("label", 4), R.stem)).alias("s")).collect()}
    subjects = subjects.withColumn("alternatives", F.when(F.col("question_id") == 1, F.array(F.lit(stems[7]), F.lit(["zona", "verd"]))).when(F.col("question_id") == 2, F.array(F.lit([*stems[8], "otxark"]))).otherwise(F.col("alternatives")))
    got = {r.question_id: (r.alternatives, r.themes, r.absorbed) for r in R.with_themes(subjects, themes).collect()}
    assert got[1] == ([["zona", "verd"]], [7], []) and got[2][1:] == ([], [8]) and len(got[2][0]) == 1 and got[3] == ([], [], [])


def test_the_first_step_with_hits_counts(spark):
    fields = spark.createDataFrame([(k, f"obras en la calle {k}", True) for k in range(100)] + [(200, "patinetes en la calle", False), (201, "zona30 y patinetes", True), (202, None, True), (203, "calle patinetes nuevos", False)], "point_id int, text string, is_about boolean")
    asked = spark.createDataFrame([(1, [["patinet", "calle", "nuev"]]), (2, [["patinet", "calle", "ancha"]]), (3, [["calle"], ["zona30"]]), (4, [["nada"]]), (5, []), (6, [["nada", "patinet"]])], "question_id int, alternatives array<array<string>>")
    got = {}
    for r in R.relaxed_hits(asked, fields, rare=0.05).collect():
        got.setdefault((r.question_id, r.step, r.criterion), set()).add((r.point_id, r.relation))
    assert got[1, 0, "all words"] == {(203, "mentions")}
    assert {k[:2] for k in got} == {(1, 0), (3, 0)} | {k[:2] for k in got if k[0] in (2, 6)}
    assert len(got[3, 0, "all words"]) == 100 and (4, 0, "all words") not in got
    exists = {r.question_id: r.step for r in R.subject_exists(asked, fields).collect()}
    assert exists[1] == 0 and exists[4] is None and exists[5] is None
    assert R.relaxed_hits(asked.where("false"), fields).count() == 0 and R.relaxed_hits(asked, fields.where("false")).count() == 0


def test_themes_that_somebody_made_up(spark):
    themes = spark.createDataFrame([("T1", "presupuestos"), ("T2", "vivienda"), ("T3", "vivienda_social"), ("T4", "")], "theme_id string, slug string")
    asked = spark.createDataFrame([(s,) for s in ("presupuestos_fiscalidad", "mi-vivienda", "la_vivienda_social", "viv", "hogares", "nada", "", None, "nada")], "slug string")
    by_text = {r.slug: (r.theme_id, r.by) for r in R.known_themes(asked, themes).collect()}
    assert by_text == {"presupuestos_fiscalidad": ("T1", "text"), "mi-vivienda": ("T2", "text"), "la_vivienda_social": ("T3", "text"), "viv": ("T3", "text"), "hogares": (None, None), "nada": (None, None), "": (None, None), None: (None, None)}
    vectors = spark.createDataFrame([("hogares", [1.0, 0.1]), ("nada", [-1.0, 0.2]), ("viv", [0.0, 1.0])], "slug string, embedding array<float>")
    prototypes = spark.createDataFrame([("T2", [1.0, 0.0]), ("T1", [0.0, 1.0])], "theme_id string, embedding array<float>")
    got = {r.slug: (r.theme_id, r.by) for r in R.known_themes(asked, themes, vectors=vectors, prototypes=prototypes).collect()}
    assert got == by_text | {"hogares": ("T2", "meaning")}
    assert R.known_themes(asked, themes.where("false")).where("theme_id is not null").count() == 0
    with pytest.raises(ValueError):
        R.known_themes(asked, themes, most_themes=2)
