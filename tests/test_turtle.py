import pytest

from quorumframe.sources import files

TURTLE = '''# Themes of the council.
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix : <http://example.org/theme/> .

:works a skos:Concept ;   # with "quotes" in a comment
    skos:prefLabel "Obras"@es, "Lanak"@eu ;
    skos:altLabel "Obras; y \\"zanjas\\", # no comment"@es .

:streets a skos:Concept ; skos:prefLabel "Calles"@es ; skos:broader :works, <http://example.org/theme/other> .
:lamps skos:broader :streets ; :height 4.5 ; :count 12 ; :lit true ; :since "1999-07-03"^^<http://www.w3.org/2001/XMLSchema#date> . :poles skos:prefLabel "Postes."@es .
:blank :has [ :x 1 ] .
unknown:thing a skos:Concept .
'''
SKOS, OWN = "http://www.w3.org/2004/02/skos/core#", "http://example.org/theme/"


def test_turtle_statements_are_triples(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TURTLE)
    rows = files.read_turtle(spark, str(tmp_path / "t.ttl")).collect()
    good = {(r.subject, r.predicate, r.object, r.literal, r.lang, r.type) for r in rows if r.malformed is None}
    kind, xsd = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2001/XMLSchema#"
    assert good == {
        (OWN + "works", kind, SKOS + "Concept", None, None, None),
        (OWN + "works", SKOS + "prefLabel", None, "Obras", "es", None),
        (OWN + "works", SKOS + "prefLabel", None, "Lanak", "eu", None),
        (OWN + "works", SKOS + "altLabel", None, 'Obras; y "zanjas", # no comment', "es", None),
        (OWN + "streets", kind, SKOS + "Concept", None, None, None),
        (OWN + "streets", SKOS + "prefLabel", None, "Calles", "es", None),
        (OWN + "streets", SKOS + "broader", OWN + "works", None, None, None),
        (OWN + "streets", SKOS + "broader", OWN + "other", None, None, None),
        (OWN + "lamps", SKOS + "broader", OWN + "streets", None, None, None),
        (OWN + "lamps", OWN + "height", None, "4.5", None, xsd + "decimal"),
        (OWN + "lamps", OWN + "count", None, "12", None, xsd + "integer"),
        (OWN + "lamps", OWN + "lit", None, "true", None, xsd + "boolean"),
        (OWN + "lamps", OWN + "since", None, "1999-07-03", None, xsd + "date"),
        (OWN + "poles", SKOS + "prefLabel", None, "Postes.", "es", None),
    }
    lost = sorted(r.malformed.strip() for r in rows if r.malformed is not None)
    assert lost == [":blank :has [ :x 1 ]", "unknown:thing a skos:Concept"]
    themes = {r.theme_id: r for r in files.read_taxonomy(files.read_turtle(spark, str(tmp_path / "t.ttl"))).collect()}
    assert themes[OWN + "works"].label == "Obras" and set(themes[OWN + "works"].alternatives) == {"Lanak", 'Obras; y "zanjas", # no comment'}


def test_a_closed_graph_goes_out_and_comes_back(spark, tmp_path):
    points = spark.createDataFrame([(1, 'A "b" \\ c\nd. e', [2, 3], 5), (2, None, None, None), (3, "x", [], 6)], "id int, title string, themes array<int>, group_id int")
    lines = files.triples(points, "id", "Point", "http://example.org/", links={"themes": "Theme", "group_id": "Group"})
    lines.coalesce(1).write.text(str(tmp_path / "out"))
    for read in (files.read_triples, files.read_turtle):
        rows = read(spark, str(tmp_path / "out")).collect()
        assert all(r.malformed is None for r in rows) and len(rows) == 3 + 2 + 2 + 2
        assert {r.object.removeprefix("http://example.org/") for r in rows if r.predicate == "http://example.org/themes"} == {"Theme/2", "Theme/3"}
        assert {r.literal for r in rows if r.literal} == {'A "b" \\ c\nd. e', "x"}


def test_odd_turtle(spark, tmp_path):
    (tmp_path / "empty.ttl").write_text("# nothing.\n\n")
    assert files.read_turtle(spark, str(tmp_path / "empty.ttl")).count() == 0
    (tmp_path / "two").mkdir()
    for k in "ab":
        (tmp_path / "two" / f"{k}.ttl").write_text(f"@prefix p: <http://{k}/> .\np:x p:y p:z .\n")
    with pytest.raises(ValueError, match="several meanings"):
        files.read_turtle(spark, str(tmp_path / "two"))
    (tmp_path / "base.ttl").write_text('@base <http://b/> .\nPREFIX p: <http://b/>\np:x p:y """a "b" \n c"""@es .\n')
    assert [r.malformed is None for r in files.read_turtle(spark, str(tmp_path / "base.ttl")).collect()] == [False, False]
