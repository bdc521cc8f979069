import pytest
from pyspark.sql import functions as F

from quorumframe.functions import passages as P
from quorumframe.functions.links import form_fields, page_rows
from quorumframe.operators import groups, matching
from quorumframe.plans import retrieval
from quorumframe.plans.questions import theme_labels


@pytest.fixture(scope="module")
def value(spark):
    def run(build, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", build(F.col("x")).alias("v")).orderBy("k").collect()
        return [r.v for r in rows]

    return run


def test_languages(value):
    assert value(P.is_spanish, "el pleno de la villa", "eta da ez du", "de la que el en y eta", None) == [True, False, True, None]
    assert value(P.is_basque_name, "Udal Langileen Elkartea eta", "Asociación de Vecinos", "Bilboko herritarren") == [True, False, False]
    assert value(P.spanish_sentences, "Primera frase de la sesión. Hau ez da eta du.\nLa última") == [["Primera frase de la sesión.", "La última"]]


def test_phrases(value):
    assert value(P.proper_phrases, "En la Zona de Bajas Emisiones y San Mamés, con Ana", "nada") == [["Zona de Bajas Emisiones y San Mamés"], []]
    assert value(P.named_phrases, "el Parque de Doña Casilda, la calle Autonomía y la calle\n Autonomía; el plan") == [["parque de dona casilda", "calle autonomia"]]
    assert value(lambda x: P.literal_words(x, ("sobre",)), "¿Sobre la OPE y las Becas? becas; Ñandú ZBE") == [["OPE", "Becas", "Ñandú", "ZBE"]]


def test_repeats(value):
    assert value(P.without_repeats, "Uno dos\n\nTres\n\nuno  DOS\n\n\n\nfin", None) == ["Uno dos\n\nTres\n\n\n\nfin".replace("\n\n\n\n", "\n\n\n\n"), None]
    line = "una línea que se repite muchas veces"
    assert value(P.without_loops, f"{line}\nsí\n{line}\nsí") == [f"{line}\nsí\nsí"]
    assert value(P.without_empty_blocks, "# A\n\n# B\ntexto\n# C\n") == ["# B\ntexto\n"]
    assert value(lambda x: P.highlights(x, "xx", before=3, after=2), "abcdefxxghij 12345xx", "nada") == ["defxxgh […] 345xx", None]


def test_values(value):
    assert value(lambda x: P.percent_text(x.cast("double")), "12.46", "0", None)[:2] == ["12.5%", "0.0%"]
    assert value(P.as_list, '["a", "b"]', "a", " ", None, "[broken") == [["a", "b"], ["a"], [], [], ["[broken"]]
    assert value(lambda x: F.from_json(P.repaired_json(x), "a int, b array<int>"), 'Claro:\n```json\n{"a": 1, "b": [1, 2,],}\n``` fin')[0].b == [1, 2]
    assert value(P.repaired_json, "nada") == [None]
    assert [str(d) for d in value(P.sort_day, "acta 31-01-2020", "31-02-2020", None)] == ["2020-01-31", "1900-01-01", "1900-01-01"]
    assert value(lambda x: P.document_key(x, F.lit(None), F.lit("t" * 60)), "a.pdf") == ["a.pdf|" + "t" * 50]
    assert value(lambda x: P.rerooted(x, "/data/"), "C:\\x\\2020\\a.pdf", "/y/2021/b.pdf") == ["/data/2020/a.pdf", "/data/2021/b.pdf"]
    assert value(lambda x: P.cut_label(x, 12), "una etiqueta larga", "corta") == ["una…", "corta"]
    assert value(P.amendment_result, "Enmienda no aceptada", "queda aceptada", "Transaccional", "?") == ["rechazada", "aprobada", "transaccionada", None]


def test_titles_and_names(value, spark):
    assert value(P.is_heading, "RUEGOS Y", "PARTE", "IV.", "12", "Moción sobre la ría", "PREGUNTAS ORALES") == [True, True, True, True, False, True]
    assert value(P.explicit_result, "se aprueba la moción, y queda rechazada la enmienda", "se aprueba", "todo decae") == ["rechazada", None, "decae"]
    assert value(P.without_scan_noise, "RUIZ BUJED O,", "G1L  P~EREZ") == ["RUIZ BUJEDO", "GIL PEREZ"]
    assert value(P.citizen_entity, "Proposición de “Bilbo Zaharra Foroa” sobre x", "Proposición de la Asociación Vecinal Uno, para pedir", "presentada por don Juan Pérez mediante", "nada") == ["Bilbo Zaharra Foroa", "Asociación Vecinal Uno", "Juan Pérez", None]
    rows = spark.createDataFrame([(3, True), (4, True), (1, False), (0, False)], "n int, one boolean").select(P.relevant_source("n", "one").alias("r")).collect()
    assert [r.r for r in rows] == [False, True, True, False]
    pages = spark.createDataFrame([(1, "<table><tr><th>A<td>b <b>c</b></tr><tr><td>d</td></table><form><input type='text' name='q' value=7><select name=\"s\"></form>")], "page_id int, html string")
    assert [r.cells for r in page_rows(pages).orderBy("place").collect()] == [["A", "b c"], ["d"]]
    assert [(r.name, r.value) for r in form_fields(pages).collect()] == [("q", "7"), ("s", "")]
    taxonomy = spark.createDataFrame([("a", "Casa", ["Hogar", "Piso"]), ("b", "Piso", [])], "theme_id string, label string, alternatives array<string>")
    assert {(r.theme_id, r.label) for r in theme_labels(taxonomy).collect()} == {("a", "Casa"), ("a", "Hogar"), ("b", "Piso")}


def test_groups_of_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 3, "y", None), ("b", 1, None, None)], "k string, o int, v string, w int")
    assert {tuple(r) for r in groups.last_known(rows, ["k"], ["v", "w"], "o").collect()} == {("a", "y", 5), ("b", None, None)}
    assert {tuple(r) for r in groups.first_known(rows, ["k"], ["v", "w"], "o").collect()} == {("a", "x", 5), ("b", None, None)}
    assert {(r.k, r.o) for r in groups.fullest(rows, ["k"], ["v", "w"], "o").collect()} == {("a", 1), ("b", 1)}
    runs = spark.createDataFrame([("q", True), ("q", True), ("q", False), ("r", True), ("r", False), ("s", None)], "q string, ok boolean").withColumn("shape", F.lit("s"))
    assert [tuple(r) for r in groups.solved_by_majority(runs, [], "shape", "q", "ok").collect()] == [("s", 3, 1)] and [r.q for r in groups.never_solved(runs, "q", "ok").collect()] == ["s"]


def test_matches_use_each_side_once(spark):
    pairs = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.5), (1, "c", "z", 0.2), (2, "a", "x", 0.4)]
    got = matching.matched_once(spark.createDataFrame(pairs, "g int, l string, r string, s double"), "g", "l", "r", "s").collect()
    assert sorted((r.g, r.l, r.r) for r in got) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x")]


def test_shared_words_in_blocks(spark):
    import random

    draw = random.Random(3)
    words = lambda: sorted(set(draw.choices("abcdefghij", k=draw.randrange(0, 8))))
    rows, bank = [(k, words()) for k in range(60)] + [(99, None)], [(k, words()) for k in range(40)]
    df, entries = spark.createDataFrame(rows, "id long, words array<string>"), spark.createDataFrame(bank, "item long, words array<string>")
    exact = {}
    for i, a in rows:
        scored = sorted((-round(len(set(a or ()) & set(b)) / len(set(a or ()) | set(b)), 6), k) for k, b in bank if set(a or ()) & set(b))
        exact |= {(i, k) for _, k in scored[:3]} and {(i, tuple(k for _, k in scored[:3])): 1} if scored else {}
    for block in (1000, 7):
        got = {}
        for r in matching.sharing_words(df, "id", entries, "item", k=3, block=block).collect():
            got.setdefault(r.id, []).append((-round(r.common / (r.of_own + r.of_bank - r.common), 6), r.bank_id))
        assert {(i, tuple(k for _, k in sorted(v))): 1 for i, v in got.items()} == exact
        assert matching.sharing_words(df, "id", entries, "item", least=2, block=block).count() == sum(len(set(a or ()) & set(b)) >= 2 for _, a in rows for _, b in bank)


def test_labels_of_more_letters_than_a_shard_holds(spark):
    texts = spark.createDataFrame([(1, "the red house and a dog"), (2, "Blue"), (3, None)], "id int, t string")
    labels = spark.createDataFrame([(1, "Red House"), (2, "dog"), (3, "blue"), (4, "house red")], "k int, label string")
    for letters in (20_000_000, 5):
        assert {(r.id, r.k) for r in matching.contained_labels(texts, "id", "t", labels, "k", "label", shard_letters=letters).collect()} == {(1, 1), (1, 2), (2, 3)}
    assert matching.contained_labels(texts, "id", "t", labels.where("k > 9"), "k", "label").columns == ["id", "k", "label"]


def test_retrieval_by_metadata(spark):
    rows = [(1, "d1", "3", "s", 0, "one", "a", ["x"], "PP"), (2, "d1", "3", "s", 1, "two", "b", ["a"], None), (3, "d2", None, "s", 0, "three", "c", None, "PP"), (4, "d3", "9 x", "t", 0, "four", None, ["a"], "VOX")]
    df = spark.createDataFrame(rows, "frag_id int, date string, topic string, source string, chunk_index int, text string, theme string, themes array<string>, party string").withColumn("vote_result", F.lit(None).cast("string"))
    ids = lambda f: sorted(r.frag_id for r in f.collect())
    assert ids(retrieval.about(df, themes=["a"])) == [1, 2, 4]
    assert ids(retrieval.about(df, dates=spark.createDataFrame([("d1",)], "session_date string"))) == [1, 2]
    assert ids(retrieval.about(df, party="PP", least=3)) == [1, 2, 3, 4] and ids(retrieval.about(df, party="PP", least=2)) == [1, 3]
    assert ids(retrieval.about(df, topics_=["9"])) == [4] and ids(retrieval.about(df, topics_=["7"])) == [1, 2, 3, 4]
    assert ids(retrieval.debates(df, spark.createDataFrame([(1, 1), (3, 2)], "frag_id int, place int"))) == [1, 2, 3]
    chosen = spark.createDataFrame([(4, 1), (1, None), (2, None)], "frag_id int, lead int")
    assert [r.text for r in retrieval.context(df, chosen).collect()] in (["four", "one\ntwo"], ["one\ntwo", "four"])
    assert [r.text for r in retrieval.context(df, chosen, budget=4).collect()] == ["four"]
    named = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "point_id string, pos int")
    sources = spark.createDataFrame([("a", "d", 1, "f", "A"), ("b", "d", 2, "f", "B")], "point_id string, date string, page int, file string, title string")
    assert [r.title for r in retrieval.citations(named, sources).collect()] == ["B", "A"]
