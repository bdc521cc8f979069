import random
import re

import duckdb
from pyspark.sql import functions as F

from quorumframe.operators import layout
from quorumframe.plans.census import census
from quorumframe.queries import ORACLE_SQL, QUERIES

WORDS = "file string, page int, x double, y double, width double, word string"


def set_line(file, page, y, *parts):
    """Words of each part (x, text), six units a letter and six between words."""
    rows = []
    for x, text in parts:
        for word in text.split():
            rows.append((file, page, float(x), float(y), 6.0 * len(word), word))
            x += 6 * len(word) + 6
    return rows


def sitting():
    """A sitting whose members stand in two columns, over two pages, with prose across."""
    rows = set_line("a", 1, 780, (60, "ACTA DE LA SESION CONSTITUTIVA DEL AYUNTAMIENTO EN PLENO"))
    left = ["GRUPO A:", "ANA GIL", "LUIS PAZ", "EVA MAS", "GRUPO B:", "JON SOL", "IKER OSA", "LEIRE ROS", "AITOR GOI", "MIREN LUR", "UNAI SAN"]
    right = ["GRUPO C:", "PILAR RUIZ", "OLGA DIEZ", "JUAN CANO", "ROSA VEGA", "GRUPO D:", "TERE GOMEZ", "RAUL NIETO", "SARA PEREZ", "ALDO BLAS", "NORA HERAS"]
    for k, (one, two) in enumerate(zip(left, right)):
        rows += set_line("a", 1, 760 - 12 * k + 0.4 * (k % 2), (60, one))
        rows += set_line("a", 1, 760 - 12 * k, (330, two))
    rows += set_line("a", 2, 780, (60, "FELIX ROMO"))
    rows += set_line("a", 2, 768, (60, "ACTO SEGUIDO SE FORMA LA MESA"))
    rows += set_line("a", 2, 756, (60, "BLANCA ARCE"))
    return rows


def test_columns_of_a_sitting_become_members_of_groups(spark):
    rows = sitting()
    random.Random(3).shuffle(rows)
    words = spark.createDataFrame(rows, WORDS)
    ordered = layout.in_reading_order(words, ["file", "page"])
    lines = layout.lines_in_order(ordered, ["file", "page"])
    said = [r.text for r in lines.orderBy("page", "at").collect()]
    assert said[:4] == ["ACTA DE LA SESION CONSTITUTIVA DEL AYUNTAMIENTO EN PLENO", "GRUPO A:", "ANA GIL", "LUIS PAZ"]
    assert said[11:14] == ["UNAI SAN", "GRUPO C:", "PILAR RUIZ"] and len(said) == 26
    text = F.col("text")
    met = layout.under_headings(lines, ["file"], ["page", "at"], heading=F.when(text.endswith(":"), F.rtrim(text, F.lit(":"))), stop=text.startswith("ACTO SEGUIDO"), entry=text)
    groups = {}
    for r in met.orderBy("page", "at").collect():
        groups.setdefault(r.heading, []).append(r.entry)
    assert groups["GRUPO A"] == ["ANA GIL", "LUIS PAZ", "EVA MAS"] and groups["GRUPO D"][-2:] == ["NORA HERAS", "FELIX ROMO"]
    assert [len(v) for _, v in sorted(groups.items())] == [3, 6, 4, 6]  # nobody after the prose
    seen = met.select(F.col("entry").alias("name"), F.col("heading").alias("group"), F.lit("1999-07-03").cast("date").alias("date"), F.lit(False).alias("is_mayor"))
    people = {r.name: r.group for r in census(seen, near=0).collect()}
    assert len(people) == 19 and people["SARA PEREZ"] == "GRUPO D" and people["IKER OSA"] == "GRUPO B"


def test_a_line_across_divides_what_is_above_from_what_is_below(spark):
    rows = []
    for k in range(10):
        rows += set_line("a", 1, 700 - 12 * k, (50, f"al{k} ar"), (300, f"br{k} bs"))
        rows += set_line("a", 1, 500 - 12 * k, (50, f"cl{k} cr"), (300, f"dr{k} ds"))
    rows += set_line("a", 1, 560, (50, "this line stands across both of the columns and more of it"))
    ordered = layout.in_reading_order(spark.createDataFrame(rows, WORDS), ["file", "page"])
    said = [r.text[0] for r in layout.lines_in_order(ordered, ["file", "page"]).orderBy("at").collect()]
    assert "".join(said) == "a" * 10 + "b" * 10 + "t" + "c" * 10 + "d" * 10
    assert {r.band for r in ordered.collect()} == {0, 1, 2}
    tight = layout.in_reading_order(spark.createDataFrame(rows, WORDS), ["file", "page"], gutter=400.0)
    assert {(r.band, r.column) for r in tight.collect()} == {(0, 0)}  # no gutter is that wide


def test_odd_words(spark):
    rows = [("a", 1, 5.0, 9.0, 3.0, "x")] * 2 + [("a", 1, None, 9.0, 3.0, "y"), ("a", 1, 1.0, 9.0, 0.0, ""), (None, None, 4.0, 2.0, 1.0, "z"), ("b", 1, 3.0, 3.0, 1.0, None)]
    got = layout.in_reading_order(spark.createDataFrame(rows, WORDS), ["file", "page"])
    assert sorted((str(r.file), r.place, str(r.word)) for r in got.collect()) == [("None", 0, "z"), ("a", 0, ""), ("a", 1, "x"), ("a", 2, "x"), ("b", 0, "None")]
    assert layout.lines_in_order(layout.in_reading_order(spark.createDataFrame([], WORDS), ["file", "page"]), ["file", "page"]).count() == 0


def test_gutters_equal_those_of_counted_units(spark):
    draw = random.Random(11)
    rows = []
    for page in range(12):
        starts = sorted(draw.sample(range(0, 500, 20), draw.randrange(1, 4)))
        for line in range(30):
            for x in starts:
                if draw.random() < 0.8:
                    rows.append(("a", page, float(x + draw.randrange(5)), 800.0 - 10 * line, float(draw.randrange(10, 90)), "w"))
    words = spark.createDataFrame(rows, WORDS)
    found = layout.gutters(layout.with_lines(words, ["page"]), ["page"], gutter=15.0, share=0.1)
    got = {(r.page, r.start, r.end) for r in found.collect()}
    want = set()
    for page in range(12):
        own = [r for r in rows if r[1] == page]
        allowed = int(0.1 * len({r[3] for r in own}))
        busy = [u for u in range(700) if sum(r[2] <= u and r[2] + r[4] >= u + 1 for r in own) > allowed]
        want |= {(page, a + 1.0, float(b)) for a, b in zip(busy, busy[1:]) if b - a - 1 >= 15}
    assert got == want and len(want) > 5


def test_words_meet_what_a_page_knows_of_its_lines_once(spark):
    words = spark.createDataFrame([(1, 0.0, 700.0, 10.0, "a"), (None, 0.0, 700.0, 10.0, "b")], "page int, x double, y double, width double, word string")
    ordered = layout.in_reading_order(words, ["page"])
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join .*\(line#", plan)) == 1  # lines with those across; words meet one row a page
    assert sorted((r.page, r.line, r.place) for r in ordered.where("page is not null").collect()) == [(1, 0, 0)] and ordered.count() == 2


def test_words_of_a_page_in_one_row_are_read_as_words_in_rows(spark):
    draw = random.Random(7)
    rows = [(None, 0, 1.0, 5.0, 2.0, "a"), ("b", 1, 4.0, None, 1.0, "b"), ("b", 1, 0.0, 0.0, 0.0, ""), ("b", 1, 0.0, 0.0, 0.0, None), ("b", 1, 9.0, 0.0, -3.0, "c")]
    for page in range(40):
        starts = sorted(draw.sample(range(0, 500, 20), draw.randrange(1, 5)))
        for line in range(draw.randrange(1, 30)):
            across = draw.random() < 0.1
            for x in [0, 150, 300] if across else starts:
                for k in range(draw.randrange(3)):
                    rows.append(("a", page, x + draw.randrange(9) + 40.0 * k, 800.0 - 8 * line + draw.randrange(4), float(draw.randrange(0, 180 if across else 70)), draw.choice("uvw")))
    words = spark.createDataFrame(rows, WORDS)
    pages = words.groupBy("file", "page").agg(F.collect_list(F.struct("word", "y", "x", "width")).alias("words"))
    bands = 0
    for options in ({}, {"gutter": 8.0, "share": 0.2}, {"tolerance": 1.0, "share": 0.0}):
        ordered = layout.in_reading_order(words, ["file", "page"], **options)
        read = layout.pages_in_order(pages, **options)
        flat = read.select("file", "page", F.posexplode("words").alias("place", "w")).select("file", "page", "place", "w.*")
        columns = ["file", "page", "place", "line", "band", "column", "x", "width", "word"]
        want, got = (sorted(map(str, f.select(columns).collect())) for f in (ordered, flat))
        assert got == want and len(got) > 1000
        bands += max(r.band for r in flat.collect()) > 0 and max(r.column for r in flat.collect()) > 1
        said = [sorted(map(str, f.select("file", "page", "at", "text").collect())) for f in (layout.lines_of_pages(read), layout.lines_in_order(ordered, ["file", "page"]))]
        assert said[0] == said[1]
    assert bands > 0
    odd = pages.limit(1).select(F.lit(None).cast(pages.schema["words"].dataType).alias("words")).unionByName(pages.limit(1).select(F.slice("words", 1, 0).alias("words")))
    assert sorted(map(str, (r.words for r in layout.pages_in_order(odd).collect()))) == ["None", "[]"] and layout.lines_of_pages(layout.pages_in_order(odd)).count() == 0


def test_headings_of_few_lines_are_those_of_many(spark):
    draw = random.Random(5)
    lines = spark.createDataFrame([(k % 7 or None, k, draw.choice(["h:", "i:", "x", "y", "stop", None])) for k in range(300)], "page int, at int, text string")
    text = F.col("text")
    marks = {"heading": F.when(text.endswith(":"), text), "stop": text == "stop", "entry": F.when(text == "x", text)}
    want, got = (sorted(map(str, layout.under_headings(lines, ["page"], ["at"], small=small, **marks).collect())) for small in (False, True))
    assert got == want and len(got) > 10


def test_pages_are_shuffled_once_as_texts(spark):
    for name in ("page_columns", "page_lists"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange (\w+)\(page_id", plan) == ["hashpartitioning"] and plan.count("hashpartitioning") == 1
        assert "rangepartitioning" not in plan and plan.count("FileScan") == plan.count("pages.parquet") == 1


def test_rows_of_one_page_share_its_sheets(spark, tmp_path):
    draw = random.Random(2)
    said = [" ".join("".join(draw.choices("abcdefg", k=draw.randrange(1, 15))) for _ in range(n)) for n in (700, 240, 500, 1, 0, 481)]
    rows = [(k // 2, "u", f"<p>{t}</p>") for k, t in enumerate(said)] + [(9, "u", None), (9, "u", ""), (8, "u", "<a b> 1 2 é")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_columns", "page_lists"):
        got = QUERIES[name](spark, str(tmp_path))
        found = duck.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in got.columns)} FROM ({ORACLE_SQL[name]})').fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(found) and len(found) > 50
