"""Words of pages set in columns on sheets, read in the order of columns, and lists under headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.functions.text import bound
from quorumframe.operators import layout
from quorumframe.registry import query, read
from quorumframe.storage import spread

#: The words of a page on sheets of forty lines of six words, in two columns, every thirteenth line across both.
#: Then, by brute force: a line begins where no other base line is just above, the words over each unit of the width are counted.
_SET = r"""WITH w AS (SELECT page_id, word, k - 1 AS k FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z]{1,12}')) AS word, generate_subscripts(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z]{1,12}'), 1) AS k FROM pages)),
p AS (SELECT page_id, k // 240 AS sheet, word, length(word) AS n, (k % 240) // 6 AS r, k % 6 AS s FROM w),
word AS (SELECT page_id, sheet, word, 5 * n AS width, CASE WHEN r % 13 = 5 THEN s * 70 ELSE (s // 3) * 260 + (s % 3) * 70 + n % 5 END AS x, 800 - 15 * r + s % 3 AS y FROM p),
base AS (SELECT DISTINCT page_id, sheet, y FROM word),
top AS (SELECT b.page_id, b.sheet, b.y FROM base AS b WHERE NOT EXISTS (SELECT 1 FROM base AS o WHERE o.page_id = b.page_id AND o.sheet = b.sheet AND o.y > b.y AND o.y <= b.y + 3)),
row_of AS (SELECT b.page_id, b.sheet, b.y, count(*) - 1 AS line FROM base AS b JOIN top AS t ON t.page_id = b.page_id AND t.sheet = b.sheet AND t.y >= b.y GROUP BY 1, 2, 3),
lined AS (SELECT * FROM word JOIN row_of USING (page_id, sheet, y)),
sheets AS (SELECT page_id, sheet, floor(0.1 * count(DISTINCT line)) AS allowed FROM lined GROUP BY 1, 2),
units AS (SELECT page_id, sheet, unnest(range(x, x + width)) AS u FROM lined),
cover AS (SELECT page_id, sheet, u, count(*) AS n FROM units GROUP BY 1, 2, 3),
busy AS (SELECT page_id, sheet, u FROM cover JOIN sheets USING (page_id, sheet) WHERE n > allowed),
gap AS (SELECT page_id, sheet, u + 1 AS start, lead(u) OVER (PARTITION BY page_id, sheet ORDER BY u) AS stop FROM busy),
gutter AS (SELECT page_id, sheet, (start + stop) / 2 AS cut FROM gap WHERE stop - start >= 20),
side AS (SELECT page_id, sheet, line, cut, max(x + width) FILTER (x + width / 2 < cut) AS l, min(x) FILTER (x + width / 2 >= cut) AS r, bool_or(x < cut AND x + width > cut) AS o FROM lined JOIN gutter USING (page_id, sheet) GROUP BY 1, 2, 3, 4),
across AS (SELECT DISTINCT page_id, sheet, line FROM side WHERE o OR r - l < 20)"""

_PLACED = """,
placed AS (SELECT l.*, EXISTS (SELECT 1 FROM across AS a WHERE a.page_id = l.page_id AND a.sheet = l.sheet AND a.line = l.line) AS own,
  (SELECT count(*) FROM gutter AS g WHERE g.page_id = l.page_id AND g.sheet = l.sheet AND g.cut <= l.x + l.width / 2) AS c,
  (SELECT count(*) FROM across AS a WHERE a.page_id = l.page_id AND a.sheet = l.sheet AND a.line < l.line) AS above FROM lined AS l),
read_at AS (SELECT page_id, sheet, word, x, y, line, own, above, CAST(CASE WHEN own THEN 0 ELSE c END AS BIGINT) AS "column",
  row_number() OVER (PARTITION BY page_id, sheet ORDER BY above, CASE WHEN own THEN 1 ELSE 0 END, CASE WHEN own THEN 0 ELSE c END, line, x, width, word) - 1 AS place FROM placed)
"""


def _read(spark, folder):
    """The words of all pages in reading order, a row a sheet.

    Words are shuffled as texts, once and by page: rows of one page may be many, and sheets
    and lines of a page stay together from there on.
    """
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    found = spread(read(spark, folder, "pages")).select("page_id", F.regexp_extract_all(plain, F.lit("[A-Za-z]{1,12}"), 0).alias("found"))
    cut = bound(F.col("found"), lambda f: F.when(F.size(f) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / 240).cast("int")), lambda s: F.array_join(F.slice(f, s * 240 + 1, F.lit(240)), " "))))
    sheets = found.select("page_id", F.posexplode(cut).alias("sheet", "text")).repartition("page_id")
    texts = sheets.groupBy("page_id", F.col("sheet").cast("long").alias("sheet")).agg(F.collect_list("text").alias("texts"))
    words = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, " "), _set)))
    return layout.pages_in_order(texts.select("page_id", "sheet", words.alias("words")))


def _set(word, k):
    """The k-th word of a sheet in its place."""
    size, row, slot = F.length(word), F.floor(k / 6), k % 6
    inside = F.floor(slot / 3) * 260 + slot % 3 * 70 + size % 5
    return F.struct(word.alias("word"), (5 * size).alias("width"), F.when(row % 13 == 5, slot * 70).otherwise(inside).alias("x"), (800 - 15 * row + slot % 3).alias("y"))


@query("page_columns", _SET + _PLACED + 'SELECT page_id, sheet, word, x, y, line, "column", place FROM read_at')
def page_columns(spark, folder):
    """Where each word of a page is read: those above a line across both columns come first, the left column before the right."""
    words = _read(spark, folder).select("page_id", "sheet", F.posexplode("words").alias("place", "w"))
    numbers = [F.col(f"w.{c}").cast("long").alias(c) for c in ("x", "y", "line", "column")]
    return words.select("page_id", "w.word", "sheet", *numbers, F.col("place").cast("long").alias("place"))


@query(
    "page_lists",
    _SET
    + _PLACED
    + """, said AS (SELECT page_id, sheet, min(place) AS place, string_agg(word, ' ' ORDER BY place) AS text FROM read_at GROUP BY page_id, sheet, above, own, "column", line),
held AS (SELECT page_id, sheet, row_number() OVER (PARTITION BY page_id, sheet ORDER BY place) - 1 AS "at", text,
  last_value(CASE WHEN length(text) % 11 = 0 THEN '' WHEN length(text) % 7 = 0 THEN split_part(text, ' ', 1) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY sheet, place ROWS UNBOUNDED PRECEDING) AS heading FROM said)
SELECT page_id, sheet, "at", heading, text AS entry FROM held WHERE heading <> '' AND length(text) % 2 = 1 AND length(text) % 7 <> 0 AND length(text) % 11 <> 0""",
)
def page_lists(spark, folder):
    """Lines of pages under the heading above them, over columns and sheets; what is heading, entry or end is told by the length of a line."""
    lines = layout.lines_of_pages(_read(spark, folder))
    size = F.length("text")
    heading = F.when(size % 7 == 0, F.substring_index("text", " ", 1))
    met = layout.under_headings(lines, ["page_id"], ["sheet", "at"], heading=heading, stop=size % 11 == 0, entry=F.when(size % 2 == 1, F.col("text")), small=True)
    return met.select("page_id", "sheet", F.col("at").cast("long").alias("at"), "heading", "entry")
