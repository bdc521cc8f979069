"""Links of raw pages, as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href and label of every link; markup inside a label goes."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)).alias("label"))
    links = pages.select("page_id", F.posexplode(found).alias("place", "link"))
    return links.select("page_id", "place", "link.href", F.trim(F.regexp_replace("link.label", "<[^>]*>|\\s+", " ")).alias("label"))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, place and cells of every table row, as texts without markup; a row ends with its table or the next row, also without its end tag."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\z)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(bodies).alias("place", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), F.lit(1))
    return rows.select("page_id", "place", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"(?:<[^>]*>|\s)+", " "))).alias("cells"))


_FIELD = r"""(?is)<(?:input|select|textarea)\b([^>]*)>"""


def form_fields(pages: DataFrame) -> DataFrame:
    """page_id, place, name and value of every named field of the forms of a page."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_FIELD), F.lit(1))).alias("place", "tag"))

    def attribute(name: str):
        return F.regexp_extract("tag", rf"""(?is)(?<![\w-]){name}\s*=\s*["']?([^"'\s>]*)""", 1)

    return found.select("page_id", "place", attribute("name").alias("name"), attribute("value").alias("value")).where("name <> ''")
