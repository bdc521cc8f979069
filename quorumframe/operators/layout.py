"""Reading order of words that come with their places on a page: lines, columns, and what stands across columns.

A row is a word with the keys of its page, x (its left edge), y (its base line, growing
upward) and width. Everything is a window or a group over the keys of a page, and a page
of paper holds some thousand words. Where a row is a page with all its words, these are
read in the row (`pages_in_order`, `lines_of_pages`) and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.text import bound
from quorumframe.operators.ordered import over_order
from quorumframe.storage import materialise


def with_lines(words: DataFrame, page: Sequence[str], *, tolerance: float = 3.0) -> DataFrame:
    """words with line, from 0 at the top: a step down of more than tolerance begins a new line."""
    downward = Window.partitionBy(*page).orderBy(F.desc("y"))
    opens = F.lag("y").over(downward) - F.col("y") > tolerance
    return words.withColumn("_opens", F.coalesce(opens.cast("int"), F.lit(0))).withColumn("line", F.sum("_opens").over(downward)).drop("_opens")


def gutters(lined: DataFrame, page: Sequence[str], *, gutter: float = 20.0, share: float = 0.1) -> DataFrame:
    """page keys, start and end of each stretch between columns: at least gutter wide, and crossed by at most share of the page's lines, in words.

    What lies left of all columns or right of them is no stretch between two.
    """
    allowed = lined.groupBy(*page).agg(F.floor(F.lit(share) * F.count_distinct("line")).alias("_allowed"))
    edges = lined.select(*page, F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(1).alias("step")), F.struct((F.col("x") + F.col("width")).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy(*page, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy(*page).orderBy("at")
    cover = steps.select(*page, "at", F.sum("step").over(along).alias("cover"), F.lead("at").over(along).alias("next")).join(allowed, [*page])
    busy = F.col("cover") > F.col("_allowed")
    # stretches in a row that few words cross are one; it is known by how many busy ones stand before it
    ranked = cover.withColumn("_busy", busy).withColumn("_before", F.sum(busy.cast("int")).over(along))
    free = ranked.where(~F.col("_busy") & (F.col("_before") > 0))
    found = free.groupBy(*page, "_before").agg(F.min("at").alias("start"), F.max("next").alias("end"), F.bool_or(F.col("next").isNull()).alias("_last"))
    return found.where(~F.col("_last") & (F.col("end") - F.col("start") >= gutter)).select(*page, "start", "end")


def in_reading_order(words: DataFrame, page: Sequence[str], *, tolerance: float = 3.0, gutter: float = 20.0, share: float = 0.1) -> DataFrame:
    """words (page keys, x, y, width, word and others) with line, band, column and place (from 0) on their page.

    A line that leaves no room of a gutter's width where others have one stands across the
    columns: it is a band of its own, and what is above it is read before what is below.
    In a band columns are read one after the other. Pages whose words leave no gutter are
    one column. Null keys are keys. Words without a place are left out; repeated rows are words of their own.
    """
    placed = words.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull())
    # read four times; a struct of keys equals itself in joins, null keys or not
    lined = materialise(with_lines(placed.withColumn("_page", F.struct(*page)), ["_page"], tolerance=tolerance), "lined")
    end, middle = F.col("x") + F.col("width"), F.col("x") + F.col("width") / 2
    between = gutters(lined, ["_page"], gutter=gutter, share=share).withColumn("_cut", (F.col("start") + F.col("end")) / 2)

    cut = F.col("_cut")
    sides = lined.join(between.select("_page", "_cut"), "_page").groupBy("_page", "line", "_cut").agg(F.max(F.when(middle < cut, end)).alias("_left"), F.min(F.when(middle >= cut, F.col("x"))).alias("_right"), F.bool_or((F.col("x") < cut) & (end > cut)).alias("_over"))
    across = sides.where(F.col("_over") | (F.col("_right") - F.col("_left") < gutter)).select("_page", "line").distinct().withColumn("_across", F.lit(True))
    cuts = between.groupBy("_page").agg(F.collect_list("_cut").alias("_cuts"))

    # a line across begins a band, and so does the line after it; what a page's words need to know of it is one row, its lines by their number
    own = lined.select("_page", "line").distinct().join(across, ["_page", "line"], "left").withColumn("_across", F.coalesce("_across", F.lit(False)))
    downward = Window.partitionBy("_page").orderBy("line")
    first = F.col("_across") | F.coalesce(F.lag("_across").over(downward), F.lit(False))
    bands = own.withColumn("_first", (first & (F.col("line") > 0)).cast("int")).withColumn("band", F.sum("_first").over(downward))
    facts = bands.groupBy("_page").agg(F.array_sort(F.collect_list(F.struct("line", "band", "_across"))).alias("_lines")).join(cuts, "_page", "left")

    met = lined.join(facts, "_page").withColumn("_line", F.get("_lines", F.col("line").cast("int")))
    beyond = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= middle)), F.lit(0))
    column = F.when(F.col("_line._across") | F.col("_cuts").isNull(), 0).otherwise(beyond)
    ordered = met.withColumns({"column": column, "band": F.col("_line.band")}).drop("_lines", "_cuts", "_line")
    order = Window.partitionBy("_page").orderBy("band", "column", "line", "x", "width", "word")
    return ordered.select(*words.columns, *(F.col(c).cast("int").alias(c) for c in ("line", "band", "column")), (F.row_number().over(order) - 1).alias("place"))


def pages_in_order(pages: DataFrame, *, words: str = "words", tolerance: float = 3.0, gutter: float = 20.0, share: float = 0.1) -> DataFrame:
    """As in_reading_order where a row is a page: pages with its words in reading order, each with line, band and column, and given, where it stood before.

    words is an array of structs with x, y, width, word and others, all of types with an
    order; those without a place are left out, and an array that is null stays null.
    """
    rest = [f for f in pages.schema[words].dataType.elementType.names if f not in ("x", "width", "word", "line", "band", "column", "given")]
    known = F.filter(words, lambda w: w["x"].isNotNull() & w["y"].isNotNull() & w["width"].isNotNull())

    def own(w: Column, *names: str) -> list[Column]:
        return [w[n].alias(n) for n in names]

    def measured(w: Column, i: Column) -> Column:
        end, middle = w["x"] + w["width"], w["x"] + w["width"] / 2
        return F.struct((-w["y"]).alias("down"), i.alias("given"), *own(w, "x", "width", "word"), F.struct(*own(w, *rest)).alias("rest"), end.alias("end"), middle.alias("middle"))

    def lined(down: Column) -> Column:
        starts = _indexes(F.transform(down, lambda w, i: (i == 0) | (w["down"] - F.get(down, i - 1)["down"] > tolerance)))
        return bound(starts, lambda s: bound(F.struct(_slices(down, s).alias("lines"), _cuts(down, F.floor(F.lit(share) * F.size(s)).cast("int"), gutter).alias("cuts")), banded))

    def banded(facts: Column) -> Column:
        across = F.transform(facts["lines"], lambda line: F.exists(facts["cuts"], lambda c: _closed(line, c, gutter)))
        return bound(across, lambda a: bound(_indexes(F.transform(a, lambda own, j: (j > 0) & (own | F.get(a, j - 1)))), lambda breaks: placed(facts, a, breaks)))

    def placed(facts: Column, across: Column, breaks: Column) -> Column:
        def key(w: Column, j: Column, f: Column) -> Column:
            column = F.when(f["across"], 0).otherwise(F.size(F.filter(facts["cuts"], lambda c: c <= w["middle"])))
            return F.struct(f["band"].alias("band"), column.alias("column"), j.alias("line"), *own(w, "x", "width", "word", "given"), *own(w["rest"], *rest))

        def keys(line: Column, j: Column) -> Column:
            return bound(F.struct(F.size(F.filter(breaks, lambda b: b <= j)).alias("band"), F.get(across, j).alias("across")), lambda f: F.transform(line, lambda w: key(w, j, f)))

        return F.sort_array(F.flatten(F.transform(facts["lines"], keys)))

    return pages.withColumn(words, bound(F.sort_array(F.transform(known, measured)), lined))


def _indexes(marks: Column) -> Column:
    """Where an array of booleans is true, from 0."""
    return F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def _slices(array: Column, starts: Column) -> Column:
    """An array of arrays: the pieces of array that begin at starts (from 0, ascending), each up to the next."""
    return F.transform(starts, lambda s, j: F.slice(array, s + 1, F.coalesce(F.get(starts, j + 1), F.size(array)) - s))


def _cuts(words: Column, allowed: Column, gutter: float) -> Column:
    """The middles of the stretches that gutters finds.

    More than allowed words cover what lies from the start number i + allowed on and before
    the end number i, both counted in their own order, whatever i.
    """
    starts, ends = F.sort_array(F.transform(words, lambda w: w["x"])), F.sort_array(F.transform(words, lambda w: w["end"]))
    pieces = bound(starts, lambda s: F.transform(ends, lambda e, i: F.struct(F.get(s, i + allowed).alias("start"), e.alias("end"))))

    def middle(busy: Column, piece: Column, i: Column) -> Column:
        before = F.get(busy, i - 1)["end"]
        return F.when((piece["start"] > before) & (piece["start"] - before >= gutter), (before + piece["start"]) / 2)

    between = bound(F.filter(pieces, lambda p: p["start"] < p["end"]), lambda busy: F.transform(busy, lambda p, i: middle(busy, p, i)))
    return F.filter(between, lambda c: c.isNotNull())


def _closed(line: Column, cut: Column, gutter: float) -> Column:
    """Whether the words of a line lie over a cut, or leave less than a gutter at it."""
    over = F.exists(line, lambda w: (w["x"] < cut) & (w["end"] > cut))
    left = F.array_max(F.transform(F.filter(line, lambda w: w["middle"] < cut), lambda w: w["end"]))
    right = F.array_min(F.transform(F.filter(line, lambda w: w["middle"] >= cut), lambda w: w["x"]))
    return over | F.coalesce(right - left < gutter, F.lit(False))


def lines_of_pages(ordered: DataFrame, *, words: str = "words") -> DataFrame:
    """As lines_in_order for what pages_in_order gives: all columns but words, and at (from 0) and text of each line of a column."""

    def texts(own: Column) -> Column:
        def opens(w: Column, i: Column) -> Column:
            return (i == 0) | bound(F.get(own, i - 1), lambda b: (w["line"] != b["line"]) | (w["column"] != b["column"]) | (w["band"] != b["band"]))

        said = bound(_indexes(F.transform(own, opens)), lambda s: _slices(own, s))
        return F.transform(said, lambda line: F.array_join(F.transform(line, lambda w: w["word"]), " "))

    others = [c for c in ordered.columns if c != words]
    return ordered.select(*others, F.posexplode(bound(F.col(words), texts)).alias("at", "text"))


def lines_in_order(ordered: DataFrame, page: Sequence[str]) -> DataFrame:
    """page keys, at (from 0) and text of the lines of each column, in reading order; ordered is what in_reading_order gives."""
    lines = ordered.groupBy(*page, "band", "column", "line").agg(F.min("place").alias("_first"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("_words"))
    text = F.array_join(F.transform("_words", lambda w: w["word"]), " ")
    return lines.select(*page, (F.row_number().over(Window.partitionBy(*page).orderBy("_first")) - 1).alias("at"), text.alias("text"))


def under_headings(lines: DataFrame, keys: Sequence[str], order: Sequence[str], *, heading: Column, stop: Column, entry: Column, small: bool = False) -> DataFrame:
    """Entries with the heading they stand under: all columns of lines, with heading and entry.

    heading and entry are null for lines that are neither; a heading is no entry. It holds
    until the next one, over columns and pages, or until a line where stop is true. Entries
    under none are left out, so prose between the lists must end them. Where all lines of
    each key are known to be few (small), one window moves them, once at most.
    """
    stops = F.coalesce(stop, F.lit(False))
    said = F.when(stops, F.struct(F.lit(None).cast("string").alias("h"))).when(heading.isNotNull(), F.struct(heading.cast("string").alias("h")))
    columns = [c for c in lines.columns if c not in ("heading", "entry")]
    marked = lines.withColumns({"_said": said, "_entry": F.when(~stops & heading.isNull(), entry)}).where(F.col("_said").isNotNull() | F.col("_entry").isNotNull())
    if small:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = marked.withColumn("_held", F.last("_said", ignorenulls=True).over(so_far))
    else:
        met = over_order(marked, keys, order, last={"_held": F.col("_said")})
    return met.where(F.col("_held.h").isNotNull() & F.col("_entry").isNotNull()).select(*columns, F.col("_held.h").alias("heading"), F.col("_entry").alias("entry"))
