"""The typed tables that questions are answered from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.operators.closure import transitive_closure
from quorumframe.registry import read

#: Point types that are no propositions.
NOT_PROPOSITIONS = ("pregunta", "dacion_cuenta", "tramite", "debate_estado_ciudad", "informe_iniciativa")

TABLES = ("point", "submitter", "theme", "point_theme", "group_vote", "vote", "person_vote", "signer", "amendment", "speech", "place", "district", "session", "term")


class Facts:
    """Tables by their canonical columns, each a DataFrame or a function that reads one.

    A function is called when a question first needs its table, so what no question
    needs is never opened. Rows of relations may be repeated; all measures count
    distinct keys.

    point: point_id, session_date, year, month, title, point_type, person_id, result, amount, and group_id, place_id unless submitter has them
    submitter: person_id (unique), group_id, place_id
    point_theme: point_id, theme_id;  theme: theme_id, label, parent_id (null: a root)
    group_vote: point_id, group_id, direction;  vote: point_id, ord, group_id, direction, is_decisive
    person_vote: point_id, person_id, direction;  signer: point_id, person_id
    amendment: amendment_id, point_id, group_id, result
    speech: speech_id, point_id, ord, speaker, group_id, summary
    place: place_id, label, district_id;  district: district_id, label
    session: session_date, type;  term: term_id, start, end (half-open)
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if unknown := tables.keys() - set(TABLES):
            raise TypeError(f"no such tables: {', '.join(sorted(unknown))}")
        self._given = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        given = self._given.get(name)
        if given is None:
            raise LookupError(f"these facts have no table {name}")
        found = given() if callable(given) else given
        setattr(self, name, found)
        return found

    def points(self, columns: Iterable[str]) -> DataFrame:
        """All points with at least these columns; the submitter is joined only where one of its columns is asked for."""
        more = set(columns) - {"person_id"}
        if "submitter" in self._given and more & set(self.submitter.columns):
            return self.point.join(self.submitter, "person_id", "left")
        return self.point

    def propositions(self, columns: Iterable[str]) -> DataFrame:
        """Points that are propositions; a null type counts as one."""
        return self.points(columns).where(F.col("point_type").isNull() | ~F.col("point_type").isin(*NOT_PROPOSITIONS))

    @cached_property
    def themes_above(self) -> DataFrame:
        """child, parent: each theme with all that stand above it."""
        return transitive_closure(self.theme.where("parent_id is not null").select(F.col("theme_id").alias("child"), F.col("parent_id").alias("parent")))

    def treating(self, themes: Iterable) -> DataFrame:
        """point_id of the points that treat one of the themes or any below them; may repeat."""
        wanted = list(themes)
        below = self.themes_above.where(F.col("parent").isin(*wanted)).select(F.col("child").alias("theme_id"))
        own = below.sparkSession.createDataFrame([(t,) for t in wanted], "theme_id " + self.point_theme.schema["theme_id"].dataType.simpleString())
        return self.point_theme.join(own.unionByName(below), "theme_id", "left_semi").select("point_id")

    @cached_property
    def point_theme_closure(self) -> DataFrame:
        """Each point with its themes and all that stand above them; the chain of treats and broader."""
        rolled = self.point_theme.join(self.themes_above, F.col("theme_id") == F.col("child")).select("point_id", F.col("parent").alias("theme_id"))
        return self.point_theme.select("point_id", "theme_id").unionByName(rolled).distinct()


def star_schema_facts(spark: SparkSession, folder: str) -> Facts:
    """Facts over a star schema of orders: an order is a point, its customer's segment the group, nations are places and themes, regions what stands above them."""

    def table(name: str) -> DataFrame:
        return read(spark, folder, name)

    day = F.to_date("o_orderdate")

    def point() -> DataFrame:
        return table("orders").select(F.col("o_orderkey").alias("point_id"), day.alias("session_date"), F.year(day).alias("year"), F.month(day).alias("month"), F.concat_ws(" ", F.lit("Order"), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("point_type"), F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("result"), F.col("o_totalprice").alias("amount"))

    def line() -> DataFrame:
        return table("lineitem").join(table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))

    def theme() -> DataFrame:
        roots = table("region").select((F.col("r_regionkey") + 1000).alias("theme_id"), F.col("r_name").alias("label"), F.lit(None).cast("int").alias("parent_id"))
        return roots.unionByName(table("nation").select(F.col("n_nationkey").alias("theme_id"), F.col("n_name").alias("label"), (F.col("n_regionkey") + 1000).alias("parent_id")))

    def term() -> DataFrame:
        rows = [(1, "1995-01-01", "1997-06-15"), (2, "1997-06-15", "1999-06-15"), (3, "1999-06-15", "2003-06-15")]
        return spark.createDataFrame(rows, "term_id int, start string, end string").select("term_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))

    key = F.col("l_orderkey").alias("point_id")
    return Facts(
        point=point,
        submitter=lambda: table("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("group_id"), F.col("c_nationkey").alias("place_id")),
        theme=theme,
        point_theme=lambda: line().select(key, F.col("s_nationkey").alias("theme_id")),
        group_vote=lambda: line().select(key, F.col("s_nationkey").alias("group_id"), F.col("l_returnflag").alias("direction")),
        vote=lambda: line().select(key, F.col("l_linenumber").alias("ord"), F.col("s_nationkey").alias("group_id"), F.col("l_returnflag").alias("direction")),
        person_vote=lambda: table("lineitem").select(key, F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("direction")),
        signer=lambda: table("lineitem").where("l_linenumber = 1").select(key, F.col("l_suppkey").alias("person_id")),
        amendment=lambda: line().where("l_linestatus = 'F'").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("amendment_id"), key, F.col("s_nationkey").alias("group_id"), F.col("l_returnflag").alias("result")),
        speech=lambda: table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("speech_id"), F.col("conv_id").alias("point_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), F.when(F.col("role") != "system", F.col("role")).alias("group_id"), F.col("text").alias("summary")),
        place=lambda: table("nation").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("district_id")),
        district=lambda: table("region").select(F.col("r_regionkey").alias("district_id"), F.col("r_name").alias("label")),
        session=lambda: table("orders").select(day.alias("session_date")).distinct().withColumn("type", F.when(F.dayofmonth("session_date") == 1, "constitutive").otherwise("ordinary")),
        term=term,
    )
