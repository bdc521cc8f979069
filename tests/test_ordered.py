"""Ordered computations against plain windows, over many small parts and over one key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumframe.operators import joins, ordered, windows


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    made = [(draw.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), k, draw.choice([None, None, k]), draw.choice([None, draw.randrange(9)]), draw.choice(["x", None])) for k in range(3000)]
    return spark.createDataFrame(made, "key string, at long, seen long, n long, party string").repartition(5).cache()


def same(one, two):
    assert sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, two.select(*sorted(two.columns)).collect()))


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("parts", [1, 7, 300])
def test_over_order_equals_windows(rows, keys, parts):
    got = ordered.over_order(rows, keys, ["at"], last={"l": F.col("seen"), "p": F.col("party")}, total={"t": F.col("n")}, previous={"v": F.col("n")}, parts=parts)
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.last(o, ignorenulls=True).over(so_far) for c, o in (("l", "seen"), ("p", "party"))}
    same(got, rows.withColumns(last | {"t": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "v": F.lag("n").over(order)}))


def test_descending_order_and_empty_table(rows):
    got = ordered.over_order(rows, ["key"], [F.col("at").desc()], previous={"v": F.col("at")}, parts=20)
    same(got, rows.withColumn("v", F.lead("at").over(Window.partitionBy("key").orderBy("at"))))
    assert ordered.over_order(rows.where("false"), ["key"], ["at"], total={"t": F.col("n")}).count() == 0


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_fill_asof_and_runs_equal_their_window_versions(rows, keys):
    same(ordered.filled_forward(rows, "seen", keys, ["at"], into="f", carry=["party"], parts=40), windows.forward_fill(rows, "seen", keys, ["at"], into="f", carry=["party"]))
    left, right = rows.where("at % 3 > 0"), rows.where("at % 3 = 0").select("key", (F.col("at") - F.col("at") % 2).alias("at"), F.col("n").alias("m"), F.col("at").alias("from"))
    right = right if keys else right.drop("key")
    same(ordered.asof(left, right, keys, "at", ["m", "from"], parts=40), joins.asof_join(left, right, keys, "at", ["m", "from"]))
    gaps = rows.where("at % 17 <> 3 and key is not null")
    same(ordered.longest_run(gaps, keys, "at", F.lit(1), parts=40), windows.longest_island(gaps, keys, "at", F.lit(1)))


def test_one_key_is_dealt_over_all_tasks(spark):
    many = spark.range(300_000).select(F.lit("one").alias("key"), "id", (F.col("id") % 1000 == 0).cast("long").alias("mark"))
    got = ordered.over_order(many, ["key"], ["id"], total={"t": F.col("mark")}, parts=32)
    assert got.where(F.col("t") != F.floor(F.col("id") / 1000) + 1).count() == 0
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 200_000


def test_sessions(spark):
    rows = spark.sql("SELECT 'u' AS user, id, timestamp_seconds(1000 + id * 60 + CASE WHEN id >= 50 THEN 600 ELSE 0 END) AS ts FROM range(100)")
    got = {r.id: r.session for r in ordered.sessions(rows, ["user"], "ts", "id", 300, parts=9).collect()}
    assert got == {k: 1 if k < 50 else 2 for k in range(100)}
