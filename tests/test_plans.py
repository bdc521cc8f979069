"""What the plans must do: filters and columns reach the scan, no Python where expressions do, one pass for ratios."""

import re

import quorumframe.queries as own

FOLDER = "/root/testdata/sf0.001"


def _plan(spark, name):
    return own.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "trend_year")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_mktsegment,BUILDING\)", plan)
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(schema.split(",")) <= 4


def test_counts_of_all_points_read_keys_only(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", _plan(spark, "count_total"))
    assert all("o_totalprice" not in s and "c_acctbal" not in s for s in schemas)


def test_relational_queries_run_without_python(spark):
    with_python = {name for name in own.QUERIES if re.search("Python|Arrow|Pandas", _plan(spark, name))}
    assert with_python <= {"knn_topk", "knn_threshold", "prototype_match", "retrieve_context", "chunk_overlap", "jaccard_topk", "token_overlap_match", "sources_to_blocks", "gazetteer_hits", "theme_of_label", "labels_from_texts", "question_themes", "ambiguous_places", "aligned_turns"}


def test_ratios_take_one_pass(spark):
    assert _plan(spark, "ratio_total_subset").count("Scan parquet") <= 4  # orders and customer, also in the plan before adaptation


def test_rankings_keep_only_the_top(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "rank_submitter")


def test_groups_that_amend_a_point_are_paired_where_they_are(spark):
    from quorumframe.plans.facts import Facts
    from quorumframe.plans.spec import QuerySpec, compiled

    point = spark.createDataFrame([(1, "x"), (2, None), (3, "pregunta"), (4, "x"), (None, "x")], "point_id long, point_type string")
    amendment = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (4, "a"), (9, "a"), (9, "b"), (None, "a"), (None, "b")], "point_id long, group_id string")
    found = compiled(QuerySpec("coauthors"), Facts(point=point, amendment=amendment))
    assert [tuple(r) for r in found.collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join") == 1  # with the points only
