"""Shapes of physical plans: no cross joins, pushed filters, limits below the shuffle, no Python in native operators."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from marketloom.plans import roles
from marketloom.plans.registry import Tables
from marketloom.operators import search

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NATIVE = (
    "popular_items", "trending_models", "facet_values", "search_page", "wide_star", "detail_views", "similar_in_band", "latest_versions",
    "change_log_rows", "change_history", "merged_rows", "collaborative_recall", "content_recall", "popularity_recall", "item_similarity",
    "brand_top_sellers", "compared_items", "session_profiles", "nested_categories", "item_documents", "text_constraints", "page_links",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_and_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert shape not in plan, shape


@pytest.mark.parametrize("name", ["recommended_for_users", "vector_neighbors"])
def test_python_steps_have_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["latest_versions", "recent_seeds", "bounded_children", "user_history"])
def test_top_n_is_limited_below_the_shuffle(spark, name):
    assert plan_of(queries()[name](spark, FOLDER)).count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark):
    test = search.facet_filter("title", at_most={"price": 950})
    plan = plan_of(roles.items(Tables(spark, FOLDER)).filter(test).select("item", "price"))
    assert "LessThanOrEqual(p_retailprice,950" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_retailprice:double>" in plan


def test_paging_keeps_few_rows_per_task(spark):
    plan = plan_of(search.page_of(roles.items(Tables(spark, FOLDER)), [F.col("price"), F.col("item")], page=2, page_size=10))
    assert "TakeOrderedAndProject" in plan
