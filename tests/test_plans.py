"""What the plans of the queries must look like, whatever the size of the tables."""

import pytest

from hearthlake.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith(("source_", "details_"))))
def test_no_pairs_of_everything(spark, name):
    found = plan(spark, name)
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


@pytest.mark.parametrize("name", ["search_basic", "search_new", "search_text", "facet_source_order", "median_price_by_source"])
def test_unused_lookups_are_not_read(spark, name):
    """Neither history nor searches are scanned where nothing asks for them."""
    assert "l_shipdate" not in plan(spark, name) and "l_extendedprice" not in plan(spark, name)


def test_a_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "search_basic") and "TakeOrderedAndProject" in plan(spark, "detail_queue")


def test_filters_reach_the_scan(spark):
    found = registry.QUERIES["prune_keep"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in found
    columns = registry.QUERIES["page_markers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in columns
