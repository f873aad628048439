"""Plan shape: analyses over the materialized customer table read only the columns they use."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_country_rate_scan_is_pruned(spark):
    df = E.queries()["p11_country_rate_topk"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Country:string,Churn:int>" in plan


def test_nation_region_broadcast_in_builder(spark):
    from custaris.plans.customer360 import build_customer360
    plan = build_customer360(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "region.parquet" in plan
