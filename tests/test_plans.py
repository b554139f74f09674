"""The plans Spark picks: pruned and pushed scans, one exchange of models and candidates."""

from strainshift.plans import catalog, views as V
from strainshift.operators import regression as G
from strainshift.plans import q_models as Q

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(catalog.QUERIES["entity_filter"](spark, sf))
    assert "EqualTo(event_type,view)" in plan
    assert "props" not in plan and "user_id" not in plan
    plan = plan_of(V.daily_control(spark, sf))
    assert "ReadSchema: struct<l_discount:double,l_shipdate:timestamp_ntz>" in plan


def test_one_scan_where_one_is_enough(spark, sf):
    for name, table in (("threshold_filter", "lineitem"), ("multi_series_align", "orders"), ("distinct_regions", "orders"), ("observables", "orders"),
                        ("split_origin", "orders")):
        plan = plan_of(catalog.QUERIES[name](spark, sf)).split("Subquery")[0]
        scans = [line for line in plan.splitlines() if "FileScan" in line and f"/{table}.parquet" in line]
        assert len(scans) <= (2 if name == "multi_series_align" else 1), (name, len(scans))


def test_date_window_reads_the_shipdate_bounds(spark, sf):
    plan = plan_of(catalog.QUERIES["date_window_filter"](spark, sf))
    scan = [line for line in plan.splitlines() if "lineitem" in line][0]
    assert "l_shipdate" in scan.split("DataFilters")[1]


def test_many_model_fit_shuffles_models_once(spark, sf):
    design = Q.design_rows(spark, sf, Q.part_models(spark, sf))
    fits = G.ancova_fit(G.model_groups(design), ["model_id"])
    main = plan_of(fits).split("Subquery")[0] + plan_of(fits)
    exchanges = [line for line in main.splitlines() if "Exchange hashpartitioning(model_id" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_scoring_shuffles_candidates_once(spark, sf):
    plan = plan_of(catalog.QUERIES["pluggable_score"](spark, sf))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(candidate" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
