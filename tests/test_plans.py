"""Physical-plan properties the design relies on (checked on sf0.001 plans, not timings)."""

import pytest

from tests_support import SF001

NO_PAIR_QUERIES = ["knn_batch", "knn_ivf", "sql_join_interval", "sql_join_asof", "chunk_pack",
                   "job_flat_chunks", "job_section_chunks", "clean_text", "dedup_hash_latest",
                   "latest_per_position", "upsert_merge", "retrieve_context", "batch_assign"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    from textmill.plans.registry import queries

    return queries()


@pytest.mark.parametrize("name", NO_PAIR_QUERIES)
def test_no_pairwise_products(spark, qs, name):
    plan = _plan(qs[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, qs):
    plan = _plan(qs["sql_filter_project"](spark, SF001))
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(l_discount,0.02)" in pushed
    # columns the query never touches are pruned from the scan
    assert "l_tax" not in plan and "l_partkey" not in plan


def test_text_pipeline_has_no_key_shuffle(spark, qs):
    plan = _plan(qs["job_flat_chunks"](spark, SF001))
    assert "hashpartitioning" not in plan.lower()


def test_section_job_scans_once_and_shuffles_once(spark, qs):
    plan = _plan(qs["job_section_chunks"](spark, SF001))
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_dedup_aggregates_partially_before_the_shuffle(spark, qs):
    plan = _plan(qs["latest_per_position"](spark, SF001))
    aggregates = [x for x in plan.split("\n") if "Aggregate(" in x]
    assert any("partial_max(struct(" in x for x in aggregates)
    # keys, hashes and places are ranked; content is fetched afterwards, by a hash join that sorts nothing
    assert aggregates and not any("content" in x for x in aggregates)
    assert "ShuffledHashJoin" in plan and not any("content" in x for x in plan.split("\n") if "- Sort [" in x)


def test_top_k_per_group_limits_before_shuffle(spark, qs):
    plan = _plan(qs["sql_topk_group"](spark, SF001))
    assert "WindowGroupLimit" in plan


def test_ingest_prunes_existing_partitions_at_run_time(spark):
    from pyspark.sql import functions as F

    from textmill.operators import ingest as ing
    from textmill.plans import ingest_plans as ip
    from textmill.session import scratch_path

    path = scratch_path(spark, "m") + "/table"
    clock = F.lit(ip.CLOCK).cast("timestamp")
    ing.ingest(spark, ip._v1(spark, SF001), path, clock)
    plan = _plan(ing.plan_ingest(spark, ip._v2(spark, SF001), ing.read_existing(spark, path), clock, buckets=64))
    assert "dynamicpruningexpression(doc_bucket" in plan


def test_sketches_are_one_a_flag_not_one_an_order(spark, qs):
    plan = _plan(qs["sql_agg_approx_distinct"](spark, SF001))
    aggregates = [x for x in plan.split("\n") if "HashAggregate(" in x]
    assert any("approx_count_distinct" in x for x in aggregates)
    assert not any("approx_count_distinct" in x and "l_orderkey" in x.split("functions=")[0] for x in aggregates)


def test_line_probes_read_documents_once_and_run_no_lambda_a_word(spark, qs):
    for name in ("line_is_heading", "line_title_ratio", "line_is_table"):
        plan = _plan(qs[name](spark, SF001))
        assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == 1 and "lambda" not in plan, name


def test_soft_wraps_are_judged_once_a_line(spark, qs):
    plan = _plan(qs["merge_soft_wraps"](spark, SF001)).split("== Initial Plan ==")[-1]
    above, below = plan.split("Window [lag", 1)
    assert "RLIKE" in below and "RLIKE" not in above  # the window carries results, not rules
