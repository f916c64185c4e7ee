"""Plans keep their shape: narrow scans, no cartesian products, no payload in shuffles."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup
from tessera.plans import data_queries, reference_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
#: Queries that put a stated set of queries, or a single row, against the whole table.
STATED = {"substring_occurrences", "lexical_topk", "vector_topk", "rrf_fusion", "lexical_only_fusion", "keyword_hits", "module_boost_rerank", "metadata_match_weights", "route_scores", "route_decision", "eval_retrieval", "runtime_topk", "runtime_answers", "ledger_totals", "hybrid_fusion", "verified_metadata", "status_counts"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(df):
    return re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>[^>]*)*)>", plan(df))


@pytest.mark.parametrize("name", sorted(set(data_queries.QUERIES) - {"p4_report", "p4_found"}) + sorted(reference_queries.QUERIES))
def test_no_products(spark, name):
    q = (data_queries.QUERIES | reference_queries.QUERIES)[name]
    if name in ("vault_violations", "import_closure"):
        pytest.skip("runs jobs while it is planned")
    text = plan(q(spark, FOLDER))
    assert "CartesianProduct" not in text
    if name not in STATED:
        assert "BroadcastNestedLoopJoin" not in text


def test_identities_read_and_shuffle_narrow_rows(spark):
    df = dedup.lost_messages(spark.read.parquet(f"{FOLDER}/message.parquet"), {"row_no": F.col("row_no")})  # the pass p1_found and p1_messages begin with
    assert "message_content" not in plan(df) and schemas(df)
    assert "message_content" not in plan(data_queries.p1_found(spark, FOLDER)) and "Exchange hashpartitioning" not in plan(data_queries.p1_found(spark, FOLDER))
    assert all({c.split(":")[0] for c in s.split(",")} <= {"row_no", "conversation_id", "local_id", "server_id", "create_time"} for s in schemas(df))


def test_wide_table_is_not_shuffled(spark):
    text = plan(data_queries.p1_messages(spark, FOLDER))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_filters_reach_the_scan(spark):
    text = plan(reference_queries.scan_scope_filter(spark, FOLDER))
    assert "PushedFilters" in text and "page_type" in re.search(r"PushedFilters: \[(.*?)\]", text)[1] and "text" not in "".join(schemas(reference_queries.scan_scope_filter(spark, FOLDER)))


def test_top_k_limits_before_the_shuffle(spark):
    text = plan(reference_queries.vector_topk(spark, FOLDER))
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")
