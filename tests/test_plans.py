"""What the planner makes of the queries: pruned scans, top-k without a full sort, no shuffle and no Python where none is needed."""

import pytest

from marlstone.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_top_k_and_pruned_scan(spark, small):
    p = plan(registry.queries()["vector_topk"](spark, small))
    assert "TakeOrderedAndProject" in p
    p = plan(registry.queries()["search_context"](spark, small))
    assert "TakeOrderedAndProject" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "n_chars" not in p.split("== Physical Plan ==")[1].split("ReadSchema")[1].split(">")[0]


@pytest.mark.parametrize("name", ["chunk_regex", "chunk_module", "chunk_markdown", "local_embed_sign", "tokenize_embed", "make_summary", "token_estimate", "query_hash", "temporal_score"])
def test_no_shuffle_and_no_python(spark, small, name):
    p = plan(registry.queries()[name](spark, small)).split("== Physical Plan ==")[1]
    assert "Exchange" not in p
    if name != "chunk_markdown":  # files of several kinds: scripts are read in Arrow batches
        assert "Arrow" not in p and "Python" not in p


def test_pushed_filters(spark, small):
    p = plan(registry.queries()["direct_dependents"](spark, small))
    assert "PushedFilters" in p
    p = plan(registry.queries()["memory_list"](spark, small))
    assert "EqualTo(role,user)" in p


def test_keyed_replace_joins_once(spark, small):
    p = plan(registry.queries()["last_by_key"](spark, small)).split("== Physical Plan ==")[1]
    assert p.count("Exchange hashpartitioning") == 1 and "partial_max_by" in p
