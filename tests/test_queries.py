"""Published queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare_with_sql import compare, connect

FOLDER = "/root/testdata/sf0.001"
FAST = ["vector_topk", "segment_units", "alias_lookup", "cited_tokens", "topic_roots", "run_summary", "legacy_regroup",
        "hybrid_search", "bm25_topk", "history_search", "history_append", "query_modes", "part_invariants", "content_works",
        "index_meta", "embed_batch", "carry_forward_refs", "ablation", "stream_phrase_flags"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
