"""The pipeline, stage by stage and as a whole, and the published queries against their SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare_with_sql import compare, connect
from quillspan.llm import catalogue
from quillspan.llm.common import load

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_all_queries_are_published():
    assert {n.split("_")[0] for n in catalogue.queries()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_stages_act_on_what_the_one_before_kept(spark):
    docs, columns = load(spark, FOLDER, "documents"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES:
        from quillspan.llm.common import stored

        before, now = now, stored(stage(spark, now, FOLDER))
        columns = now.columns
        assert columns == docs.columns
        sizes.append(now.count())
        assert set(r.doc_id for r in now.select("doc_id").collect()) <= set(r.doc_id for r in before.select("doc_id").collect())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3] and sizes[5] < sizes[4]
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[5]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, extra array<int>"
    rows = [(1, "same text in two rows here", "en", "a", 5, "i", "k", [1])] * 2 + [
        (None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "i", None, []), (3, "word " * 5000, "fr", None, 9, "", "", [2])]
    made = stage(spark, spark.createDataFrame(rows, schema), FOLDER)
    assert made.columns == [c.split()[0] for c in schema.split(", ")]
    made.collect()
    assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0


