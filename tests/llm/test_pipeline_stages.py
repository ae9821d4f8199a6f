import corpus_pipeline
from rageval.llm import queries
from rageval.llm.common import staged


def test_stages_pass_rows_on(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = staged(stage(spark, docs, None), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert name == "mix" or 0 < docs.count() <= before
    ids = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_empty_tables_pass(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, None), f"empty-{name}")
        assert docs.count() == 0


def test_one_query_for_each_operator():
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
