"""Documents' terms are counted in batches and stored a row per document; tf-idf scores are added up for all queries at once."""

import pytest
from pyspark.sql import functions as F

from rageval.functions import text as T
from rageval.operators import ground_truth, lexical
from rageval.operators.common import zero_backfill
from rageval.plans.fixtures import Fixtures
from rageval.sources.tables import nonblank


def found(df):
    return sorted((r["query_id"] or 0, r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


def folder(spark, path, docs, asked):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return Fixtures(spark, str(path))


DOCS = [(i, f"{'word ' * 60}own{i} term{i % 3} other{i % 7} " + "term1 " * (i % 4)) for i in range(80)] + [(90, "Some " * 70)]
ASKED = [(1, "term1 other2"), (2, "own5 own5 word"), (3, None), (4, "unknown words"), (5, " "), (None, "term2"), (6, "term1 Term1"), (6, "other3")]


def test_postings_are_stored_a_row_per_document(spark, tmp_path):
    fx = folder(spark, tmp_path, DOCS, ASKED)
    for index, kind in ((fx.ws_index, lexical.WS), (fx.std_index, lexical.STD)):
        assert index.terms.count() == len(DOCS)
        toks = fx.corpus.select("doc_id", lexical.tokenize(kind, "text").alias("toks"))
        want = toks.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("token")).groupBy("doc_id", "dl", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        assert index.postings.dtypes == want.dtypes
        assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, want.collect()))
    counted = lexical.term_counts(fx.corpus.select("doc_id", lexical.tokenize(lexical.WS, "text").alias("toks")))
    assert counted._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # tokens are counted once
    fx.close()


@pytest.mark.parametrize("cells", [2_000_000, 1])
@pytest.mark.parametrize("k", [1, 3, 100])
def test_tfidf_search_is_that_of_all_pairs(spark, tmp_path, monkeypatch, k, cells):
    monkeypatch.setattr(lexical, "MATRIX_CELLS", cells)
    fx = folder(spark, tmp_path, DOCS, ASKED)
    got = lexical.tfidf_search(fx.tfidf, fx.queries, k, small=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    pairs = lexical.tfidf_scores(fx.tfidf, fx.queries, True)
    assert found(got) == found(zero_backfill(pairs, nonblank(fx.queries), fx.corpus, k, ascending=False))
    monkeypatch.setattr(lexical, "MATRIX_TERMS", 2)
    many = lexical.tfidf_search(fx.tfidf, fx.queries, k, small=True)
    assert "MapInArrow" not in many._jdf.queryExecution().optimizedPlan().toString() and found(many) == found(got)
    fx.close()


def test_ids_that_repeat_are_searched_as_before(spark, tmp_path):
    fx = folder(spark, tmp_path, [*DOCS, (3, "term1 " * 80), (None, "term2 " * 80)], ASKED)
    assert fx.std_index.terms is None and fx.tfidf_run(3).count() > 0
    fx.close()


def test_contained_pairs_are_made_once(spark, tmp_path):
    fx = folder(spark, tmp_path, DOCS, ASKED)
    made = []
    labels = spark.createDataFrame([(1,), (5,)], "doc_id long")
    pool = spark.createDataFrame([(1, 1), (1, 5), (2, 5)], "query_id long, doc_id long")
    got = ground_truth.qrels(fx.ws_index, fx.corpus, fx.queries, labels, pool, small=True, cut=lambda df: made.append(df) or fx.cut(df))
    assert len(made) == 1 and got._jdf.queryExecution().optimizedPlan().toString().count("contains") == 0
    assert {(1, 5, 0)} <= set(map(tuple, got.collect()))
    fx.close()


def test_ascii_words_are_compared_with_one_range_first(spark):
    texts = [("a " * 51,), ("é " * 51,), ("~ !　" * 25 + "x",), ("a " * 50,), ("\x7f\x1f\x00 " * 30,), (None,), ("",), (" \x85 a",)]
    df = spark.createDataFrame(texts, "text string")
    for n in (0, 1, 50):
        assert df.where(~(T.word_count("text") > n).eqNullSafe(T.more_words_than("text", n))).isEmpty(), n
    assert "[!-~" in df.select(T.more_words_than("text", 50))._jdf.queryExecution().optimizedPlan().toString()
