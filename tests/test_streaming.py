"""Incremental judging: a second arrival is judged once, earlier files are not re-judged."""

import tempfile

from rageval.sources import tsv
from rageval.streaming.incremental import judge_new_runs


def test_new_run_files_judged_once(spark):
    corpus = spark.createDataFrame([(1, "apple pie recipe"), (2, "car engine")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple pie")], "query_id long, text string")
    runs_dir, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("runs-", "judged-", "ck-"))
    r1 = spark.createDataFrame([(1, 1, 1)], "query_id long, doc_id long, rank int")
    tsv.write_tsv(r1, f"{runs_dir}/bm25_results.tsv")
    judge_new_runs(spark, runs_dir, out, corpus, queries, checkpoint=ck)
    r2 = spark.createDataFrame([(1, 2, 1)], "query_id long, doc_id long, rank int")
    tsv.write_tsv(r2, f"{runs_dir}/tfidf_results.tsv")
    judge_new_runs(spark, runs_dir, out, corpus, queries, checkpoint=ck)
    got = sorted((r.retriever, r.doc_id, r.prediction) for r in spark.read.parquet(out).collect())
    assert got == [("bm25", 1, 1), ("tfidf", 2, 0)]


def test_columns_go_by_name(spark):
    corpus = spark.createDataFrame([(1, "apple pie recipe"), (2, "car engine")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "apple pie")], "query_id long, text string")
    runs_dir, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("runs-", "judged-", "ck-"))
    tsv.write_tsv(spark.createDataFrame([(1, 1, "x", 7), (2, 2, "y", 7)], "rank int, doc_id long, note string, query_id long"), f"{runs_dir}/bm25_results.tsv")
    judge_new_runs(spark, runs_dir, out, corpus, queries, checkpoint=ck)
    got = sorted((r.retriever, r.query_id, r.doc_id, r["rank"], r.prediction) for r in spark.read.parquet(out).collect())
    assert got == [("bm25", 7, 1, 1, 1), ("bm25", 7, 2, 2, 0)]
