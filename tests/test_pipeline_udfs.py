"""Pluggable encoder / judge functions and the whole pipeline on the smallest data."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from rageval.operators import consensus as C
from rageval.operators import dense

SF = "/root/testdata/sf0.001"


def test_embed_texts_then_dense_search(spark):
    def char_hash_encoder(texts):
        out = np.zeros((len(texts), 16), dtype=np.float32)
        for i, t in enumerate(texts):
            for ch in t:
                out[i, ord(ch) % 16] += 1.0
        return out

    docs = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "abab")], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "aaab")], "query_id long, text string")
    d = dense.embed_texts(docs, "text", char_hash_encoder).select("doc_id", "vec")
    q = dense.embed_texts(qs, "text", char_hash_encoder).select("query_id", "vec")
    out = [r.doc_id for r in dense.dense_search(q, d, 2).orderBy("rank").collect()]
    assert out == [1, 3]


def test_external_judge_fn(spark):
    corpus = spark.createDataFrame([(1, "yes doc"), (2, "no doc")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "q")], "query_id long, text string")
    pairs = spark.createDataFrame([("r", 1, 1, 1), ("r", 1, 2, 2)], "retriever string, query_id long, doc_id long, rank int")
    fn = lambda q, d: pd.Series([int(x.startswith("yes")) for x in d])
    got = sorted((r.doc_id, r.prediction) for r in C.judge_pairs(pairs, corpus, qs, judge_fn=fn).collect())
    assert got == [(1, 1), (2, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_whole_pipeline_writes_every_stage(spark):
    from rageval.plans.pipeline import run_pipeline
    out = tempfile.mkdtemp(prefix="pipeline-")
    paths = run_pipeline(spark, SF, out)
    assert spark.read.parquet(paths["leaderboard"]).count() == 8
    assert spark.read.parquet(paths["best_llm"]).count() == 1
    assert spark.read.parquet(paths["routing_eval"]).count() >= 1
    from rageval.sources import tsv
    txt = tsv.read_tsv(spark, paths["consensus_results.tsv"],
                       "query_id long, rank int, Query string, Document string, is_sentinel int")
    sentinel = txt.where("is_sentinel = 1").collect()
    assert all(r.Document == "No Relevant Information Available" for r in sentinel)
    assert txt.count() == spark.read.parquet(paths["runs"]).where("retriever = 'consensus'").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_a_run_is_taken_up_after_its_finished_stages(spark, monkeypatch):
    from rageval.plans import pipeline
    out = tempfile.mkdtemp(prefix="pipeline-")
    paths = pipeline.run_pipeline(spark, SF, out)

    def times():
        return {name: os.path.getmtime(os.path.join(path, "_SUCCESS")) for name, path in paths.items()}
    before = times()
    os.remove(os.path.join(paths["leaderboard"], "_SUCCESS"))   # as if it had been cut short
    own = pipeline.made_from(pipeline.fixtures(spark, SF))
    os.remove(os.path.join(paths["best_llm"], pipeline.MARK + own))  # made from other tables
    assert pipeline.run_pipeline(spark, SF, out, mode="resume") == paths
    changed = {name for name, t in times().items() if t != before[name]}
    assert changed == {"leaderboard", "best_llm"}
    assert spark.read.parquet(paths["leaderboard"]).count() == 8
    monkeypatch.setattr(pipeline, "listing", lambda *_: ())      # other tables: everything is made anew
    other = pipeline.made_from(pipeline.fixtures(spark, SF))
    assert other != own and not any(pipeline.finished(spark, p, other) for p in paths.values())
