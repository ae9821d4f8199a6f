"""Answer functions, files read by name, dense parts, ordered first rows, scratch folders and the stage cache."""

import os
import shutil
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rageval import session
from rageval.operators import dense, generate, ground_truth, lexical, router
from rageval.operators.common import first_n
from rageval.sources import tables, tsv

ROWS = "llm string, query_id long, doc_id long, prompt string"


def rows_of(spark, models):
    return spark.createDataFrame([(m, i, i, f"p{i}") for i, m in enumerate(models)], ROWS).coalesce(1)


def test_interleaved_models_get_their_own_answers(spark):
    rows = rows_of(spark, ["a", "b", "a", "c", "b", "a", None])
    for kind in (list, pd.Series, np.array):
        out = generate.answer_with_fn(rows, lambda llm, p, kind=kind: kind([f"{llm}:{x}" for x in p])).collect()
        assert sorted((r.doc_id, r.answer, r.error) for r in out) == [
            (i, f"{m}:p{i}", None) for i, m in enumerate(["a", "b", "a", "c", "b", "a", None])]


def test_wrong_number_of_answers_is_a_failure(spark):
    out = generate.answer_with_fn(rows_of(spark, ["a", "a", "a"]), lambda llm, p: ["x"], max_attempts=2).collect()
    assert [(r.answer, r.error) for r in out] == [("x", None)] * 3  # one prompt at a time, the number is right
    out = generate.answer_with_fn(rows_of(spark, ["a", "a"]), lambda llm, p: [], max_attempts=2).collect()
    assert all(r.answer is None and "0 answers" in r.error for r in out)


def test_failures_are_retried_and_isolated(spark):
    folder = tempfile.mkdtemp(prefix="attempts-")

    def flaky(llm, prompts):
        for p in prompts:
            if p == "p1":
                raise RuntimeError("always")
            if p == "p2":
                path = os.path.join(folder, f"{llm}-{len(os.listdir(folder))}")
                open(path, "w").close()
                if len(os.listdir(folder)) < 3:
                    raise RuntimeError("twice")
        return [p.upper() for p in prompts]

    out = {r.doc_id: (r.answer, r.error) for r in generate.answer_with_fn(rows_of(spark, ["a"] * 4), flaky, max_attempts=3).collect()}
    assert out[0] == ("P0", None) and out[2] == ("P2", None) and out[3] == ("P3", None)
    assert out[1][0] is None and "always" in out[1][1]


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(path)
    with open(os.path.join(path, "part-0.csv"), "w") as f:
        f.write(text)
    return path


def test_columns_are_found_by_name(spark):
    folder = tempfile.mkdtemp(prefix="tsv-")
    path = write(folder, "a_judged.tsv", 'Document\tlabel\tQuery\textra\n"d\n1"\t1\tq1\tx\nd2\tnone\tq2\ty\n')
    got = tsv.read_tsv(spark, path, "Query string, Document string, label int").collect()
    assert sorted(map(tuple, got), key=str) == [("q1", "d\n1", 1), ("q2", "d2", None)]
    with pytest.raises(ValueError, match="missing"):
        tsv.read_tsv(spark, write(folder, "b_judged.tsv", "foo\tbar\n1\t2\n"), "Query string, Document string")
    with pytest.raises(ValueError):  # each member of a folder is read by its own header
        tsv.read_suffix_dir(spark, folder, "_judged.tsv", "Query string")
    write(folder, "c_judged.tsv", "Query\nq3\n")
    names = tsv.read_suffix_dir(spark, folder, "_judged.tsv", "Query string", exclude=("b",)).select("retriever", "Query")
    assert sorted(map(tuple, names.collect())) == [("a", "q1"), ("a", "q2"), ("c", "q3")]
    with pytest.raises(ValueError, match="missing_model"):
        tsv.require_members(spark, folder, "_judged.tsv", ["a", "missing_model"])


def test_dense_search_in_parts_and_pieces(spark):
    rng = np.random.default_rng(0)
    d, q = rng.normal(size=(400, 6)).round(1), rng.normal(size=(70, 6)).round(1)
    d[10:14] = d[9]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, vec array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    got = dense.dense_search(asked, docs, 5, part_rows=90, max_cells=1000).collect()
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    for i in range(70):
        want = sorted(range(400), key=lambda j: (-round(cos[i, j], 10), -j))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want
    assert dense.dense_search(asked.limit(0), docs, 5).count() == 0 and dense.dense_search(asked, docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("n", [0, 1, 17, 500, 1000, 2000])
def test_first_rows_of_an_order(spark, n):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    got = first_n(df, [F.col("id").desc()], n, lambda x: x.checkpoint())
    assert sorted(r.id for r in got.collect()) == list(range(max(0, 1000 - n), 1000))


def test_contained_token_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a  b\tc"), (3, "b a c"), (4, "xa b c"), (5, "a b"), (6, "the the")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "a"), (4, "zz a"), (5, " "), (6, None), (7, "a b c")], "query_id long, text string")
    index = lexical.build_index(docs, lexical.WS)
    got = sorted(map(tuple, ground_truth.containment_pairs(index, docs, asked).collect()))
    assert got == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 4), (3, 1), (3, 2), (3, 3), (3, 5), (7, 1), (7, 2)]


def test_folded_vectors_use_all_components(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0, 5.0],), ([],)], "v array<float>")
    assert [list(r.f) for r in df.select(tables.folded(F.col("v")).alias("f")).collect()] == [[5.0, 5.0], [6.0, 4.0], []]


def test_naive_bayes_by_hand(spark):
    feats = spark.createDataFrame([(1, 1, 0, "red red blue"), (2, 1, 1, "green"), (3, 1, 0, "red")], "query_id long, doc_id long, label int, router_text string")
    model = router.fit_naive_bayes(feats, 3, lambda df: df, smoothing=1.0)
    assert model.rows == (2, 1, 0) and model.totals == (4, 1, 0) and model.n_tokens == 3
    one = spark.createDataFrame([(9, 9, "red unseen")], "query_id long, doc_id long, router_text string")
    got = router.naive_bayes_scores(model, one).first()["scores"]
    assert got[2] is None
    assert got[0] == pytest.approx(np.log(2 / 3) + np.log(4 / 7), abs=1e-8) and got[1] == pytest.approx(np.log(1 / 3) + np.log(1 / 4), abs=1e-8)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    assert session.is_single_machine("local[8]") and not session.is_single_machine("local-cluster[2,1,1024]")


def test_buckets_follow_the_data():
    assert session.buckets_for(0) == session.LEAST_BUCKETS
    assert session.buckets_for(100 << 40) == (100 << 40) // session.BUCKET_BYTES


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver test data not present")
def test_changed_input_gives_new_stages_and_tables_are_dropped(spark):
    from rageval.plans.fixtures import fixtures
    folder = tempfile.mkdtemp(prefix="changed-")
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    first = fixtures(spark, folder)
    n, tables_made = first.corpus.count(), list(first._tables)
    assert fixtures(spark, folder) is first and tables_made
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    docs["text"] += " one more"
    os.remove(f"{folder}/documents.parquet")
    docs[docs.doc_id % 2 == 0].to_parquet(f"{folder}/documents.parquet")
    second = fixtures(spark, folder)
    assert second is not first and 0 < second.corpus.count() < n
    left = {t.name for t in spark.catalog.listTables()}
    assert not left & {t.lower() for t in tables_made} and not left & set(tables_made)
    second.close()
