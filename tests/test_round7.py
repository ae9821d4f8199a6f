"""Full-text match of all queries at once, and rows of the learned encoder that are hashed once."""

import numpy as np
import pyarrow as pa

from rageval.operators import encoder, lexical
from rageval.plans.fixtures import Fixtures


def found(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


def folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "Été", "word", "word."], int(rng.integers(51, 90)))) + (f" rare{i % 9}" if i % 2 else "")) for i in range(120)]
    docs += [(500 + i, f"{'same ' * 60}twin") for i in range(2)] + [(700, None), (701, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "alpha été rare3 rare3"), (2, "twin same unheard"), (3, None), (4, " "), (5, "unheard"), (6, "word rare1 rare5 beta")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return Fixtures(spark, str(tmp_path))


def test_match_of_all_queries_at_once(spark, tmp_path, monkeypatch):
    fx = folder(spark, tmp_path)
    plain = lexical.LexicalIndex(**{**fx.std_index.__dict__, "impacts": None})
    for k in (1, 3, 200):
        scored = lexical.match_search(fx.std_index, fx.queries, k, small=True)
        assert found(scored) == found(lexical.match_search(plain, fx.queries, k, small=True))
    assert "_made" not in fx.std_index.impacts.__dict__  # no blocks of postings are written for so few terms
    monkeypatch.setattr(lexical, "MATRIX_BM25_TERMS", 3)
    assert found(lexical.match_search(fx.std_index, fx.queries, 3, small=True)) == found(lexical.match_search(plain, fx.queries, 3, small=True))
    assert "_made" in fx.std_index.impacts.__dict__
    fx.close()


def test_texts_are_hashed_once_for_the_learned_encoder(spark, tmp_path, monkeypatch):
    fx, rows, hashed = folder(spark, tmp_path), encoder.term_rows, []
    monkeypatch.setattr(encoder, "term_rows", lambda texts, *a: hashed.append(texts.columns) or rows(texts, *a))
    got = fx.dense_learned().collect()
    assert {r["query_id"] for r in got} == {1, 2, 5, 6} and sorted(map(tuple, hashed)) == [("doc_id", "text"), ("query_id", "text")]
    fx.close()


def test_products_of_sparse_rows(spark, monkeypatch):
    """Frequent features in dense matrices or not, rows cut anywhere, null and empty ones among them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.4, int(rng.integers(1, 40))) if x < 1000) for _ in range(300)] + [None, "", "t1 t1"]
    rows = encoder.term_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 64)
    got = sorted(rows.collect())
    assert [r["doc_id"] for r in got] == list(range(303)) and got[300]["idx"] == got[301]["tf"] == [] and got[302]["tf"] == [2]
    idf, directions = rng.random(64), rng.standard_normal((64, 5))
    idf[got[302]["idx"][0]] = 0
    x = np.zeros((303, 64))
    for i, r in enumerate(got):
        x[i, r["idx"]] = (1 + np.log(np.array(r["tf"], float))) * idf[r["idx"]]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=x, where=norm > 0)
    assert np.allclose(encoder.rows_with(rows, 64), [sum(k in r["idx"] for r in got) for k in range(64)])
    idx, tf = (pa.array([r[c] for r in got], pa.list_(pa.int32())) for c in ("idx", "tf"))
    assert np.allclose(encoder.projected(*encoder.unit_rows(idx, tf, idf), directions), x @ directions)
    for n in (0, 7, 64):
        frequent = np.full(64, -1)
        frequent[rng.permutation(64)[:n]] = np.arange(n)
        assert np.allclose(encoder.covariance_product(rows, idf, directions, frequent), x.T @ (x @ directions))
        out = np.ones((64, 5))
        encoder.added_product(out, *encoder.unit_rows(idx, tf, idf), directions, frequent)
        assert np.allclose(out - 1, x.T @ (x @ directions))
