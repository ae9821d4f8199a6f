"""Hand-built edge cases (FIXTURES.md section 4) and invariants, with expected rows written by hand."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rageval.functions import text as T
from rageval.operators import consensus as C
from rageval.operators import dense, fusion, generate, lexical, metrics
from rageval.sources import tables

WORDS = [f"w{i}" for i in range(200)]


def corpus_df(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def queries_df(spark, qs):
    return spark.createDataFrame(qs, "query_id long, text string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_min_words_boundary(spark):
    df = corpus_df(spark, [(1, " ".join(WORDS[:50])), (2, " ".join(WORDS[:51])), (3, None)])
    assert [r.doc_id for r in tables.min_words(df).collect()] == [2]


def test_label_null_tokens_dropped(spark):
    df = spark.createDataFrame([("",), ("N/A",), ("null",), ("None",), (None,), ("1",), ("[[No]]",)], "l string")
    out = df.select(T.label_to_int("l").alias("v")).dropna().collect()
    assert sorted(r.v for r in out) == [0, 1]


def test_same_text_two_ids_keeps_smaller(spark):
    text = " ".join(WORDS[:60])
    df = corpus_df(spark, [(7, text), (3, text), (5, text + " x")])
    assert rows(tables.dedupe_texts(df), "doc_id") == [(3,), (5,)]


def test_python_whitespace_split(spark):
    samples = ["  a　b\x1c c  ", "", "   \n ", "x", "a b\tc\r\nd"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r.toks for r in df.select(T.ws_tokens("t").alias("toks")).collect()]
    assert got == [s.split() for s in samples]


@pytest.fixture()
def small_corpus(spark):
    docs = [(1, "apple banana cherry"), (2, "banana banana date"), (3, "cherry egg fig"),
            (4, "grape apple"), (5, "kiwi lemon mango")]
    return corpus_df(spark, docs)


def bm25_brute(docs, query, k1=1.5, b=0.75, eps=0.25):
    """Okapi BM25 written directly from the formula, scoring every document."""
    toks = [d.split() for _, d in docs]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    scores = []
    for (doc_id, _), t in zip(docs, toks):
        s = 0.0
        for w in query.split():
            tf = t.count(w)
            s += idf.get(w, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))
        scores.append((doc_id, s))
    return sorted(scores, key=lambda x: (-x[1], x[0]))


def test_bm25_matches_brute_force(spark, small_corpus):
    docs = [(r.doc_id, r.text) for r in small_corpus.orderBy("doc_id").collect()]
    ix = lexical.build_index(small_corpus, lexical.WS)
    qs = queries_df(spark, [(1, "banana apple"), (2, "cherry cherry"), (3, "zzz"), (4, "kiwi")])
    got = lexical.bm25_search(ix, qs, 3).collect()
    for qid, text in [(1, "banana apple"), (2, "cherry cherry"), (3, "zzz"), (4, "kiwi")]:
        exp = bm25_brute(docs, text)[:3]
        mine = sorted([(r.doc_id, r.score, r.rank) for r in got if r.query_id == qid], key=lambda x: x[2])
        assert [d for d, _, _ in mine] == [d for d, _ in exp]
        for (_, s, _), (_, e) in zip(mine, exp):
            assert s == pytest.approx(e, abs=1e-9)


def test_blank_and_null_queries_give_no_rows(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    qs = queries_df(spark, [(1, None), (2, "  \n  ")])
    assert lexical.bm25_search(ix, qs, 3).count() == 0


def test_unknown_query_backfills_first_docs(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    qs = queries_df(spark, [(1, "nothing here")])
    assert rows(lexical.bm25_search(ix, qs, 3), "rank", "doc_id", "score") == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    std = lexical.build_index(small_corpus, lexical.STD)
    assert lexical.match_search(std, qs, 3).count() == 0


def test_one_match_then_first_other_docs(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    out = rows(lexical.bm25_search(ix, queries_df(spark, [(1, "kiwi")]), 3), "rank", "doc_id")
    assert out == [(1, 5), (2, 1), (3, 2)]


def test_repeated_query_word_counts_twice(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    qs = queries_df(spark, [(1, "egg"), (2, "egg egg")])
    s = {r.query_id: r.score for r in lexical.bm25_search(ix, qs, 1).collect()}
    assert s[2] == pytest.approx(2 * s[1])


def test_common_token_uses_epsilon_floor(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    # "banana" is in 2 of 5 docs -> positive idf; make a corpus where a token is in 4 of 5
    c2 = corpus_df(spark, [(i, f"common t{i}") for i in range(1, 5)] + [(5, "rare")])
    ix2 = lexical.build_index(c2, lexical.WS)
    raw = math.log(5 - 4 + 0.5) - math.log(4 + 0.5)
    assert raw < 0
    idf = {r.token: r.idf for r in ix2.term_df.select(
        "token", lexical.okapi_idf_column(ix2, lexical.OKAPI_EPSILON).alias("idf")).collect()}
    assert idf["common"] == pytest.approx(lexical.OKAPI_EPSILON * ix2.mean_okapi_idf)
    assert ix.n_docs == 5


def test_equal_scores_smaller_doc_id_first(spark):
    c = corpus_df(spark, [(9, "alpha beta"), (4, "gamma delta"), (2, "alpha zeta"), (7, "eta theta"),
                          (8, "iota kappa")])
    ix = lexical.build_index(c, lexical.WS)
    out = rows(lexical.bm25_search(ix, queries_df(spark, [(1, "alpha")]), 2), "rank", "doc_id", "score")
    assert [d for _, d, _ in out] == [2, 9] and out[0][2] == out[1][2] > 0


def test_zero_vector_cosine_is_zero(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vec array<float>")
    d = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "doc_id long, vec array<float>")
    out = dense.dense_search(q, d, 2).collect()
    assert all(r.score == 0.0 and not math.isnan(r.score) for r in out)
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(T.cosine("a", "b").alias("c")).first().c == 0.0


def test_rrf_tie_earlier_retriever_first(spark):
    runs = spark.createDataFrame([(0, 1, 100, 1), (0, 1, 200, 2), (1, 1, 200, 1), (1, 1, 100, 2)],
                                 "retriever_idx int, query_id long, doc_id long, rank int")
    assert rows(fusion.rrf(runs, 2), "rank", "doc_id") == [(1, 100), (2, 200)]


def test_rrf_window_below_top_k(spark):
    runs = spark.createDataFrame([(0, 1, 100, 1), (0, 1, 200, 2), (1, 1, 300, 1), (1, 1, 200, 2)],
                                 "retriever_idx int, query_id long, doc_id long, rank int")
    out = {r.doc_id: r.score for r in fusion.rrf(runs, 3, window_size=1).collect()}
    assert set(out) == {100, 300}


def judged_df(spark, data):
    return spark.createDataFrame(data, "retriever string, query_id long, doc_id long, rank int, prediction int")


def test_consensus_tie_smaller_text_first_and_fusion_votes_ignored(spark):
    corpus = corpus_df(spark, [(1, "b text"), (2, "a text"), (3, "c text")])
    qs = queries_df(spark, [(1, "q")])
    judged = judged_df(spark, [("bm25", 1, 1, 1, 1), ("tfidf", 1, 2, 1, 1),
                               ("rrf", 1, 3, 1, 1), ("rrf", 1, 3, 2, 1)])
    fusion_run = spark.createDataFrame([(1, 3, 1)], "query_id long, doc_id long, rank int")
    out = rows(C.consensus(judged, fusion_run, corpus, qs, 3), "rank", "doc_id", "source")
    assert out == [(1, 2, "consensus"), (2, 1, "consensus")]


def test_fallback_budget(spark):
    n = 25
    corpus = corpus_df(spark, [(i, f"doc {i}") for i in range(1, 3)])
    qs = queries_df(spark, [(i, f"q{i:02d}") for i in range(1, n + 1)])
    data = [("bm25", i, 1, 1, 1 if i <= 20 else 0) for i in range(1, n + 1)]
    judged = judged_df(spark, data)
    fusion_run = spark.createDataFrame([(i, 2, 1) for i in range(1, n + 1)], "query_id long, doc_id long, rank int")
    out = C.consensus(judged, fusion_run, corpus, qs, 3, ratio=0.1)
    by = {s: sorted(r.query_id for r in out.where(F.col("source") == s).collect())
          for s in ("consensus", "fallback", "sentinel")}
    assert len(by["consensus"]) == 20
    assert by["fallback"] == [21, 22]
    assert by["sentinel"] == [23, 24, 25]
    s = C.consensus_summary(out).first()
    assert (s.total_queries, s.queries_without_documents, s.fallbacks_used) == (25, 3, 2)


def test_no_fusion_rows_means_sentinel_without_budget(spark):
    corpus = corpus_df(spark, [(1, "d")])
    qs = queries_df(spark, [(i, f"q{i:02d}") for i in range(1, 21)])
    judged = judged_df(spark, [("bm25", i, 1, 1, 0) for i in range(1, 21)])
    fusion_run = spark.createDataFrame([(5, 1, 1), (6, 1, 1)], "query_id long, doc_id long, rank int")
    out = C.consensus(judged, fusion_run, corpus, qs, 3, ratio=0.1)
    assert sorted(r.query_id for r in out.where("source = 'fallback'").collect()) == [5, 6]
    assert out.where("source = 'sentinel'").count() == 18


def runs_df(spark, data):
    return spark.createDataFrame(data, "retriever string, query_id long, doc_id long, rank int")


def qrels_df(spark, data):
    return spark.createDataFrame(data, "query_id long, doc_id long, label int")


def test_macro_error_classes_and_zero_recall(spark):
    runs = runs_df(spark, [("r", 1, None, 1), ("r", 2, 7, 1), ("r", 3, 5, 1), ("r", 3, 8, 2)])
    qrels = qrels_df(spark, [(1, 1, 1), (2, 9, 1), (3, 5, 1)])
    m = metrics.macro_metrics(runs, qrels).first()
    assert (m.no_docs_count, m.wrong_docs_count) == (1, 1)
    assert m.precision == pytest.approx(round((0 + 0 + 0.5) / 3, 6))
    assert m.recall == pytest.approx(round((0 + 0 + 1) / 3, 6))
    runs2 = runs_df(spark, [("r", 4, 1, 1)])
    m2 = metrics.macro_metrics(runs2, qrels).first()
    assert (m2.precision, m2.recall, m2.f1_score) == (0.0, 0.0, 0.0)


def test_micro_ignores_unjudged_and_handles_empty(spark):
    runs = runs_df(spark, [("r", 1, 1, 1), ("r", 1, 99, 2)])
    qrels = qrels_df(spark, [(1, 1, 1), (1, 2, 0), (1, 3, 1)])
    dim = spark.createDataFrame([("r",), ("none",)], "retriever string")
    m = {r.retriever: r for r in metrics.micro_metrics(runs, qrels, dim, 3).collect()}
    assert (m["r"].tp, m["r"].fp, m["r"].fn, m["r"].tn) == (1, 0, 1, 1)
    assert (m["none"].tp, m["none"].precision, m["none"].recall) == (0, 0.0, 0.0)
    empty = metrics.micro_metrics(runs, qrels_df(spark, []), dim, 3).collect()
    assert all(r.precision == 0.0 and r.accuracy == 0.0 for r in empty)


def test_best_llm_ties_and_all_null(spark):
    scores = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.5), ("c", 2, None)],
                                   "llm string, llm_idx int, score double")
    assert generate.best_llm(scores).first().llm == "a"
    only_null = spark.createDataFrame([("c", 2, None)], "llm string, llm_idx int, score double")
    assert generate.best_llm(only_null).count() == 0


def test_answer_fn_failure_isolated(spark):
    rows_ = spark.createDataFrame([("m", 1, 1, "ok one"), ("m", 1, 2, "boom"), ("m", 2, 3, "ok two")],
                                  "llm string, query_id long, doc_id long, prompt string")

    def fn(llm, prompts):
        if any(p == "boom" for p in prompts):
            raise RuntimeError("bad row")
        return pd.Series([p.upper() for p in prompts])

    out = {r.doc_id: r for r in generate.answer_with_fn(rows_, fn, max_attempts=2).collect()}
    assert out[2].answer is None and out[2].error
    assert out[1].answer == "OK ONE" and out[3].answer == "OK TWO" and out[1].error is None


def test_top_k_zero_rejected(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    with pytest.raises(ValueError):
        lexical.bm25_search(ix, queries_df(spark, [(1, "apple")]), 0)


def test_ranks_dense_bounded_and_partitioning_invariant(spark, small_corpus):
    ix = lexical.build_index(small_corpus, lexical.WS)
    qs = queries_df(spark, [(1, "apple banana"), (2, "egg"), (3, "zzz")])
    a = rows(lexical.bm25_search(ix, qs, 3), "query_id", "rank", "doc_id")
    c2 = small_corpus.repartition(3, "text")
    b = rows(lexical.bm25_search(lexical.build_index(c2, lexical.WS), qs.repartition(2), 3),
             "query_id", "rank", "doc_id")
    assert a == b
    per_q = {}
    for q, r, _ in a:
        per_q.setdefault(q, []).append(r)
    assert all(v == list(range(1, len(v) + 1)) and len(v) <= 3 for v in per_q.values())
