"""Property test: BM25 top-k equals a brute-force scoring of every document."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rageval.operators import lexical
from test_edge_cases import bm25_brute

VOCAB = ["ab", "cd", "ef", "gh", "ij", "kl", "mn"]
docs_st = st.lists(st.lists(st.sampled_from(VOCAB), min_size=1, max_size=8), min_size=2, max_size=7)
query_st = st.lists(st.sampled_from(VOCAB + ["zz"]), min_size=1, max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=docs_st, query=query_st, k=st.integers(min_value=1, max_value=4))
def test_bm25_equals_brute_force(spark, docs, query, k):
    texts = list(dict.fromkeys(" ".join(d) for d in docs))      # the corpus is deduplicated
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    qs = spark.createDataFrame([(1, " ".join(query))], "query_id long, text string")
    ix = lexical.build_index(corpus, lexical.WS, materialize=None)
    got = sorted(lexical.bm25_search(ix, qs, k).collect(), key=lambda r: r.rank)
    exp = bm25_brute(rows, " ".join(query))[:k]
    assert [r.doc_id for r in got] == [d for d, _ in exp] or \
        [round(r.score, 9) for r in got] == [round(s, 9) for _, s in exp]
    assert [round(r.score, 9) for r in got] == [round(s, 9) for _, s in exp]
