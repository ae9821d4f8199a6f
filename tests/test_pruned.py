"""Pruned lexical search gives the rows of the plain one and adds up few pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rageval.operators import lexical, pruned
from rageval.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary[:rng.choice([5, 40, 300])]) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    texts += [texts[3]] * 5 + ["", "w1 " * 2000, "only here"]  # ties, an empty and a long document
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {kind: lexical.build_index(corpus, kind) for kind in (lexical.WS, lexical.STD)}


@pytest.mark.parametrize("kind", [lexical.WS, lexical.STD])
@pytest.mark.parametrize("k", [1, 10, 600])
def test_same_rows_as_the_plain_search(spark, index, kind, k):
    rng = random.Random(2)
    queries = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 320)}" for _ in range(rng.randint(1, 12)))) for i in range(25)]
                                    + [(90, None), (91, " "), (92, "nothing known"), (93, "only here"), (94, "w1 w1 w1 w2")], "query_id long, text string")
    search = lexical.bm25_search if kind == lexical.WS else lexical.match_search
    plain = index[kind]
    want = rows(search(plain, queries, k))
    blocked = lexical.LexicalIndex(**{**plain.__dict__, "impacts": pruned.build_impacts(plain.postings, plain.n_docs, lambda df, name: df.persist()),
                                      "cut": lambda df: df.persist()})
    assert rows(search(blocked, queries, k)) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_few_pairs_are_added_up(spark):
    fx = Fixtures(spark, SF)
    ix = fx.ws_index
    qt = lexical.query_terms(fx.queries, ix.kind)
    qw = qt.join(lexical.query_term_stats(qt, ix, fx.small), "token").select("query_id", "token", "df", (F.col("qtf") * lexical.okapi_idf_column(ix, lexical.OKAPI_EPSILON)).alias("wq"))
    qw = fx.cut(qw)
    pairs = pruned.scores(ix.impacts, qw, ix.avgdl, 10, lexical.OKAPI_K1, lexical.OKAPI_B, fx.cut, fx.small).count()
    everything = ix.n_docs * fx.queries.count()
    assert pairs < everything / 4
    fx.close()
