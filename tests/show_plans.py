"""Write the executed physical plans of the headline queries to PLANS.md.

Usage: python tests/show_plans.py [sf_dir]. Each query is run once (so the
indexes exist and AQE has re-planned), then ``explain("formatted")`` of a fresh
run is captured; only the operator tree (final plan) is kept.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rageval.session import get_session  # noqa: E402

def tree(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    final = text.split("+- == Initial Plan ==")[0]
    body = final.split("\n\n")[0]
    return body


def main() -> None:
    from pyspark.sql import functions as F

    from rageval.operators import consensus as C
    from rageval.operators import dense, fusion, ground_truth, lexical, metrics, router
    from rageval.plans.fixtures import fixtures
    from rageval.sources import tables

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]")
    fx = fixtures(spark, sf)
    k = fx.k
    emb_q, emb_d = tables.embedding_roles(spark, sf)
    toks = lexical.tokenize(lexical.WS, "text")
    plans = {
        "corpus build (filter + dedupe)": tables.corpus(spark, sf),
        "postings build (over the bucketed corpus)": fx.corpus.select("doc_id", F.inline(F.arrays_zip(
            toks.alias("token"), F.array_repeat(F.size(toks), F.size(toks)).alias("dl"))))
        .groupBy("doc_id", "dl", "token").count(),
        "bm25_topk": lexical.bm25_search(fx.ws_index, fx.queries, k, small=fx.small),
        "bm25_std_topk": lexical.match_search(fx.std_index, fx.queries, k, small=fx.small),
        "tfidf_topk": lexical.tfidf_search(fx.tfidf, fx.queries, k, small=fx.small),
        "dense_topk": dense.dense_search(emb_q, emb_d, k),
        "dense_text vectors": dense.hashed_cells(fx.std_index.postings, "doc_id", 64, "dense_a"),
        "document norms": lexical.build_tfidf(fx.std_index, materialize=lambda df: df).doc_norm,
        "ground_truth (contained pairs)": ground_truth.containment_pairs(fx.ws_index, fx.corpus, fx.queries, fx.small),
        "router (naive Bayes scores)": router.naive_bayes_scores(
            fx.router[0], router.router_features(fx.best_pairs.select("query_id", "doc_id"), fx.corpus, fx.queries)),
        "hybrid_rerank": fusion.hybrid_rerank(fx.tfidf, fx.queries, fx.bm25(k), fx.match(k), k, small=fx.small),
        "rrf_topk": fusion.rrf(fx.base_runs, k),
        "judge_pairs": C.judge_pairs(fx.runs, fx.corpus, fx.queries, small=fx.small),
        "consensus": C.consensus(fx.judged, fx.rrf, fx.corpus, fx.queries, k, small=fx.small),
        "leaderboard (macro metrics)": metrics.macro_metrics(fx.all_runs, fx.qrels),
        "micro_metrics": metrics.micro_metrics(fx.all_runs, fx.qrels, fx.retriever_dim(), k),
    }
    out = ["# Executed plans", "",
           f"Final adaptive plans at `{sf}` (operator trees), written by `tests/show_plans.py`. Stored stages",
           "appear as scans of their checkpoint (`Scan ExistingRDD`) or of a bucketed table (`Bucketed: true`).",
           ""]
    for name, df in plans.items():
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
