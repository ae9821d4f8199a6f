"""Fusion of retrieval runs: ordered candidate union (D3), hybrid rerank (R5/W6), RRF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reciprocal_rank
from .common import maybe_broadcast, rank_score, top_k
from .lexical import TfidfModel, tfidf_query_vectors

# Fixed value: the rank constant of reciprocal rank fusion (Cormack et al. 2009).
RRF_RANK_CONSTANT = 60


def candidate_union(*runs: DataFrame) -> DataFrame:
    """D3: per query, the union of several ranked lists in order, first occurrence wins.

    Input runs are (query_id, doc_id, rank); output (query_id, doc_id, cand_pos)
    with ``cand_pos`` 1-based over the deduplicated list.
    """
    tagged = None
    for i, r in enumerate(runs):
        t = r.select("query_id", "doc_id", F.lit(i).alias("src"), "rank")
        tagged = t if tagged is None else tagged.unionByName(t)
    first = (tagged.groupBy("query_id", "doc_id")
             .agg(F.min(F.struct("src", "rank")).alias("first")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("first").asc()))
    return first.select("query_id", "doc_id", pos.cast("int").alias("cand_pos"))


def pair_similarity(model: TfidfModel, queries: DataFrame, pairs: DataFrame, small: bool | None = None) -> DataFrame:
    """tf-idf cosine for given (query_id, doc_id) pairs only; 0 when nothing is shared."""
    qv = maybe_broadcast(small, tfidf_query_vectors(model, queries, small))
    p = maybe_broadcast(small, pairs.select("query_id", "doc_id").distinct())
    wd = F.col("tf").cast("double") * F.col("idf")
    dots = (model.index.postings.select("doc_id", "token", "tf").join(p, "doc_id")
            .join(qv, ["query_id", "token"])
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("wq") * wd).alias("dot"), F.max("qnorm").alias("qnorm")))
    norms = model.doc_norm.select("doc_id", "norm").join(p.select("doc_id").distinct(), "doc_id")
    sim = (dots.join(norms, "doc_id")
           .select("query_id", "doc_id",
                   F.when(F.col("qnorm") * F.col("norm") > 0,
                          F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("sim")))
    return (pairs.join(sim, ["query_id", "doc_id"], "left")
            .withColumn("sim", F.coalesce("sim", F.lit(0.0))))


def hybrid_rerank(model: TfidfModel, queries: DataFrame, lexical_run: DataFrame,
                  match_run: DataFrame, k: int, small: bool | None = None) -> DataFrame:
    """BM25 list + match list -> ordered union -> rerank by similarity (stable) -> k."""
    cands = candidate_union(lexical_run, match_run)
    scored = pair_similarity(model, queries, cands, small)
    out = top_k(scored, "query_id", [rank_score("sim").desc(), F.col("cand_pos").asc()], k)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), F.col("sim").alias("score"))


def rrf(runs: DataFrame, k: int, rank_constant: int = RRF_RANK_CONSTANT,
        window_size: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of stored runs.

    ``runs`` = (retriever_idx, query_id, doc_id, rank). Only ranks within
    ``window_size`` (default ``k``) contribute ``1 / (rank_constant + rank)``.
    Ties go to the document seen first: earlier retriever, then better rank.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    w = window_size if window_size is not None else k
    fused = (runs.where(F.col("rank") <= w)
             .groupBy("query_id", "doc_id")
             .agg(F.sum(reciprocal_rank("rank", rank_constant)).alias("score"),
                  F.min(F.struct("retriever_idx", "rank")).alias("first_seen")))
    # Sums of a few reciprocal ranks that are equal in exact arithmetic can
    # differ in the last bit with summation order; rank on 12 decimals so ties
    # are ties on every partitioning and engine.
    out = top_k(fused, "query_id", [F.round("score", 12).desc(), F.col("first_seen").asc()], k)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), "score")
