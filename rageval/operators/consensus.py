"""Judging retrieved pairs (U3), relevance votes (A4) and the judged consensus.

The consensus keeps, per query, the documents most retrievers' results were
judged relevant for; queries without any fall back to the fusion run, but
only up to a global budget of ``floor(n_queries * ratio)`` queries; the rest
get the sentinel row. A sequential budget counter becomes the first rows of an
order once that is fixed (query text, then id).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import std_tokens
from ..session import ship_package
from .common import first_n, maybe_broadcast, top_k

# Default judge threshold and fallback ratio.
JUDGE_THRESHOLD = 0.5
FALLBACK_RATIO = 0.1


def coverage(query_text, doc_text):
    """Share of the query's distinct standard tokens that occur in the other text."""
    q = F.array_distinct(std_tokens(query_text))
    hit = F.size(F.array_intersect(q, std_tokens(doc_text)))
    return F.when(F.size(q) > 0, hit.cast("double") / F.size(q)).otherwise(F.lit(0.0))


def judge_rule(threshold: float = JUDGE_THRESHOLD):
    """Default judge: 1 when the coverage reaches ``threshold``."""
    def rule(query_text, doc_text):
        return (coverage(query_text, doc_text) >= F.lit(threshold)).cast("int")
    return rule


def judge_pairs(pairs: DataFrame, corpus: DataFrame, queries: DataFrame,
                judge: Callable | None = None, judge_fn: Callable | None = None, small: bool | None = None) -> DataFrame:
    """Add ``prediction`` (0/1) to (…, query_id, doc_id) rows.

    ``judge`` builds a Column from (query text, document text) and stays in
    the JVM; ``judge_fn(queries: Series, docs: Series) -> Series[int]`` is an
    external model run as an Arrow-batched pandas UDF.
    Each distinct pair is judged once and joined back.
    """
    distinct_pairs = pairs.select("query_id", "doc_id").distinct()
    texts = (maybe_broadcast(small, distinct_pairs)
             .join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
             .join(maybe_broadcast(small, queries.select("query_id", F.col("text").alias("qtext"))),
                   "query_id"))
    if judge_fn is not None:
        ship_package(pairs.sparkSession)

        @F.pandas_udf("int")
        def ext(q: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(judge_fn(q, d)).astype("int32")
        pred = ext(F.col("qtext"), F.col("dtext"))
    else:
        pred = (judge or judge_rule())(F.col("qtext"), F.col("dtext"))
    judged = texts.select("query_id", "doc_id", pred.alias("prediction"))
    return pairs.join(judged, ["query_id", "doc_id"], "left")


def relevance_votes(judged: DataFrame, exclude=("rrf",)) -> DataFrame:
    """A4: per (query, doc), the number of retrievers whose row was judged relevant."""
    j = judged.where(~F.col("retriever").isin(*exclude)) if exclude else judged
    return (j.where(F.col("prediction") == 1)
            .groupBy("query_id", "doc_id")
            .agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best_rank")))


def consensus(judged: DataFrame, fusion: DataFrame, corpus: DataFrame, queries: DataFrame,
              k: int, ratio: float = FALLBACK_RATIO, tie_break: str = "text",
              exclude=("rrf",), small: bool | None = None) -> DataFrame:
    """(query_id, doc_id, rank, source) with source consensus | fallback | sentinel.

    ``tie_break="text"`` orders equal votes by document text (the reference);
    ``"best_rank"`` by the best original rank, then text (its alternative).
    The sentinel row has a null doc_id.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    j = judged.where(~F.col("retriever").isin(*exclude)) if exclude else judged
    universe = j.select("query_id").distinct()
    votes = relevance_votes(judged, exclude)
    votes = maybe_broadcast(small, votes).join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
    order = [F.col("votes").desc()]
    if tie_break == "best_rank":
        order.append(F.col("best_rank").asc())
    order += [F.col("dtext").asc(), F.col("doc_id").asc()]
    chosen = (top_k(votes, "query_id", order, k)
              .select("query_id", "doc_id", F.col("rank").cast("int"), F.lit("consensus").alias("source")))
    without = universe.join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    n_universe = universe.count()
    budget = int(n_universe * ratio)
    eligible = (without.join(fusion.select("query_id").distinct(), "query_id", "left_semi")
                .join(queries.select("query_id", F.col("text").alias("qtext")), "query_id", "left"))
    if budget > 0:
        picked = first_n(eligible.select("query_id", "qtext"), [F.col("qtext").asc_nulls_first(), F.col("query_id").asc()],
                         budget, lambda df: df.checkpoint(eager=True)).select("query_id")
    else:
        picked = eligible.select("query_id").where(F.lit(False))
    fallback = (fusion.where(F.col("rank") <= k).join(picked, "query_id", "left_semi")
                .select("query_id", "doc_id", F.col("rank").cast("int"), F.lit("fallback").alias("source")))
    sentinel = (without.join(picked, "query_id", "left_anti")
                .select("query_id", F.lit(None).cast("bigint").alias("doc_id"),
                        F.lit(1).alias("rank"), F.lit("sentinel").alias("source")))
    return chosen.unionByName(fallback).unionByName(sentinel)


def consensus_summary(result: DataFrame) -> DataFrame:
    """Queries processed, rows saved, queries left without documents, fallbacks used."""
    per_q = result.groupBy("query_id").agg(F.max(F.col("source") == "sentinel").alias("s"),
                                           F.max(F.col("source") == "fallback").alias("f"),
                                           F.count(F.lit(1)).alias("n"))
    return per_q.agg(F.count(F.lit(1)).alias("total_queries"),
                     F.sum("n").cast("long").alias("total_rows"),
                     F.sum(F.col("s").cast("int")).cast("long").alias("queries_without_documents"),
                     F.sum(F.col("f").cast("int")).cast("long").alias("fallbacks_used"))


def consensus_as_text(result: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """F10/X13 at the edge: (Query, Document) rows with the sentinel text for queries
    left without documents -- the shape the consensus results file has."""
    from ..functions.text import SENTINEL_DOCUMENT
    return (result.join(corpus.select("doc_id", F.col("text").alias("Document")), "doc_id", "left")
            .join(queries.select("query_id", F.col("text").alias("Query")), "query_id")
            .select("query_id", "rank", "Query",
                    F.coalesce("Document", F.lit(SENTINEL_DOCUMENT)).alias("Document"),
                    (F.col("source") == "sentinel").cast("int").alias("is_sentinel")))
