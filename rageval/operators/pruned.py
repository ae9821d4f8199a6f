"""Safe top-k pruning of lexical search: the exact top k while most (query, document) pairs are never added up.

Documents of near equal length lie in small blocks. A table of bounds has each block's largest term frequency and
smallest document length per token, which bound a term's weight in the block for any parameters. The postings are
bucketed by block, so bounds, scores and blocks meet without a shuffle.

A search has two phases. The rarest terms of each query name a few documents; their full scores give a threshold that
the k-th score can't be below. Then only the blocks whose bounds add up to the threshold are scored. Weights must not
be negative; ties at the threshold stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_term
from .common import maybe_broadcast, top_k

# Documents of a block, about; length classes per factor e.
BLOCK_DOCS = 6
CLASSES = 50
# Postings of rare terms that a query probes with, at least where it has them,
# and documents whose full scores give its threshold, as a multiple of k.
PROBE_POSTINGS = 512
PROBE_DOCS = 4
# Room for sums in another order.
SLACK = 1e-6


@dataclass
class ImpactIndex:
    postings: DataFrame   # block, doc_id, dl, token, tf
    bounds: DataFrame     # block, token, max_tf, min_dl
    n_docs: int

    def covers(self, qw: DataFrame) -> bool:
        return True


class LazyImpacts:
    """An ``ImpactIndex`` that is built when a search first reads it; of the tokens in ``asked``, if given, so that the
    blocks of a known set of queries hold no other postings."""

    def __init__(self, make: Callable[[], ImpactIndex], asked: DataFrame | None = None):
        self._make, self._asked = make, asked

    def covers(self, qw: DataFrame) -> bool:
        """Whether it has the postings of all tokens of ``qw``."""
        return self._asked is None or qw.join(self._asked, "token", "left_anti").isEmpty()

    @cached_property
    def _made(self) -> ImpactIndex:
        return self._make()

    @property
    def postings(self) -> DataFrame:
        return self._made.postings

    @property
    def bounds(self) -> DataFrame:
        return self._made.bounds

    @property
    def n_docs(self) -> int:
        return self._made.n_docs


def length_class(dl) -> Column:
    return F.floor(F.log(F.greatest(dl, F.lit(1)).cast("double")) * CLASSES).cast("int")


def build_impacts(postings: DataFrame, n_docs: int, materialize, lengths: DataFrame | None = None) -> ImpactIndex:
    """``materialize(df, name)`` stores a table bucketed by ``block``; ``lengths`` are (doc_id, dl) rows, repeated or not, if
    they can be had more cheaply than from the postings.

    The driver gets one count per length class, of which a corpus has at most about a thousand.
    """
    lengths = (postings if lengths is None else lengths).groupBy("doc_id", "dl").agg(F.lit(1)).groupBy(length_class("dl").alias("c")).count()
    counts = {r["c"]: r["count"] for r in lengths.collect()}
    parts = [max(1, math.ceil(counts.get(c, 0) / BLOCK_DOCS)) for c in range(max(counts, default=0) + 1)]
    cls = length_class("dl")
    part = F.pmod(F.xxhash64("doc_id"), F.element_at(F.array(*[F.lit(n).cast("long") for n in parts]), cls + 1))
    block = (F.shiftleft(cls.cast("long"), 40) + part).alias("block")
    stored = materialize(postings.select(block, "doc_id", "dl", "token", "tf"), "postings")
    bounds = stored.groupBy("block", "token").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return ImpactIndex(stored, materialize(bounds, "bounds"), n_docs)


def probe_terms(qw: DataFrame) -> DataFrame:
    """The rarest terms of each query, until they have ``PROBE_POSTINGS`` postings; one at least."""
    so_far = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "token"))
    return qw.withColumn("before", so_far - F.col("df")).where(F.col("before") < PROBE_POSTINGS).drop("before")


def thresholds(index: ImpactIndex, qw: DataFrame, k: int, term, cut, small: bool | None) -> DataFrame:
    """(query_id, least): a score that the k-th best document reaches; queries that find fewer have none."""
    partial = (index.postings.join(maybe_broadcast(small, probe_terms(qw)), "token")
               .groupBy("query_id", "block", "doc_id").agg(F.sum(term).alias("score")))
    picks = cut(top_k(partial, "query_id", [F.col("score").desc(), "doc_id"], PROBE_DOCS * k).select("query_id", "block", "doc_id"))
    own = index.postings.join(maybe_broadcast(None, picks), ["block", "doc_id"])
    full = own.join(maybe_broadcast(small, qw), ["query_id", "token"]).groupBy("query_id", "doc_id").agg(F.sum(term).alias("score"))
    kth = top_k(full, "query_id", [F.col("score").desc(), "doc_id"], k).where(F.col("rank") == k)
    return cut(kth.select("query_id", (F.col("score") - SLACK).alias("least")))


def live_blocks(index: ImpactIndex, qw: DataFrame, least: DataFrame, bound, small: bool | None) -> DataFrame:
    """(block, queries): the blocks that may hold one of the best documents, with the queries they may hold it for."""
    upto = index.bounds.join(maybe_broadcast(small, qw), "token").groupBy("block", "query_id").agg(F.sum(bound).alias("upto"))
    near = upto.join(maybe_broadcast(small, least), "query_id", "left").where(F.col("least").isNull() | (F.col("upto") >= F.col("least")))
    return near.groupBy("block").agg(F.collect_list("query_id").alias("queries"))


def scores(index: ImpactIndex, qw: DataFrame, avgdl: float, k: int, k1: float, b: float, cut, small: bool | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that can be among the k best by the sum of BM25 weights.

    ``qw``: (query_id, token, df, wq) with ``wq >= 0``; ``cut`` materialises a narrow table.
    """
    avg = F.lit(avgdl)
    term = bm25_term(F.col("wq"), F.col("tf"), F.col("dl"), avg, k1, b)
    bound = bm25_term(F.col("wq"), F.col("max_tf"), F.col("min_dl"), avg, k1, b)
    least = thresholds(index, qw, k, term, cut, small)
    live = live_blocks(index, qw, least, bound, small)
    # both sides are bucketed by block: the live blocks of a bucket are a hash table there, the postings stream past it
    hits = index.postings.join(live.hint("shuffle_hash"), "block").join(maybe_broadcast(small, qw), "token").where(F.array_contains("queries", F.col("query_id")))
    return hits.groupBy("query_id", "block", "doc_id").agg(F.sum(term).alias("score")).select("query_id", "doc_id", "score")
