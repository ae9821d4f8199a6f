"""Judged (query, document) pairs derived from the driver tables.

Positives: the query's whitespace tokens occur in the document one after
another. Each query looks up the postings of its rarest token only; the
candidates are verified on the texts. No query is compared with every
document, and a query with a token that no document has is done at once.

Negatives (pooling, as in TREC): documents that carry a quality label and
that a pooled run returns for a query without containing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from ..session import written
from ..sources.tables import nonblank
from .common import maybe_broadcast
from .lexical import LexicalIndex


def token_line(text) -> Column:
    """The whitespace tokens, each between single spaces."""
    return F.concat(F.lit(" "), F.array_join(ws_tokens(text), " "), F.lit(" "))


def rarest_tokens(index: LexicalIndex, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """(query_id, token): the query's token that fewest documents have, the first of equals; queries with a token that
    isn't in the vocabulary are left out, as no document contains them."""
    toks = nonblank(queries).select("query_id", F.explode(F.array_distinct(ws_tokens("text"))).alias("token"))
    known = index.term_df.join(maybe_broadcast(small, toks), "token", "right")
    return (known.groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("least"), F.count_if(F.col("df").isNull()).alias("unknown"))
            .where("unknown = 0").select("query_id", F.col("least.token").alias("token")))


def containment_pairs(index: LexicalIndex, corpus: DataFrame, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """(query_id, doc_id) where the document's tokens contain the query's tokens in a row."""
    rare = rarest_tokens(index, queries, small).join(queries.select("query_id", token_line("text").alias("qline")), "query_id")
    cand = index.postings.select("doc_id", "token").join(maybe_broadcast(small, rare), "token").select("query_id", "doc_id", "qline")
    return (cand.join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
            .where(F.contains(token_line("dtext"), F.col("qline"))).select("query_id", "doc_id"))


def qrels(index: LexicalIndex, corpus: DataFrame, queries: DataFrame, labels: DataFrame, pool: DataFrame,
          small: bool | None = None, cut=written) -> DataFrame:
    """(query_id, doc_id, label): containment positives plus pooled labelled negatives.

    ``pool`` has the (query_id, doc_id) of all pooled runs; ``cut`` materialises the positives, which are read twice.
    """
    pos = cut(containment_pairs(index, corpus, queries, small)).withColumn("label", F.lit(1))
    labelled = labels.select("doc_id").distinct()
    neg = (pool.select("query_id", "doc_id").distinct()
           .join(labelled, "doc_id", "left_semi")
           .join(pos, ["query_id", "doc_id"], "left_anti")
           .withColumn("label", F.lit(0)))
    return pos.unionByName(neg).select("query_id", "doc_id", F.col("label").cast("int"))
