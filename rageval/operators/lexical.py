"""Lexical retrieval: index statistics (A1), Okapi BM25 (R1), full-text match (R4), tf-idf cosine.

The index is a postings table ``(doc_id, dl, token, tf)``. It is built once
per corpus, each document counting its own tokens, and stored with a row per
document, where ids don't repeat; as it is bucketed by ``doc_id`` (see
``Fixtures``) every later per-(query, document) aggregation runs without a
shuffle, and the per-query top-k is cut inside each task before the only
exchange (by query). Searching joins the query terms -- a small, size-checked side that is
broadcast -- with the postings on ``token``: an equi-join that only touches
postings of query terms, instead of scoring every (query, document) pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (bm25_okapi_idf, bm25_plus_one_idf, bm25_term, boundary_tokens, std_tokens,
                              ws_tokens)
from ..session import ship_package
from ..sources.tables import nonblank
from . import pruned
from .common import SCORE_DECIMALS, maybe_broadcast, rank_score, top_k, zero_backfill

WS = "whitespace"
STD = "standard"
BOUNDARY = "boundary"

# Okapi BM25 defaults (k1, b, epsilon) and the match retriever's k1.
OKAPI_K1 = 1.5
OKAPI_B = 0.75
OKAPI_EPSILON = 0.25
MATCH_K1 = 1.2
MATCH_B = 0.75
# Terms broadcast at most when computing document norms: those with at least
# this share of all postings.
FREQUENT_TERMS = 100_000
# Texts whose tokens are counted together.
COUNTED_ROWS = 1_000
# Terms of all queries that a task holds at most, and products of documents and terms added up at once.
MATRIX_TERMS = 200_000
MATRIX_CELLS = 2_000_000
# Terms of all queries whose BM25 scores are added up so; with more, blocks that can't matter are left out instead.
MATRIX_BM25_TERMS = 20_000
TERMS = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int32())]))


def tokenize(kind: str, text) -> "F.Column":
    return {WS: ws_tokens, STD: std_tokens, BOUNDARY: boundary_tokens}[kind](text)


@dataclass
class LexicalIndex:
    kind: str
    corpus: DataFrame      # doc_id, text
    postings: DataFrame    # doc_id, dl, token, tf
    term_df: DataFrame     # token, df
    n_docs: int
    avgdl: float
    mean_okapi_idf: float
    min_okapi_idf: float
    n_terms: int
    impacts: pruned.ImpactIndex | pruned.LazyImpacts | None = None   # for pruned search
    cut: object = None                                               # materialises narrow tables of a pruned search
    terms: DataFrame | None = None   # doc_id, dl, terms: what the postings are read from, a row per document, if no id repeats

    def unpersist(self) -> None:
        (self.postings if self.terms is None else self.terms).unpersist()
        self.term_df.unpersist()


def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def counted_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, terms) of (doc_id, toks): each document counts its own tokens, so no table of all (document, token)
    pairs is grouped; batches of documents are counted at once."""
    ship_package(docs.sparkSession)
    counted = F.arrow_udf(counted_tokens, "array<struct<token:string,tf:int>>")
    return docs.select("doc_id", F.size("toks").alias("dl"), counted("toks").alias("terms"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, token, tf) of (doc_id, toks)."""
    # for an inner ``inline`` Spark would count a second time, to leave out documents without terms first
    return counted_terms(docs).select("doc_id", "dl", F.inline_outer("terms")).where("tf is not null")


def counted_tokens(toks: pa.Array) -> pa.Array:
    """Of each row, its distinct tokens with their numbers; none of a null row."""
    done = [counted_rows(toks.slice(at, COUNTED_ROWS)) for at in range(0, len(toks), COUNTED_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], TERMS)


def counted_rows(toks: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
    coded = toks.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    pairs = np.repeat(np.arange(len(toks)), sizes) * n + coded.indices.to_numpy()  # a text and one of its tokens
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    row, code = np.divmod(pairs[first], n)
    terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(np.diff(first, append=len(pairs)).astype(np.int32))],
                                       fields=list(TERMS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(toks) + 1)).astype(np.int32)), terms, type=TERMS)


def has_repeated_ids(corpus: DataFrame) -> bool:
    return not corpus.groupBy("doc_id").count().where("count > 1").isEmpty()


def build_index(corpus: DataFrame, kind: str = WS, materialize=_persist) -> LexicalIndex:
    """A1: postings, document frequency per term, N, average length and idf summary.

    Global statistics are single-row aggregates read back as scalars (the
    equivalent of building the index once before searching).
    """
    toks, terms = corpus.select("doc_id", tokenize(kind, "text").alias("toks")), None
    if has_repeated_ids(corpus):  # texts of equal id and length count as one
        postings = term_counts(toks).groupBy("doc_id", "dl", "token").agg(F.sum("tf").cast("int").alias("tf"))
        if materialize is not None:
            postings = materialize(postings)
    elif materialize is not None:  # a row per document is dealt out and written, not one per posting
        terms = materialize(counted_terms(toks))
        postings = terms.select("doc_id", "dl", F.inline("terms"))
    else:
        postings = term_counts(toks)
    term_df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if materialize is not None:
        term_df = materialize(term_df)
    n_docs = corpus.count()
    total_len = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    idf = bm25_okapi_idf(F.lit(n_docs), F.col("df"))
    srow = term_df.agg(F.avg(idf).alias("mean"), F.min(idf).alias("min"),
                       F.count(F.lit(1)).alias("n")).first()
    return LexicalIndex(kind=kind, corpus=corpus, postings=postings, term_df=term_df,
                        n_docs=int(n_docs), avgdl=(float(total_len) / n_docs) if n_docs else 0.0,
                        mean_okapi_idf=float(srow["mean"] or 0.0),
                        min_okapi_idf=float(srow["min"] or 0.0), n_terms=int(srow["n"]), terms=terms)


def query_terms(queries: DataFrame, kind: str) -> DataFrame:
    """(query_id, token, qtf): a repeated query word counts once per occurrence."""
    return (nonblank(queries)
            .select("query_id", F.explode(tokenize(kind, "text")).alias("token"))
            .groupBy("query_id", "token").agg(F.count(F.lit(1)).cast("int").alias("qtf")))


def query_term_stats(qt: DataFrame, index: LexicalIndex, small: bool | None = None) -> DataFrame:
    """(token, df) for the distinct query tokens that occur in the corpus.

    The distinct query tokens are the small side and are broadcast; the term
    table (vocabulary-sized) streams past them.
    """
    return index.term_df.join(maybe_broadcast(small, qt.select("token").distinct()), "token")


def _match_scores(index: LexicalIndex, qw: DataFrame, k: int, k1: float, b: float, small: bool | None = None, prune: bool = True) -> DataFrame:
    """Sum of BM25 term weights per matched (query, document); with an impact index of all the tokens asked for, and if no
    weight is negative, only of documents that can be among the k best. ``qw``: (query_id, token, df, wq)."""
    postings, doc = index.postings, ["query_id", "doc_id"]
    if index.impacts is not None and prune:
        qw = index.cut(qw)  # read in each phase
        if index.impacts.covers(qw):
            return pruned.scores(index.impacts, qw, index.avgdl, k, k1, b, index.cut, small)
        # texts of one id stay apart by length, as in blocks
        postings, doc = postings.withColumn("length_class", pruned.length_class("dl")), [*doc, "length_class"]
    qw = maybe_broadcast(small, qw)
    term = bm25_term(F.col("wq"), F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b)
    return postings.join(qw, "token").groupBy(*doc).agg(F.sum(term).alias("score")).select("query_id", "doc_id", "score")


def okapi_idf_column(index: LexicalIndex, eps: float) -> "F.Column":
    raw = bm25_okapi_idf(F.lit(index.n_docs), F.col("df"))
    return F.when(raw < 0, F.lit(eps * index.mean_okapi_idf)).otherwise(raw)


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int, k1: float = OKAPI_K1,
                b: float = OKAPI_B, eps: float = OKAPI_EPSILON, small: bool | None = None) -> DataFrame:
    """Okapi BM25 top-k per query over whitespace tokens.

    Terms with negative idf get ``eps * mean idf``. The reference ranks every
    document, so a query with fewer than ``k`` positive scores is completed
    with zero-score documents in corpus order; ties go to the smaller doc_id.
    Output: (query_id, doc_id, rank, score).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    qt = query_terms(queries, index.kind)
    qw = (qt.join(query_term_stats(qt, index, small), "token")
          .select("query_id", "token", "df", (F.col("qtf") * okapi_idf_column(index, eps)).alias("wq")))
    negatives = index.min_okapi_idf < 0 and eps * index.mean_okapi_idf < 0
    scored = _match_scores(index, qw, k, k1, b, small, not negatives).select("query_id", "doc_id", "score")
    out = zero_backfill(scored, nonblank(queries), index.corpus, k, ascending=True,
                        negatives_possible=negatives)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), "score")


def match_search(index: LexicalIndex, queries: DataFrame, k: int, k1: float = MATCH_K1,
                 b: float = MATCH_B, small: bool | None = None) -> DataFrame:
    """Full-text match -- only documents sharing a term, idf ``ln(1 + (N-df+.5)/(df+.5))``."""
    if k < 1:
        raise ValueError("k must be >= 1")
    qt = query_terms(queries, index.kind)
    qw = (qt.join(query_term_stats(qt, index, small), "token")
          .select("query_id", "token", "df",
                  (F.col("qtf") * bm25_plus_one_idf(F.lit(index.n_docs), F.col("df"))).alias("wq")))
    scored = None
    if small and index.impacts is not None and index.terms is not None:
        qw = index.cut(qw)
        scored = best_bm25_scores(index, qw, k, k1, b)
    if scored is None:
        scored = _match_scores(index, qw, k, k1, b, small)
    scored = scored.where(F.col("score") > 0)
    out = top_k(scored, "query_id", [rank_score().desc(), F.col("doc_id").asc()], k)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), "score")


def tfidf_idf(index: LexicalIndex, df_col="df") -> "F.Column":
    """Smoothed idf ``ln((1 + N) / (1 + df)) + 1``; df 0 for terms outside the corpus."""
    return (F.log((F.lit(1.0 + index.n_docs)) / (F.lit(1.0) + F.coalesce(F.col(df_col), F.lit(0))))
            + F.lit(1.0))


@dataclass
class TfidfModel:
    index: LexicalIndex
    doc_norm: DataFrame   # doc_id, norm


def build_tfidf(index: LexicalIndex, materialize=_persist) -> TfidfModel:
    """Document vector norms; the one place the whole postings table meets the term table."""
    w = F.col("tf").cast("double") * tfidf_idf(index)
    # Every posting needs its term's idf. No more than FREQUENT_TERMS terms can
    # have ``least`` postings or more, so these are broadcast and add up in
    # place; the postings of the others, among which no token is hot, are joined
    # by token. The plan is the same for all sizes.
    least = max(1, -(-index.postings.count() // FREQUENT_TERMS))
    frequent = F.broadcast(index.term_df.where(F.col("df") >= least))
    square = F.sum(w * w).alias("square")
    common = index.postings.join(frequent, "token").groupBy("doc_id").agg(square)
    rest = (index.postings.join(frequent.select("token"), "token", "left_anti")
            .join(index.term_df.where(F.col("df") < least), "token").groupBy("doc_id").agg(square))
    norms = common.unionByName(rest).groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm"))
    if materialize is not None:
        norms = materialize(norms)
    return TfidfModel(index=index, doc_norm=norms)


def tfidf_query_vectors(model: TfidfModel, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """(query_id, token, idf, wq, qnorm) for non-blank queries."""
    qt = query_terms(queries, model.index.kind)
    qv = qt.join(maybe_broadcast(small, query_term_stats(qt, model.index, small)), "token", "left").select(
        "query_id", "token", tfidf_idf(model.index).alias("idf"),
        (F.col("qtf").cast("double") * tfidf_idf(model.index)).alias("wq"))
    qn = qv.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    return qv.join(qn, "query_id")


def tfidf_scores(model: TfidfModel, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """Cosine of tf-idf vectors for every (query, document) sharing a term."""
    qv = maybe_broadcast(small, tfidf_query_vectors(model, queries, small).where(F.col("wq") > 0))
    wd = F.col("tf").cast("double") * F.col("idf")
    dots = (model.index.postings.join(qv, "token")
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("wq") * wd).alias("dot"), F.max("qnorm").alias("qnorm")))
    return (dots.join(model.doc_norm, "doc_id")
            .select("query_id", "doc_id",
                    F.when(F.col("qnorm") * F.col("norm") > 0,
                           F.col("dot") / (F.col("qnorm") * F.col("norm")))
                    .otherwise(F.lit(0.0)).alias("score")))


def tfidf_search(model: TfidfModel, queries: DataFrame, k: int, small: bool | None = None) -> DataFrame:
    """U1 default encoder: tf-idf cosine top-k. Ranks the whole corpus like a dense
    retriever: ties and zero-similarity fill go to the larger doc_id first."""
    if k < 1:
        raise ValueError("k must be >= 1")
    scored = None
    if small and model.index.terms is not None:
        scored = best_tfidf_scores(model, queries, 2 * k)  # as many as a backfill of k reads
    if scored is None:
        scored = tfidf_scores(model, queries, small)
    out = zero_backfill(scored, nonblank(queries), model.index.corpus, k, ascending=False)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), "score")


def best_tfidf_scores(model: TfidfModel, queries: DataFrame, n: int) -> DataFrame | None:
    """(query_id, doc_id, score): the rows of ``tfidf_scores`` that can be among the ``n`` best of a query. A task adds up the
    scores of some documents for all queries at once and hands on each query's best ones and what ties with the last.
    None if the queries have more than ``MATRIX_TERMS`` terms."""
    asked = tfidf_query_vectors(model, queries, True).where(F.col("wq") > 0).limit(MATRIX_TERMS + 1).toPandas()
    if len(asked) > MATRIX_TERMS:
        return None
    ship_package(queries.sparkSession)
    terms = QueryTerms.of(asked)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, terms.step):
                yield terms.best(batch.slice(at, terms.step), n)

    docs = model.index.terms.join(model.doc_norm.hint("shuffle_hash"), "doc_id").select("doc_id", "norm", "terms.token", "terms.tf")
    return docs.mapInArrow(run, "query_id long, doc_id long, score double")


def best_bm25_scores(index: LexicalIndex, qw: DataFrame, n: int, k1: float, b: float) -> DataFrame | None:
    """(query_id, doc_id, score): as ``best_tfidf_scores``, sums of BM25 weights, none of them negative. None if the queries
    have more than ``MATRIX_BM25_TERMS`` terms."""
    asked = qw.where("wq > 0").select("query_id", "token", "wq").limit(MATRIX_BM25_TERMS + 1).toPandas()
    if len(asked) > MATRIX_BM25_TERMS:
        return None
    ship_package(qw.sparkSession)
    terms, avgdl = QueryTerms.of(asked.assign(idf=1.0, qnorm=1.0)), index.avgdl

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, terms.step):
                some = batch.slice(at, terms.step)
                length = k1 * ((1.0 - b) + b * some.column(1).to_numpy(zero_copy_only=False) / avgdl)
                score = terms.dots(some.column(2), some.column(3), lambda tf, code, row: tf * (k1 + 1.0) / (tf + length[row]))
                yield terms.best_cells(some.column(0), score, n)

    return index.terms.select("doc_id", "dl", "terms.token", "terms.tf").mapInArrow(run, "query_id long, doc_id long, score double")


@dataclass
class QueryTerms:
    """Terms of all queries, ordered by token: those of the token numbered ``t`` are at ``start[t]`` to ``start[t + 1]``."""
    tokens: pa.Array
    idf: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(asked: pd.DataFrame) -> QueryTerms:
        asked = asked.sort_values(["token", "query_id"], kind="stable")
        tokens, first = np.unique(asked["token"].to_numpy(str).astype(object), return_index=True)
        ids, one, query = np.unique(asked["query_id"].to_numpy(np.int64), return_index=True, return_inverse=True)
        return QueryTerms(pa.array(tokens, pa.string()), asked["idf"].to_numpy(float)[first], np.append(first, len(asked)), query,
                          asked["wq"].to_numpy(float), ids, asked["qnorm"].to_numpy(float)[one])

    @property
    def step(self) -> int:
        """Documents whose products with all terms are added up at once."""
        return max(1, MATRIX_CELLS // max(1, len(self.query)))

    def dots(self, tokens: pa.Array, tf: pa.Array, weight) -> np.ndarray:
        """Products of documents (rows) and queries added up, 0 where they share no term. ``weight``: of the numbers of a
        term in a document, the terms and the documents, the documents' factors."""
        row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.tokens), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(code >= 0)
        row, code = row[held], code[held]
        value = weight(tf.flatten().to_numpy(zero_copy_only=False)[held], code, row)
        times = np.diff(self.start)[code]
        term = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - self.start[code], times)
        cell = np.repeat(row, times) * len(self.ids) + self.query[term]
        return np.bincount(cell, self.weight[term] * np.repeat(value, times), len(tokens) * len(self.ids)).reshape(len(tokens), len(self.ids))

    def scores(self, norm: np.ndarray, tokens: pa.Array, tf: pa.Array) -> np.ndarray:
        """Cosines of documents (rows) and queries, 0 where they share no term."""
        dots = self.dots(tokens, tf, lambda n, code, row: n * self.idf[code])
        length = norm[:, None] * self.norm
        return np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)

    def best(self, batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
        return self.best_cells(batch.column(0), self.scores(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3)), n)

    def best_cells(self, ids: pa.Array, score: np.ndarray, n: int) -> pa.RecordBatch:
        """(query_id, doc_id, score) of the ``n`` best documents of each query among ``ids``."""
        keep = score != 0
        if len(score) > n:  # scores that may tie when rounded stay
            keep &= score >= np.partition(score, len(score) - n, axis=0)[len(score) - n] - 10.0 ** (1 - SCORE_DECIMALS)
        row, query = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), ids.take(pa.array(row)), pa.array(score[row, query])],
                                          names=["query_id", "doc_id", "score"])
