"""Small building blocks shared by the operators: checked broadcast, per-group top-k, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest side we hand to ``broadcast()``, in rows and in bytes. The bounds are
# checked before the hint is applied and beyond them the join is left to the
# planner (sort-merge, with AQE skew splitting).
DEFAULT_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20
# Scores are ranked at this many decimals. Sums of the same terms in another
# order differ in the last bits; the original sums each document in query-term
# order, so equal scores there are exact ties broken by position. Rounding
# makes them ties here too, on every partitioning and engine.
SCORE_DECIMALS = 10


def rank_score(col="score") -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, SCORE_DECIMALS)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows and ``max_bytes`` bytes as JSON text, else ``df``
    unchanged; one aggregation over ``df``."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    n, n_bytes = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= max_rows and n_bytes <= max_bytes else df


def top_k(df: DataFrame, partition_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() <= k`` per group.

    Spark plans this as a partial ``WindowGroupLimit`` before the shuffle and a
    final one after it, so a group never sends more than ``k`` rows per map task.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if isinstance(partition_cols, (str, Column)):
        partition_cols = [partition_cols]
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k))


def first_n(df: DataFrame, order_cols, n: int, written) -> DataFrame:
    """The first ``n`` rows in an order, without gathering them in a task: rows are dealt out by ranges of the order
    and ``written``, ranges are counted, whole ranges are kept and one is cut. ``order_cols`` should be unique."""
    ranged = written(df.repartitionByRange(*order_cols).withColumn("range_no", F.spark_partition_id()))
    keep, cut, left = [], None, n
    for no, size in ranged.groupBy("range_no").count().orderBy("range_no").collect():  # a row per partition
        if left <= 0:
            break
        if size <= left:
            keep.append(no)
        else:
            cut = no
        left -= size if cut is None else left
    whole = ranged.where(F.col("range_no").isin(keep)) if keep else ranged.where(F.lit(False))
    if cut is not None:
        rest = n - (ranged.where(F.col("range_no").isin(keep)).count() if keep else 0)
        part = ranged.where(F.col("range_no") == cut)
        whole = whole.unionByName(top_k(part, "range_no", order_cols, rest).drop("rank"))
    return whole.drop("range_no")


def doc_order(ascending: bool) -> Column:
    return F.col("doc_id").asc() if ascending else F.col("doc_id").desc()


def edge_doc_ids(corpus: DataFrame, n: int, ascending: bool) -> Column:
    """Scalar subquery: the ``n`` smallest (or largest) doc ids as a sorted array."""
    order = F.col("doc_id").asc() if ascending else F.col("doc_id").desc()
    ids = (corpus.select("doc_id").orderBy(order).limit(n)
           .agg(F.array_sort(F.collect_list("doc_id")).alias("ids")))
    arr = ids.scalar()
    return arr if ascending else F.reverse(arr)


def maybe_broadcast(small: bool | None, df: DataFrame) -> DataFrame:
    """Broadcast when the caller already knows the side is small (``True``), never
    when it knows it is not (``False``), and check the row count when unknown."""
    if small is None:
        return bounded_broadcast(df)
    return F.broadcast(df) if small else df


def zero_backfill(scored: DataFrame, queries: DataFrame, corpus: DataFrame, k: int,
                  ascending: bool = True, negatives_possible: bool = False) -> DataFrame:
    """Exact top-k over *all* documents when unmatched documents score 0.

    ``scored`` holds (query_id, doc_id, score) for matched pairs only. A
    retriever that ranks the whole corpus also returns zero-score documents,
    in document order (``ascending``) or reverse order, ahead of negative
    scores. Only the first ``L = 2k (+ max negatives per query)`` documents can
    ever be needed, so every query gets those ``L`` as zero-score candidates
    (a bounded array from one scalar subquery -- no join with the corpus).
    One top-``L`` pass over matched + zero candidates, a dedupe on at most
    ``L`` rows per query (a matched score wins over its zero copy) and a final
    top-``k`` give the exact result; the scores are computed once.
    """
    order = [rank_score().desc(), doc_order(ascending)]
    nz = scored.where(F.col("score") != 0).select("query_id", "doc_id", "score")
    extra = 0
    if negatives_possible:
        extra = int(nz.where(F.col("score") < 0).groupBy("query_id").count()
                    .agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    n_edge = 2 * k + extra
    edge = edge_doc_ids(corpus, n_edge, ascending)
    fill = (queries.select("query_id").withColumn("edge", edge)
            .select("query_id", F.explode("edge").alias("doc_id"), F.lit(0.0).alias("score")))
    first = top_k(nz.unionByName(fill), "query_id", order, n_edge).drop("rank")
    dedup = (first.groupBy("query_id", "doc_id")
             .agg(F.coalesce(F.max(F.when(F.col("score") != 0, F.col("score"))), F.lit(0.0))
                  .alias("score")))
    return top_k(dedup, "query_id", order, k)
