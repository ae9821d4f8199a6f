"""Retrieval quality metrics (A6-A12, A16) as grouped aggregations.

``runs`` is the long result table ``(retriever, query_id, doc_id, rank, ...)``;
a consensus "sentinel" row has ``doc_id`` null. ``qrels`` is
``(query_id, doc_id, label)`` with label 1 relevant, 0 judged irrelevant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import f1, safe_div


def _retrieved_sets(runs: DataFrame) -> DataFrame:
    """Set semantics -- one row per (retriever, query, document); the sentinel is one item."""
    return runs.select("retriever", "query_id", "doc_id").dropDuplicates()


def per_query_hits(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(retriever, query_id, n_retrieved, tp, n_relevant, has_sentinel) per retrieved query."""
    pos = qrels.where(F.col("label") == 1).select("query_id", "doc_id").dropDuplicates()
    hits = _retrieved_sets(runs).join(pos.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    per_q = (hits.groupBy("retriever", "query_id")
             .agg(F.count(F.lit(1)).alias("n_retrieved"),
                  F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("tp"),
                  F.max(F.col("doc_id").isNull().cast("int")).alias("has_sentinel")))
    n_rel = pos.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return (per_q.join(n_rel, "query_id", "left")
            .withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)).cast("long")))


def macro_metrics(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean per-query precision and recall over the queries each retriever
    returned; F1 of the two means; queries with no hit split into no_docs (the
    sentinel was returned) and wrong_docs."""
    pq = per_query_hits(runs, qrels)
    pq = pq.select("retriever", "query_id", "tp", "has_sentinel",
                   safe_div("tp", "n_retrieved").alias("p"),
                   safe_div("tp", "n_relevant").alias("r"))
    agg = (pq.groupBy("retriever")
           .agg(F.count(F.lit(1)).alias("n_queries"),
                F.avg("p").alias("precision"), F.avg("r").alias("recall"),
                F.sum(F.when((F.col("tp") == 0) & (F.col("has_sentinel") == 0), 1).otherwise(0))
                .cast("long").alias("wrong_docs_count"),
                F.sum(F.when((F.col("tp") == 0) & (F.col("has_sentinel") == 1), 1).otherwise(0))
                .cast("long").alias("no_docs_count")))
    return agg.select("retriever", "n_queries",
                      F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"),
                      F.round(f1("precision", "recall"), 6).alias("f1_score"),
                      "wrong_docs_count", "no_docs_count")


def inaccurate_queries(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """A10 rows: every (retriever, query) with no true positive, with its set sizes."""
    pq = per_query_hits(runs, qrels)
    return (pq.where(F.col("tp") == 0)
            .select("retriever", "query_id", "n_retrieved", "n_relevant",
                    F.when(F.col("has_sentinel") == 1, F.lit("no_docs"))
                    .otherwise(F.lit("wrong_docs")).alias("error_class")))


def sample_failures(failures: DataFrame, n: int = 5, seed: int = 0,
                    key_cols=("retriever", "query_id")) -> DataFrame:
    """A repeatable sample of up to ``n`` failing queries per retriever.

    Ordered by ``md5(seed || key)``, so any engine and any partitioning draws
    the same rows; the limit is the feature (a sample), done per group with
    the same partial top-k as retrieval.
    """
    from .common import top_k
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    return (top_k(failures.withColumn("draw", key), "retriever", [F.col("draw").asc()], n,
                  rank_col="sample_rank")
            .drop("draw"))


def micro_metrics(runs: DataFrame, qrels: DataFrame, retrievers: DataFrame, k: int) -> DataFrame:
    """TP/FP/FN/TN summed over queries per retriever, then P, R, F1, accuracy.

    Only judged documents count: a retrieved document absent from ``qrels``
    is ignored. FN and TN come from the judged totals minus the retrieved
    hits, so no (retriever x judged pair) product is formed. ``retrievers``
    is the (retriever) dimension so a retriever without rows still appears.
    """
    cut = runs.where(F.col("rank") <= k).select("retriever", "query_id", "doc_id").dropDuplicates()
    judged = qrels.select("query_id", "doc_id", "label").dropDuplicates(["query_id", "doc_id"])
    totals = judged.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
                        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("n_neg"))
    n_pos = totals.select("n_pos").scalar()
    n_neg = totals.select("n_neg").scalar()
    hits = (cut.join(judged, ["query_id", "doc_id"])
            .groupBy("retriever")
            .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("tp"),
                 F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("fp")))
    m = (retrievers.select("retriever").distinct().join(hits, "retriever", "left")
         .select("retriever",
                 F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                 F.coalesce("fp", F.lit(0)).cast("long").alias("fp")))
    m = m.select("retriever", "tp", "fp",
                 (F.coalesce(n_pos, F.lit(0)) - F.col("tp")).cast("long").alias("fn"),
                 (F.coalesce(n_neg, F.lit(0)) - F.col("fp")).cast("long").alias("tn"))
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return m.select("retriever", "tp", "fp", "fn", "tn",
                    F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(f1(p, r), 6).alias("f1_score"), F.round(acc, 6).alias("accuracy"))


def run_cardinality(runs: DataFrame) -> DataFrame:
    """Distinct queries and documents per retriever."""
    return (runs.groupBy("retriever")
            .agg(F.countDistinct("query_id").alias("n_queries"),
                 F.countDistinct("doc_id").alias("n_documents"),
                 F.count(F.lit(1)).alias("n_rows")))


def coverage_summary(judged: DataFrame) -> DataFrame:
    """Queries seen, queries with a relevant document, relevant rows, queries without."""
    per_q = judged.groupBy("query_id").agg(F.sum("prediction").alias("n_rel"))
    return per_q.agg(F.count(F.lit(1)).alias("total_queries"),
                     F.sum(F.when(F.col("n_rel") > 0, 1).otherwise(0)).cast("long")
                     .alias("queries_with_relevant"),
                     F.coalesce(F.sum("n_rel"), F.lit(0)).cast("long").alias("relevant_rows"),
                     F.sum(F.when(F.col("n_rel") == 0, 1).otherwise(0)).cast("long")
                     .alias("queries_without_relevant"))


def ppi_estimate(unlabelled: DataFrame, labelled: DataFrame, group_cols=(), z: float = 1.96) -> DataFrame:
    """Prediction-powered mean estimate with a normal interval.

    ``unlabelled`` has a 0/1 judge prediction ``f``; ``labelled`` has ``f`` and
    the gold label ``y``. Estimate ``mean(f over unlabelled) + mean(y - f over
    labelled)``; half-width ``z * sqrt(var(f)/N + var(y - f)/n)`` (population
    variances). Both sides are stacked and summarised by one grouped
    aggregation with conditional aggregates -- no join between them.
    """
    g = list(group_cols)
    if not g:
        unlabelled = unlabelled.withColumn("scope", F.lit("all"))
        labelled = labelled.withColumn("scope", F.lit("all"))
        g = ["scope"]
    u = unlabelled.select(*g, F.col("f").cast("double").alias("f"), F.lit(None).cast("double").alias("y"),
                          F.lit(0).alias("is_lab"))
    lab = labelled.select(*g, F.col("f").cast("double").alias("f"), F.col("y").cast("double").alias("y"),
                          F.lit(1).alias("is_lab"))
    is_u, is_l = F.col("is_lab") == 0, F.col("is_lab") == 1
    rect = F.col("y") - F.col("f")
    both = u.unionByName(lab).groupBy(*g).agg(
        F.nullif(F.sum(F.when(is_u, 1).otherwise(0)).cast("long"), F.lit(0).cast("long")).alias("n_unlabelled"),
        F.avg(F.when(is_u, F.col("f"))).alias("mean_f"),
        F.var_pop(F.when(is_u, F.col("f"))).alias("var_f"),
        F.nullif(F.sum(F.when(is_l, 1).otherwise(0)).cast("long"), F.lit(0).cast("long")).alias("n_labelled"),
        F.avg(F.when(is_l, rect)).alias("mean_rect"),
        F.var_pop(F.when(is_l, rect)).alias("var_rect"),
        F.avg(F.when(is_l, F.col("y"))).alias("gold_mean"))
    est = F.col("mean_f") + F.col("mean_rect")
    half = F.lit(z) * F.sqrt(F.col("var_f") / F.col("n_unlabelled") + F.col("var_rect") / F.col("n_labelled"))
    return both.select(*g, "n_unlabelled", "n_labelled",
                       F.round(F.col("mean_f"), 6).alias("judge_mean"),
                       F.round(F.col("gold_mean"), 6).alias("gold_mean"),
                       F.round(est, 6).alias("estimate"),
                       F.round(est - half, 6).alias("ci_low"),
                       F.round(est + half, 6).alias("ci_high"))
