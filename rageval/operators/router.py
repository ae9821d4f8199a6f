"""Learned routing: training rows (P3), hash split (U4), router model (U5-U7), routing (U8).

The router predicts, from the query and document text, which model answers
best. The default is multinomial naive Bayes: its tables are token counts per
model, made and applied by grouped joins, so a result can be recomputed in
SQL. A Spark ML pipeline (tokenise, hashed term frequencies, idf, multinomial
logistic regression) is the other choice. In both, the validation split picks
the smoothing or regularisation, the way early stopping on validation loss
does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import std_tokens

# Validation share (20 %) and the split seed.
VALIDATION_SHARE = 20
SPLIT_SEED = "42"
REG_GRID = (0.01, 0.1)


def hash_bucket(*cols) -> "F.Column":
    """0..65535 from the md5 of the key: the same on every engine and partitioning."""
    key = F.concat_ws("|", F.lit(SPLIT_SEED), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def hash_split(df: DataFrame, key_cols=("query_id", "doc_id"), share: int = VALIDATION_SHARE) -> DataFrame:
    """U4: ``split`` = validation for ``share`` % of keys, train otherwise (stable)."""
    b = hash_bucket(*key_cols)
    return df.withColumn("split", F.when((b % 100) < share, F.lit("validation")).otherwise(F.lit("train")))


def router_features(rows: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(…, router_text): query text then document text."""
    return (rows.join(queries.select("query_id", F.col("text").alias("qtext")), "query_id")
            .join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
            .withColumn("router_text", F.concat_ws(" ", "qtext", "dtext")))


SMOOTHING_GRID = (1.0, 0.1)


@dataclass(frozen=True)
class NaiveBayes:
    """``tokens``: (token, counts), the counts by label; ``rows`` and ``totals``: training rows and tokens by label."""
    tokens: DataFrame
    rows: tuple[int, ...]
    totals: tuple[int, ...]
    n_tokens: int
    smoothing: float


def token_counts(feats: DataFrame, keys) -> DataFrame:
    """(keys, token, tf) of ``router_text``."""
    return feats.select(*keys, F.explode(std_tokens("router_text")).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def fit_naive_bayes(train: DataFrame, n_labels: int, written, smoothing: float = SMOOTHING_GRID[0]) -> NaiveBayes:
    """``train``: (query_id, doc_id, label, router_text). One grouped count; ``written`` cuts the table's lineage."""
    seen = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    by_label = token_counts(train, ["label"])
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("tf"))), F.lit(0)) for i in range(n_labels)])
    tokens = written(by_label.groupBy("token").agg(counts.alias("counts")))
    sums = tokens.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(n_labels)]).first()
    return NaiveBayes(tokens, tuple(seen.get(i, 0) for i in range(n_labels)), tuple(sums[1:]), sums[0], smoothing)


def naive_bayes_scores(model: NaiveBayes, feats: DataFrame) -> DataFrame:
    """(query_id, doc_id, scores): log prior plus log likelihood by label, at 9 decimals; tokens that training didn't see
    say nothing, and a label without training rows has no score."""
    a, total = model.smoothing, sum(model.rows)
    own = token_counts(feats, ["query_id", "doc_id"]).join(model.tokens, "token")
    sums = own.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n"), *[
        F.sum(F.col("tf") * F.log(F.col("counts")[i] + F.lit(a))).alias(f"s{i}") for i in range(len(model.rows))])
    every = feats.select("query_id", "doc_id").distinct().join(sums, ["query_id", "doc_id"], "left")
    scores = []
    for i, (rows, tokens) in enumerate(zip(model.rows, model.totals)):
        if not rows:
            scores.append(F.lit(None).cast("double"))
            continue
        scores.append(F.round(F.lit(math.log(rows / total)) + F.coalesce(f"s{i}", F.lit(0.0))
                              - F.coalesce("n", F.lit(0)) * F.lit(math.log(tokens + a * model.n_tokens)), 9))
    return every.select("query_id", "doc_id", F.array(*scores).alias("scores"))


def predicted_label(scores="scores") -> Column:
    """The label with the highest score, the smallest of equals."""
    ranked = F.transform(F.col(scores), lambda s, i: F.struct(F.coalesce(s, F.lit(float("-inf"))).alias("s"), (-i).alias("i")))
    return (-F.array_max(ranked)["i"]).cast("int")


def naive_bayes_eval(model: NaiveBayes, validation: DataFrame) -> DataFrame:
    """(smoothing, n_rows, log_loss, accuracy) over rows that have a ``label``; a label without training rows counts
    as a probability of 1e-15."""
    scored = naive_bayes_scores(model, validation).join(validation.select("query_id", "doc_id", F.col("label").cast("int")), ["query_id", "doc_id"])
    best = F.array_max("scores")
    log_sum = best + F.log(F.aggregate("scores", F.lit(0.0), lambda n, s: n + F.coalesce(F.exp(s - best), F.lit(0.0))))
    log_p = F.greatest(F.coalesce(F.element_at("scores", F.col("label") + 1) - log_sum, F.lit(math.log(1e-15))), F.lit(math.log(1e-15)))
    return scored.agg(F.lit(model.smoothing).alias("smoothing"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(-log_p), 6).alias("log_loss"),
                      F.round(F.avg((predicted_label() == F.col("label")).cast("int")), 6).alias("accuracy"))


def train_naive_bayes(train: DataFrame, validation: DataFrame, n_labels: int, written, grid=SMOOTHING_GRID) -> tuple[NaiveBayes, DataFrame]:
    """The smoothing with the lowest validation loss, the first of equals, and the table of all."""
    model = fit_naive_bayes(train, n_labels, written)
    models = [replace(model, smoothing=a) for a in grid]
    table = None
    for m in models:
        own = naive_bayes_eval(m, validation)
        table = own if table is None else table.unionByName(own)
    table = written(table)
    loss = {r["smoothing"]: r["log_loss"] for r in table.collect()}
    return min(models, key=lambda m: (loss[m.smoothing] is None, loss[m.smoothing])), table


def route_naive_bayes(model: NaiveBayes, pairs: DataFrame, llms: DataFrame) -> DataFrame:
    """(query_id, doc_id, llm_idx, llm) of the predicted model."""
    pred = naive_bayes_scores(model, pairs).select("query_id", "doc_id", predicted_label().alias("llm_idx"))
    return pred.join(F.broadcast(llms), "llm_idx")


def router_pipeline(reg: float, n_features: int = 1 << 16) -> Pipeline:
    tok = RegexTokenizer(inputCol="router_text", outputCol="tokens", pattern=r"[\p{L}\p{N}]+",
                         gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg,
                            family="multinomial", maxIter=25)
    return Pipeline(stages=[tok, tf, idf, lr])


def train_router(train: DataFrame, validation: DataFrame, grid=REG_GRID):
    """Fit one model per regularisation value, keep the lowest validation log-loss.

    Returns (model, table of (reg, log_loss, accuracy)).
    """
    spark = train.sparkSession
    ev_loss = MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss")
    ev_acc = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    best, rows = None, []
    for reg in grid:
        model = router_pipeline(reg).fit(train)
        pred = model.transform(validation)
        loss, acc = ev_loss.evaluate(pred), ev_acc.evaluate(pred)
        rows.append((float(reg), float(loss), float(acc)))
        if best is None or loss < best[1]:
            best = (model, loss)
    return best[0], spark.createDataFrame(rows, "reg double, log_loss double, accuracy double")


def save_router(model: PipelineModel, path: str) -> None:
    """Persist the whole pipeline (tokeniser to classifier)."""
    model.write().overwrite().save(path)


def load_router(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def route(model: PipelineModel, pairs: DataFrame, llms: DataFrame) -> DataFrame:
    """Predicted label -> model name via the model dimension (broadcast, fixed size)."""
    pred = model.transform(pairs).withColumn("llm_idx", F.col("prediction").cast("int"))
    return pred.join(F.broadcast(llms), "llm_idx")
