"""Router trained by gradient (U5, U6, U8, A18): softmax regression on hashed tokens.

A pair's text is a sparse vector of ``1 + ln(tf)`` over ``n_features`` hashed tokens, of length one, and a constant. It is
worked out once and written, partitioned by split and mini-batch, so a step reads its own batch only. Each task adds up the
gradient of its rows; Spark sums the parts by feature, and the driver gets at most one row per feature, which it turns into
an AdamW step with a rate that falls to zero over the run. The weights, ``(n_features + 1) * labels`` numbers, are all that
is broadcast; neither grows with the data. An epoch has at most ``max_batches`` steps, so batches and not jobs grow with it.

After each epoch the validation rows are scored. Training stops when their loss has not improved ``patience`` times in a
row, and the weights of the best epoch are kept.

Defined cases: a null or empty text has the constant only; without training rows the weights stay zero, the table of
epochs is empty and the first label is predicted; without validation rows all epochs run and the last one's weights stay;
rows that repeat count again; of equal scores the smallest label wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import std_tokens
from ..session import scratch_path, ship_package
from .router import hash_bucket

# Epochs and patience by default.
EPOCHS = 10
PATIENCE = 3
N_FEATURES = 1 << 14
BATCH_ROWS, MAX_BATCHES = 32, 64
RATE, DECAY = 0.05, 0.01
BETAS, EPS = (0.9, 0.999), 1e-8

EPOCH_SCHEMA = "epoch int, train_loss double, val_loss double, accuracy double, kept boolean"


@dataclass(frozen=True)
class GradientRouter:
    """``weights``: a row a feature, the last for the constant, and a column a label. ``epochs``: as ``EPOCH_SCHEMA``."""
    weights: np.ndarray
    epochs: tuple

    @property
    def n_features(self) -> int:
        return len(self.weights) - 1


def hashed_features(feats: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    """(the other columns, idx, val) of ``router_text``, in place: no row leaves its task."""
    cells = F.transform(std_tokens(F.coalesce("router_text", F.lit(""))), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(n_features)).cast("int"))
    rows = feats.withColumn("_cells", F.sort_array(cells)).withColumn("_n", F.size("_cells"))
    # in a sorted list a value's number is the distance of its first place to the next one's
    places = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.greatest("_n", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_first", F.filter(places, lambda i: (i == 1) | (F.get("_cells", i - 1) != F.get("_cells", i - 2))))
    rows = rows.withColumn("idx", F.transform("_first", lambda i: F.get("_cells", i - 1)))
    ends = F.concat(F.slice("_first", 2, F.greatest(F.size("_first"), F.lit(1))), F.array(F.col("_n") + 1))
    val = F.zip_with("_first", ends, lambda a, b: 1.0 + F.log((b - a).cast("double")))
    rows = rows.withColumn("val", F.when(F.size("idx") > 0, val).otherwise(F.array().cast("array<double>")))
    # beside the list, not within the function that divides: there it would be added up again for each value
    norms = F.array_repeat(F.sqrt(F.aggregate("val", F.lit(0.0), lambda s, x: s + x * x)), F.size("val"))
    rows = rows.withColumn("val", F.zip_with("val", norms, lambda x, n: x / n))
    return rows.drop("router_text", "_cells", "_first", "_n")


def scores(weights: np.ndarray, idx, val) -> np.ndarray:
    """Of a batch of sparse rows."""
    sizes = np.array([len(x) for x in idx])
    out = np.zeros((len(sizes), weights.shape[1]))
    if sizes.sum():
        row = np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(out, row, weights[np.concatenate(list(idx)).astype(np.int64)] * np.concatenate(list(val))[:, None])
    return out + weights[-1]


def log_softmax(s: np.ndarray) -> np.ndarray:
    top = s - s.max(axis=1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=1, keepdims=True))


def partial_gradient(shared, with_gradient: bool):
    """A task's sums: a row per feature that its rows have, and one of feature -1 with loss, rows and right predictions."""
    def run(batches):
        weights = shared.value
        n_labels = weights.shape[1]
        gradient, sums = np.zeros_like(weights), np.zeros(max(3, n_labels))
        for pdf in batches:
            if not len(pdf):
                continue
            label = pdf["label"].to_numpy(np.int64)
            logs = log_softmax(scores(weights, pdf["idx"], pdf["val"]))
            at = np.arange(len(label)), label
            sums[:3] += -logs[at].sum(), len(label), (logs.argmax(axis=1) == label).sum()
            if with_gradient:
                off = np.exp(logs)
                off[at] -= 1
                gradient[-1] += off.sum(axis=0)
                sizes = np.array([len(x) for x in pdf["idx"]])
                if sizes.sum():
                    where, value = np.concatenate(list(pdf["idx"])).astype(np.int64), np.concatenate(list(pdf["val"]))
                    np.add.at(gradient, where, np.repeat(off, sizes, axis=0) * value[:, None])
        if sums[1]:
            seen = np.flatnonzero(gradient.any(axis=1))
            out = np.zeros((len(seen) + 1, len(sums)))
            out[:-1, :n_labels], out[-1] = gradient[seen], sums
            yield pd.DataFrame({"feature": np.append(seen, -1), **{f"g{i}": out[:, i] for i in range(len(sums))}})
    return run


def summed(rows: DataFrame, weights: np.ndarray, with_gradient: bool) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of all rows, and loss, rows and right predictions."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    width = max(3, weights.shape[1])
    schema = "feature int, " + ", ".join(f"g{i} double" for i in range(width))
    parts = rows.select("label", "idx", "val").mapInPandas(partial_gradient(shared, with_gradient), schema)
    got = parts.groupBy("feature").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(width)]).toPandas()
    shared.destroy()
    feature, values = got["feature"].to_numpy(np.int64), got.drop(columns="feature").to_numpy(float)
    gradient = np.zeros_like(weights)
    gradient[feature[feature >= 0]] = values[feature >= 0][:, :weights.shape[1]]
    return gradient, values[feature < 0].sum(axis=0)[:3] if len(feature) else np.zeros(3)


class AdamW:
    """Decoupled weight decay; the rate falls in a line to zero over ``steps``."""

    def __init__(self, shape, rate: float, decay: float, steps: int):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0
        self.rate, self.decay, self.steps = rate, decay, steps

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        rate = self.rate * (1 - self.t / self.steps)
        self.t += 1
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * gradient
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * gradient * gradient
        m, v = self.m / (1 - BETAS[0] ** self.t), self.v / (1 - BETAS[1] ** self.t)
        return weights * (1 - rate * self.decay) - rate * m / (np.sqrt(v) + EPS)


def train(feats: DataFrame, n_labels: int, epochs: int = EPOCHS, patience: int = PATIENCE, n_features: int = N_FEATURES, batch_rows: int = BATCH_ROWS,
          max_batches: int = MAX_BATCHES, rate: float = RATE, decay: float = DECAY, delta: float = 0.0) -> GradientRouter:
    """``feats``: (query_id, doc_id, label, split, router_text), split being train or validation. Batches hold rows of all
    kinds, dealt by a hash of the pair; their order turns by one each epoch."""
    spark = feats.sparkSession
    ship_package(spark)
    n_train = feats.where("split = 'train'").count()
    n_batches = min(max_batches, max(1, -(-n_train // batch_rows)))
    own = hashed_features(feats.select("query_id", "doc_id", F.col("label").cast("int").alias("label"), "split", "router_text"), n_features)
    batch = F.when(F.col("split") == "train", F.pmod(hash_bucket("doc_id", "query_id"), F.lit(n_batches))).otherwise(F.lit(-1))
    own = own.select(batch.alias("batch"), "label", "idx", "val").where("label is not null")
    path = scratch_path(spark, "router-features")
    own.write.partitionBy("batch").parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    held = own.where("batch = -1")
    weights = np.zeros((n_features + 1, n_labels))
    if not n_train:
        return GradientRouter(weights, ())
    rule, best, kept, waited, rows = AdamW(weights.shape, rate, decay, epochs * n_batches), None, weights, 0, []
    for epoch in range(epochs):
        loss_sum = n_sum = 0.0
        for i in range(n_batches):
            gradient, (loss, n, _) = summed(own.where(F.col("batch") == (i + epoch) % n_batches), weights, True)
            if n:
                weights = rule.step(weights, gradient / n)
                loss_sum, n_sum = loss_sum + loss, n_sum + n
        _, (loss, n, right) = summed(held, weights, False)
        val = loss / n if n else None
        better = val is None or best is None or val <= best - delta
        rows.append((epoch + 1, loss_sum / n_sum if n_sum else None, val, right / n if n else None))
        if better:
            best, kept, waited, at = val, weights, 0, epoch + 1
        else:
            waited += 1
            if waited >= patience:
                break
    return GradientRouter(kept, tuple((*r, r[0] == at) for r in rows))


def epoch_table(spark, model: GradientRouter) -> DataFrame:
    """One row per epoch that was run; ``kept`` marks the one whose weights the model has."""
    rows = [(e, *[None if x is None else round(float(x), 6) for x in r], bool(kept)) for e, *r, kept in model.epochs]
    return spark.createDataFrame(rows, EPOCH_SCHEMA)


def predict(model: GradientRouter, feats: DataFrame) -> DataFrame:
    """(query_id, doc_id, llm_idx) of each row of (query_id, doc_id, router_text)."""
    ship_package(feats.sparkSession)
    shared = feats.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        for pdf in batches:
            best = scores(shared.value, pdf["idx"], pdf["val"]).argmax(axis=1) if len(pdf) else np.zeros(0)
            yield pdf[["query_id", "doc_id"]].assign(llm_idx=best.astype(np.int32))

    rows = hashed_features(feats.select("query_id", "doc_id", "router_text"), model.n_features)
    return rows.mapInPandas(run, "query_id long, doc_id long, llm_idx int")


def route(model: GradientRouter, pairs: DataFrame, llms: DataFrame) -> DataFrame:
    """(query_id, doc_id, llm_idx, llm) of the predicted model."""
    return predict(model, pairs).join(F.broadcast(llms), "llm_idx")
