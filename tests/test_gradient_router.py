"""The router trained by gradient, against a plain rerun."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from rageval.operators import gradient_router as gr
from rageval.operators.router import hash_bucket

WORDS = ("red", "blue", "green", "cold", "warm", "Über", "tall", "3")
SCHEMA = "query_id long, doc_id long, label int, split string, router_text string"


def examples(n, flip=False, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, 6))
        held = i % 4 == 0
        label = int("red" in text) + int("cold" in text)
        rows.append((i, i % 7, (2 - label) if held and flip else label, "validation" if held else "train", text))
    return rows


def vector(text, n):
    counts = Counter(zlib.crc32(t.lower().encode()) % n for t in re.findall(r"\w+", text or ""))
    raw = {k: 1 + math.log(c) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {k: x / norm for k, x in raw.items()}


def rerun(rows, batch_of, n_batches, n, epochs, patience):
    """Row by row, with dense vectors."""
    x = np.zeros((len(rows), n + 1))
    for i, r in enumerate(rows):
        for k, v in vector(r[4], n).items():
            x[i, k] = v
    x[:, n] = 1
    y, held = np.array([r[2] for r in rows]), np.array([r[3] != "train" for r in rows])
    w, m, v, t, losses, best, wait = np.zeros((n + 1, 3)), 0, 0, 0, [], (math.inf, None), 0

    def chances(at):
        e = np.exp(x[at] @ w)
        return e / e.sum(axis=1, keepdims=True)
    for epoch in range(epochs):
        total = 0
        for i in range(n_batches):
            at = np.flatnonzero(~held & (batch_of == (i + epoch) % n_batches))
            if not len(at):
                continue
            p = chances(at)
            total -= np.log(p[np.arange(len(at)), y[at]]).sum()
            g = x[at].T @ (p - np.eye(3)[y[at]]) / len(at)
            rate = gr.RATE * (1 - t / (epochs * n_batches))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * gr.DECAY) - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        at = np.flatnonzero(held)
        p = chances(at)
        val = -np.log(p[np.arange(len(at)), y[at]]).mean()
        losses.append((epoch + 1, total / (~held).sum(), val, (p.argmax(axis=1) == y[at]).mean()))
        if val <= best[0]:
            best, wait = (val, w), 0
        else:
            wait += 1
            if wait >= patience:
                break
    return best[1], losses


def test_like_a_plain_rerun_and_better_than_chance(spark):
    rows, n, n_batches = examples(120), 64, 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = gr.train(df, 3, epochs=4, n_features=n, batch_rows=30)
    batch = {(r[0], r[1]): r[2] % n_batches for r in df.select("query_id", "doc_id", hash_bucket("doc_id", "query_id")).collect()}
    weights, losses = rerun(rows, np.array([batch[r[:2]] for r in rows]), n_batches, n, 4, 3)
    assert np.allclose(model.weights, weights, atol=1e-9)
    assert np.allclose([e[:4] for e in model.epochs], losses, atol=1e-9)
    table = gr.epoch_table(spark, model).collect()
    assert sum(r["kept"] for r in table) == 1 and table[-1]["val_loss"] < table[0]["val_loss"] < math.log(3)
    got = {(r["query_id"], r["doc_id"]): r["llm_idx"] for r in gr.predict(model, df).collect()}
    x = {r[:2]: vector(r[4], n) for r in rows}
    assert got == {k: int((sum(v * weights[i] for i, v in own.items()) + weights[n]).argmax()) for k, own in x.items()}


def test_stops_early_and_keeps_the_best_weights(spark):
    rows = examples(80, flip=True)
    df = spark.createDataFrame(rows, SCHEMA)
    model = gr.train(df, 3, epochs=9, patience=2, n_features=64, batch_rows=20)
    losses = [e[2] for e in model.epochs]
    assert len(losses) < 9 and len(losses) == int(np.argmin(losses)) + 3
    assert [e[4] for e in model.epochs] == [x == min(losses) for x in losses]
    again = gr.train(df, 3, epochs=9, patience=2, n_features=64, batch_rows=20)
    assert np.allclose(model.weights, again.weights, atol=1e-12)


def test_defined_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = gr.train(none, 2, n_features=8)
    assert not model.weights.any() and gr.epoch_table(spark, model).count() == 0
    odd = spark.createDataFrame([(1, 1, 0, "train", None), (2, 1, 1, "train", ""), (3, 1, 1, "train", "a " * 50_000), (3, 1, 1, "train", "a"), (4, 1, None, "train", "b")], SCHEMA)
    model = gr.train(odd, 2, epochs=2, n_features=8)
    assert [e[2] for e in model.epochs] == [None, None] and model.epochs[-1][4] and np.isfinite(model.weights).all()
    llms = spark.createDataFrame([(0, "x"), (1, "y")], "llm_idx int, llm string")
    assert gr.route(model, odd, llms).count() == 5
    assert gr.predict(model, none).count() == 0
