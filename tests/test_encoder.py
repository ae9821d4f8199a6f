"""The learned encoder against a dense singular value decomposition."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from rageval.operators import encoder

TOPICS = (("river", "water", "boat", "fish", "bank"), ("stock", "bond", "bank", "money", "rate"), ("goal", "team", "ball", "match", "coach"))


def texts(n):
    rng = np.random.default_rng(3)
    return [" ".join(rng.choice(TOPICS[i % 3], 12)) + f" w{i % 17}" for i in range(n)]


def counts(text, n):
    return Counter(zlib.crc32(t.lower().encode()) % n for t in re.findall(r"\w+", text or ""))


def matrix(rows, idf, n):
    out = np.zeros((len(rows), n))
    for i, t in enumerate(rows):
        for k, c in counts(t, n).items():
            out[i, k] = (1 + math.log(c)) * idf[k]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def test_like_a_dense_decomposition(spark):
    rows, n, d = texts(90) + [None, ""], 128, 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = encoder.fit(df, dims=d, n_features=n, passes=12)
    seen = Counter(k for t in rows for k in counts(t, n))
    idf = np.array([math.log((1 + len(rows)) / (1 + seen[k])) + 1 if k in seen else 0 for k in range(n)])
    assert np.allclose(got.idf, idf)
    a = matrix(rows, idf, n)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(got.values, values[:d], rtol=1e-6)
    assert np.allclose(got.basis @ got.basis.T, right[:d].T @ right[:d], atol=1e-4)
    top = np.abs(got.basis).argmax(axis=0)
    assert (got.basis[top, range(d)] > 0).all()
    vecs = {r["doc_id"]: r["vec"] for r in encoder.encode(df, got).collect()}
    assert np.allclose([vecs[i] for i in range(len(rows))], a @ got.basis, atol=1e-9)
    assert not any(vecs[90]) and not any(vecs[91])
    unit = np.array([vecs[i] for i in range(90)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.arange(90)[:, None] % 3 == np.arange(90) % 3
    assert (unit @ unit.T)[same].mean() > 0.9 > 0.4 > (unit @ unit.T)[~same].mean()


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = encoder.fit(none, dims=4, n_features=16)
    assert not empty.basis.any() and encoder.encode(none, empty).count() == 0
    two = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c " * 100_000)], "doc_id long, text string")
    got = encoder.fit(two, dims=4, n_features=16)
    assert (got.values > 0).sum() == 2
    asked = spark.createDataFrame([(7, "unheard of", "x"), (8, "b a", "y")], "query_id long, text string, vec_id string")
    vecs = {r["query_id"]: r["vec"] for r in encoder.encode(asked, got).collect()}
    docs = {r["doc_id"]: r["vec"] for r in encoder.encode(two, got).collect()}
    assert np.allclose(vecs[8], docs[1]) and np.allclose(docs[1], docs[2]) and len(vecs[7]) == 4
