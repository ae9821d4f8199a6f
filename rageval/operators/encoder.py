"""Learned text encoder (U1, R2, R3): a truncated SVD of the documents' tf-idf vectors.

A text is a sparse vector over ``n_features`` hashed tokens, ``1 + ln(tf)`` times idf, of length one. The directions that
hold most of the documents' variance are found by subspace iteration from random ones: each pass, tasks multiply their rows
with the directions so far and the products back (the most frequent features as small dense matrices, the others row by row
and feature by feature), Spark sums the parts by feature, and the driver makes the directions orthogonal again. A last pass gives the eigenvalues; of each direction the entry that
is largest in size is made positive. A text's vector is its product with the directions.

What is broadcast and gathered is ``n_features * (dims + spare)`` numbers, 9.4 MB by default, whatever the corpus; a pass
shuffles at most as much per task, and has ``TASKS`` tasks a core at most. Rows are hashed once and written, and stay in
their partitions; the texts' vectors are made of them too.

Defined cases: a null or empty text, and one whose tokens no document has, has the zero vector; with fewer independent
documents than ``dims`` the other components are zero; no documents give zero vectors; repeated rows count again.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import std_tokens
from ..session import ship_package, written

DIMS, SPARE, PASSES = 64, 8, 4
N_FEATURES = 1 << 14
#: Texts whose tokens are hashed together, rows multiplied together, and rows of a dense matrix.
HASHED_ROWS, STEP_ROWS, BLOCK_ROWS = 1_000, 1_024, 128
#: The features of a dense matrix, those that most texts have.
FREQUENT = 1_024
TASKS = 2
SEED = 11


@dataclass(frozen=True)
class Encoder:
    """``idf``: by feature; ``basis``: a row a feature, a column a component; ``values``: the singular values."""
    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def term_rows(texts: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    """(the other columns, idx, tf) of ``text``: the features of its tokens in order, and how many tokens have each."""
    ship_package(texts.sparkSession)
    keys = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_ROWS):
                some = batch.slice(at, HASHED_ROWS)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *counted_features(some.column(len(keys)), n_features)], names=[*keys, "idx", "tf"])

    rows = texts.select(*keys, std_tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    schema = rows.select(*keys, F.lit(None).cast("array<int>").alias("idx"), F.lit(None).cast("array<int>").alias("tf")).schema
    return rows.mapInArrow(run, schema)


def counted_features(toks: pa.Array, n_features: int) -> tuple[pa.Array, pa.Array]:
    coded = toks.flatten().dictionary_encode()
    cell = np.array([crc32(w) % n_features for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    pairs = np.repeat(np.arange(len(toks)), pc.list_value_length(toks).to_numpy(zero_copy_only=False)) * n_features + cell[coded.indices.to_numpy()]
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    row, feature = np.divmod(pairs[first], n_features)
    offsets = pa.array(np.searchsorted(row, np.arange(len(toks) + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (feature, np.diff(first, append=len(pairs))))


def unit_rows(idx: pa.Array, tf: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows in turn the features and values, each row of length one or zero; and where rows start, with the end."""
    starts = np.append(0, np.cumsum(pc.list_value_length(idx).to_numpy(zero_copy_only=False)))
    row = np.repeat(np.arange(len(idx)), np.diff(starts))
    feature = idx.flatten().to_numpy().astype(np.int64)
    value = (1 + np.log(tf.flatten().to_numpy())) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, len(idx)))[row]
    return feature, np.divide(value, norm, out=value, where=norm > 0), starts


def steps(batches, idf: np.ndarray):
    """Batches cut into some rows, with ``unit_rows`` of these."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            some = batch.slice(at, STEP_ROWS)
            yield some, *unit_rows(some.column("idx"), some.column("tf"), idf)


def projected(feature: np.ndarray, value: np.ndarray, starts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The product of each row with the directions."""
    out = np.zeros((len(starts) - 1, directions.shape[1]))
    bounds = starts.tolist()
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        out[i] = value[a:b] @ directions.take(feature[a:b], axis=0)
    return out


def added_product(out: np.ndarray, feature: np.ndarray, value: np.ndarray, starts: np.ndarray, directions: np.ndarray, frequent: np.ndarray) -> None:
    """Adds to ``out`` the sum over the rows x of x (x . directions). ``frequent``: the place of each feature in the dense
    matrices, or -1."""
    row, place = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), frequent[feature]
    dense, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    features = np.argsort(frequent, kind="stable")[np.count_nonzero(frequent < 0):]
    own, dense_out = directions[features], np.zeros((len(features), directions.shape[1]))
    products = projected(feature[rest], value[rest], np.searchsorted(row[rest], np.arange(len(starts))), directions)
    bounds = np.searchsorted(row[dense], np.arange(0, len(products) + BLOCK_ROWS, BLOCK_ROWS))
    for at, a, b in zip(range(0, len(products), BLOCK_ROWS), bounds, bounds[1:]):
        some = dense[a:b]
        matrix = np.zeros((len(products[at:at + BLOCK_ROWS]), len(features)))
        matrix[row[some] - at, place[some]] = value[some]
        products[at:at + BLOCK_ROWS] += matrix @ own
        dense_out += matrix.T @ products[at:at + BLOCK_ROWS]
    out[features] += dense_out
    rest = rest[np.argsort(feature[rest], kind="stable")]
    first = np.flatnonzero(np.diff(feature[rest], prepend=-1))
    bounds = np.append(first, len(rest)).tolist()
    for k, a, b in zip(feature[rest[first]].tolist(), bounds, bounds[1:]):
        out[k] += value[rest[a:b]] @ products.take(row[rest[a:b]], axis=0)


def covariance_product(rows: DataFrame, idf: np.ndarray, directions: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The sum over all rows x of x (x . directions)."""
    width, sc = directions.shape[1], rows.sparkSession.sparkContext
    shared = sc.broadcast((idf, directions, frequent))

    def run(batches):
        own_idf, own, places = shared.value
        out, used = np.zeros_like(own), np.zeros(len(own), bool)
        for _, feature, value, starts in steps(batches, own_idf):
            added_product(out, feature, value, starts, own, places)
            used[feature] = True
        seen = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(out[seen, i]) for i in range(width))], names=["feature", *(f"z{i}" for i in range(width))])

    few = rows.select("idx", "tf").coalesce(TASKS * max(1, sc.defaultParallelism))
    parts = few.mapInArrow(run, "feature int, " + ", ".join(f"z{i} double" for i in range(width)))
    got = parts.groupBy("feature").agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in range(width)]).toArrow()
    shared.destroy()
    out = np.zeros_like(directions)
    out[got["feature"].to_numpy()] = np.stack([got[f"z{i}"].to_numpy() for i in range(width)], axis=1)
    return out


def rows_with(rows: DataFrame, n_features: int) -> np.ndarray:
    """How many rows have each feature."""
    def run(batches):
        out = np.zeros(n_features, np.int64)
        for batch in batches:
            out += np.bincount(batch.column("idx").flatten().to_numpy(), minlength=n_features)
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(out[seen])], names=["feature", "n"])

    got = rows.select("idx").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_features)
    out[got["feature"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, dims: int = DIMS, n_features: int = N_FEATURES, spare: int = SPARE, passes: int = PASSES, cut=written) -> Encoder:
    """``docs``: (doc_id, text)."""
    return fit_rows(cut(term_rows(docs.select("doc_id", "text"), n_features)), dims, n_features, spare, passes)


def fit_rows(rows: DataFrame, dims: int = DIMS, n_features: int = N_FEATURES, spare: int = SPARE, passes: int = PASSES) -> Encoder:
    """``rows``: as ``term_rows``, written."""
    ship_package(rows.sparkSession)
    n, counts = rows.count(), rows_with(rows, n_features)
    idf = np.where(counts > 0, np.log((1 + n) / (1 + counts)) + 1, 0)
    frequent = np.full(n_features, -1)
    most = np.argsort(-counts, kind="stable")[:min(FREQUENT, np.count_nonzero(counts))]
    frequent[most] = np.arange(len(most))
    width = min(dims + spare, n_features)
    directions = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_features, width)))[0]
    for _ in range(passes):
        directions = np.linalg.qr(covariance_product(rows, idf, directions, frequent))[0]
    product = directions.T @ covariance_product(rows, idf, directions, frequent)
    values, turned = np.linalg.eigh((product + product.T) / 2)
    best = np.argsort(-values, kind="stable")[:dims]
    values, basis = np.maximum(values[best], 0), directions @ turned[:, best]
    none = values <= 1e-9 * max(values.max(initial=0), 1e-300)
    basis[:, none], values[none] = 0, 0
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1, 1)
    if basis.shape[1] < dims:
        basis, values = np.pad(basis, ((0, 0), (0, dims - basis.shape[1]))), np.pad(values, (0, dims - len(values)))
    return Encoder(idf, basis, np.sqrt(values))


def encode(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(the other columns, vec) of ``text``."""
    return encode_rows(term_rows(texts, len(encoder.idf)), encoder)


def encode_rows(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """(the other columns, vec) of ``term_rows``."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((encoder.idf, encoder.basis))
    keys = [c for c in rows.columns if c not in ("idx", "tf")]

    def run(batches):
        idf, basis = shared.value
        for some, *unit in steps(batches, idf):
            vecs = projected(*unit, basis)
            offsets = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * basis.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel()))], names=[*keys, "vec"])

    schema = rows.select(*keys, F.lit(None).cast("array<double>").alias("vec")).schema
    return rows.mapInArrow(run, schema)
