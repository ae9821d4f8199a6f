"""Dense retrieval (R2/R3/J2): exact cosine top-k of query vectors against document vectors, with bounds.

Unit vectors are dealt into cells around pivots; a table of cells has each pivot and the angle of its farthest vector. A
query first visits its nearest cells, those that hold k documents together; the k-th score there is a threshold. Of the
other cells it visits only those whose nearest possible vector, by the triangle inequality of angles, can beat it. A
task holds a part of a cell, of bounded size, and streams the queries that visit it past the matrix, a bounded number
of similarities at a time; per query it keeps ``k`` documents. A final per-query top-k merges the visits. Documents and
queries are neither collected nor broadcast; the driver holds the pivots, of bounded number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from .common import SCORE_DECIMALS, rank_score, top_k

# Documents of a part, and similarities (queries x documents) computed at once.
PART_ROWS = 20_000
MAX_CELLS = 1_000_000
# Visits, each with a query's vector, that a worker hands back at once.
VISIT_ROWS = 10_000
# Documents of a cell, about, and pivots at most, a sample of the documents.
CELL_ROWS = 1_000
MAX_PIVOTS = 8_192
# Texts whose tokens are hashed together.
HASHED_ROWS = 1_000
# Room for rounding in angles and for scores that tie when rounded.
ANGLE_SLACK = 1e-6
RESULT_SCHEMA = "query_id long, doc_id long, score double"


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    out = np.zeros_like(m)
    np.divide(m, norms, out=out, where=norms > 0)   # zero vector -> cosine 0, not NaN
    return out


def best_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` best cells by (score desc, id desc).

    A partial sort finds each row's k-th score; only cells that reach it are ordered.
    """
    score = np.round(sims, SCORE_DECIMALS)
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero(score >= least[:, None])
    order = np.lexsort((-ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _part_topk(k: int, max_cells: int):
    def run(batches):
        part, ids, vecs, matrix = None, [], [], None
        for pdf in batches:
            for key, own in pdf.groupby(["cell", "part"], sort=False):
                if key != part:
                    part, ids, vecs, matrix = key, [], [], None
                docs, asked = own[own["kind"] == 0], own[own["kind"] == 1]
                if len(docs):
                    ids.append(docs["id"].to_numpy(np.int64))
                    vecs.append(np.stack(docs["vec"].to_numpy()).astype(np.float64))
                if not len(asked) or not ids:
                    continue
                if matrix is None:
                    all_ids, matrix = np.concatenate(ids), _unit_rows(np.concatenate(vecs))
                step = max(1, max_cells // len(matrix))
                for at in range(0, len(asked), step):
                    some = asked.iloc[at:at + step]
                    sims = _unit_rows(np.stack(some["vec"].to_numpy()).astype(np.float64)) @ matrix.T
                    row, col = best_rows(sims, all_ids, k)
                    yield pd.DataFrame({"query_id": some["id"].to_numpy(np.int64)[row], "doc_id": all_ids[col], "score": sims[row, col]})
    return run


@dataclass
class Cells:
    """Pivots and, with a last cell for zero vectors (whose score is 0 for all queries), the cells' radii, rows and parts."""
    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    parts: np.ndarray


@dataclass
class DenseIndex:
    """``docs``: cell, doc_id, vec (unit or zero)."""
    docs: DataFrame
    cells: Cells


def _units(batches, key: str, step: int):
    for pdf in batches:
        for at in range(0, len(pdf), step):
            some = pdf.iloc[at:at + step]
            yield some[key].to_numpy(np.int64), _unit_rows(np.stack(some["vec"].to_numpy()).astype(np.float64))


def nearest(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and its angle; zero vectors have the number past the last."""
    sims = units @ pivots.T
    cell = sims.argmax(axis=1)
    angle = np.arccos(np.clip(sims[np.arange(len(units)), cell], -1, 1))
    zero = ~units.any(axis=1)
    return np.where(zero, len(pivots), cell), np.where(zero, 0.0, angle)


def build_dense(emb_d: DataFrame, cut=written, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS) -> DenseIndex:
    """``emb_d``: (doc_id, vec). Pivots are the documents that come first in the order of a hash, which needs one top-n."""
    ship_package(emb_d.sparkSession)
    docs = cut(emb_d.select("doc_id", F.col("vec").cast("array<double>").alias("vec")))  # read for the pivots and for the cells
    n = docs.count()
    n_pivots = min(MAX_PIVOTS, max(1, -(-n // cell_rows)))
    nonzero = F.exists("vec", lambda x: x != 0)
    picked = docs.where(nonzero).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_pivots).select("vec").collect()
    dims = len(picked[0]["vec"]) if picked else 1
    pivots = _unit_rows(np.array([r["vec"] for r in picked], np.float64).reshape(-1, dims))

    def assign(batches):
        for ids, units in _units(batches, "doc_id", max(1, MAX_CELLS // max(1, len(pivots)))):
            cell, angle = nearest(units, pivots) if len(pivots) else (np.zeros(len(ids), np.int64), np.zeros(len(ids)))
            yield pd.DataFrame({"cell": cell.astype(np.int32), "doc_id": ids, "angle": angle, "vec": list(units)})

    dealt = cut(docs.mapInPandas(assign, "cell int, doc_id long, angle double, vec array<double>"))
    radius, rows = np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1, np.int64)
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], rows[r["cell"]] = r["radius"], r["n"]
    return DenseIndex(dealt.select("cell", "doc_id", "vec"), Cells(pivots, radius, rows, np.maximum(1, -(-rows // part_rows))))


def score_bounds(units: np.ndarray, index: Cells) -> np.ndarray:
    """The best score that each query (rows) may have in each cell (columns)."""
    angle = np.arccos(np.clip(units @ index.pivots.T, -1, 1)) if len(index.pivots) else np.zeros((len(units), 0))
    best = np.cos(np.maximum(0, angle - index.radius[:-1] - ANGLE_SLACK))
    best[~units.any(axis=1)] = 0.0
    best = np.concatenate([best, np.zeros((len(units), 1))], axis=1)
    best[:, index.rows == 0] = -np.inf
    return best


def first_cells(bounds: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of each query the cells of best bound that hold ``k`` documents together."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1) - rows[order]
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order, held < k, axis=1)
    return first & np.isfinite(bounds)


def _visits(index: Cells, k: int, again: bool):
    """(cell, part, query_id, vec) rows: the first cells of each query, or the others that can beat ``least``."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), max(1, MAX_CELLS // (len(index.rows) + 1))):
                some = pdf.iloc[at:at + max(1, MAX_CELLS // (len(index.rows) + 1))]
                units = _unit_rows(np.stack(some["vec"].to_numpy()).astype(np.float64))
                bounds = score_bounds(units, index)
                go = first_cells(bounds, index.rows, k + 1)
                if again:
                    go = ~go & np.isfinite(bounds) & (bounds >= some["least"].to_numpy()[:, None] - ANGLE_SLACK)
                q, cell = np.nonzero(go)
                copies = index.parts[cell]
                part = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                q, cell = np.repeat(q, copies), np.repeat(cell, copies)
                for first in range(0, len(q), VISIT_ROWS):  # each visit has its own copy of the vector
                    few = slice(first, first + VISIT_ROWS)
                    yield pd.DataFrame({"cell": cell[few].astype(np.int32), "part": part[few].astype(np.int32), "query_id": some["query_id"].to_numpy(np.int64)[q[few]], "vec": list(units[q[few]])})
    return run


def _visited(index: DenseIndex, visits: DataFrame, k: int, max_cells: int, skip_self: bool) -> DataFrame:
    """(query_id, doc_id, score): the best documents of each visit."""
    part, n = F.lit(0), index.cells.parts
    if (n > 1).any():  # cells that are cut
        n_parts = F.create_map(*[F.lit(int(x)) for c in np.flatnonzero(n > 1) for x in (c, n[c])])
        part = F.pmod(F.xxhash64("doc_id"), F.coalesce(F.try_element_at(n_parts, F.col("cell")), F.lit(1))).cast("int")
    docs = index.docs.select("cell", part.alias("part"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "vec")
    asked = visits.select("cell", "part", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vec")
    wanted = visits.select("cell").distinct()
    both = docs.join(wanted, "cell", "left_semi").unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
    return both.mapInPandas(_part_topk(k + skip_self, max_cells), RESULT_SCHEMA).where(F.lit(not skip_self) | (F.col("query_id") != F.col("doc_id")))


def search_index(emb_q: DataFrame, index: DenseIndex, k: int, cut=written, max_cells: int = MAX_CELLS, skip_self: bool = False) -> DataFrame:
    """Top-k (query_id, doc_id, rank, score) by cosine; ties to the larger doc_id. ``skip_self``: queries are documents
    and don't find themselves. ``cut`` materialises a narrow table."""
    if k < 1:
        raise ValueError("k must be >= 1")
    order = [rank_score().desc(), F.col("doc_id").desc()]
    asked = emb_q.select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    first = cut(_visited(index, visits(asked, index, k, cut), k, max_cells, skip_self))
    kth = top_k(first, "query_id", order, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = asked.join(kth, "query_id", "left").select("query_id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
    rest = _visited(index, visits(more, index, k, cut), k, max_cells, skip_self)
    out = top_k(first.unionByName(rest), "query_id", order, k)
    return out.select("query_id", "doc_id", F.col("rank").cast("int"), "score")


def visits(asked: DataFrame, index: DenseIndex, k: int, cut=written) -> DataFrame:
    """(cell, part, query_id, vec): the first cells of each query or, with a column ``least``, the others that can beat it."""
    schema = "cell int, part int, query_id long, vec array<double>"
    return cut(asked.mapInPandas(_visits(index.cells, k, "least" in asked.columns), schema))


def dense_search(emb_q: DataFrame, emb_d: DataFrame, k: int, part_rows: int = PART_ROWS, max_cells: int = MAX_CELLS,
                 cell_rows: int = CELL_ROWS, cut=written, skip_self: bool = False) -> DataFrame:
    """Index ``emb_d`` and search it."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return search_index(emb_q, build_dense(emb_d, cut, cell_rows, part_rows), k, cut, max_cells, skip_self)


def hashed_cells(postings: DataFrame, key: str, dims: int, salt: str) -> DataFrame:
    """(key, vec): a text's tokens, each added to a component and with a sign that the md5 of ``salt`` and token sets; a
    projection of the token counts that any engine can repeat. ``postings``: (key, token, tf). Components are added up
    before they are gathered, so a text gathers ``dims`` of them at most."""
    digest = F.md5(F.concat(F.lit(salt), F.col("token")))
    cell = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % dims).alias("cell")
    sign = F.when(F.substring(digest, 5, 1) < "8", F.lit(1)).otherwise(F.lit(-1))
    ship_package(postings.sparkSession)
    by_cell = postings.select(key, cell, (F.col("tf") * sign).alias("v")).groupBy(key, "cell").agg(F.sum("v").alias("v"))
    by_text = by_cell.groupBy(key).agg(F.collect_list(F.struct("cell", "v")).alias("m"))

    @F.pandas_udf("array<double>")
    def summed(cells: pd.Series, values: pd.Series) -> pd.Series:
        return added_up(cells, values, dims)

    return by_text.select(key, summed("m.cell", "m.v").alias("vec"))


def added_up(cells: pd.Series, values: pd.Series, dims: int) -> pd.Series:
    """Of each row, ``values`` added to the components that ``cells`` names."""
    if not len(cells):
        return pd.Series([], dtype=object)
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    at = row * dims + np.concatenate(cells.to_list()).astype(np.int64)
    return pd.Series(list(np.bincount(at, np.concatenate(values.to_list()).astype(np.float64), len(cells) * dims).reshape(-1, dims)))


def hashed_texts(docs: DataFrame, key: str, encoders: dict[str, int]) -> DataFrame:
    """(key, a vector per encoder) of (key, toks): the vectors of ``hashed_cells`` for all encoders (salt: dimensions) in
    one pass over whole texts, without postings or a shuffle. A token is hashed once for ``HASHED_ROWS`` texts; texts
    without tokens have zero vectors. Rows of one key stay apart."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_ROWS):
                yield hashed_batch(batch.slice(at, HASHED_ROWS), encoders)

    schema = ", ".join([f"{key} {docs.schema[key].dataType.simpleString()}", *(f"{salt} array<double>" for salt in encoders)])
    return docs.select(key, F.coalesce("toks", F.array().cast("array<string>")).alias("toks")).mapInArrow(run, schema)


def hashed_batch(batch: pa.RecordBatch, encoders: dict[str, int]) -> pa.RecordBatch:
    """The vectors of a batch of (key, toks)."""
    toks = batch.column(1)
    row = np.repeat(np.arange(len(toks)), pc.list_value_length(toks).to_numpy(zero_copy_only=False))
    coded = toks.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    out = [batch.column(0)]
    for salt, dims in encoders.items():
        start = salt.encode()
        digest = np.frombuffer(b"".join(hashlib.md5(start + w).digest()[:3] for w in words), np.uint8).reshape(-1, 3).astype(np.int64)
        cell, sign = (digest[:, 0] * 256 + digest[:, 1]) % dims, np.where(digest[:, 2] < 128, 1.0, -1.0)
        vecs = np.bincount(row * dims + cell[code], sign[code], len(toks) * dims)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(vecs) + 1, dims), pa.int32()), pa.array(vecs, pa.float64())))
    return pa.RecordBatch.from_arrays(out, names=[batch.schema.names[0], *encoders])


def with_zero_vectors(ids: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """One row per id, texts without tokens having the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dims)
    return ids.select(key).join(vectors, key, "left").select(key, F.coalesce("vec", zero).alias("vec"))


def embed_texts(df: DataFrame, text_col: str, encode_fn, out_col: str = "vec") -> DataFrame:
    """Batch text embedding with a user encoder, as an iterator pandas UDF.

    ``encode_fn(texts: list[str]) -> array-like (n, dims)``. The model is
    created once per task by the caller's closure and applied per Arrow batch.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vecs = np.asarray(encode_fn(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))

    return df.withColumn(out_col, encode(F.col(text_col)))
