"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors are hashed into shards of ``SHARD_ROWS``, or more where that would make over ``MAX_SHARDS`` of them, up to
``MAX_SHARD_ROWS``: what a query costs is the number of shards, so it stays the same up to a billion vectors. Each task builds
one shard's graph over the shard's distinct vectors and gives it out as one row of flat arrays: vectors, levels, and neighbour
lists of fixed width. The rows are written once. For a search every query goes to every shard; a task holds one graph at a
time and streams the queries through it. The shards' nearest are ranked again by exact distance in double precision;
columns other than float arrays are kept in double precision throughout.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
equal length are near each other; equal vectors are one node that knows its smallest ids, so copies cost no links and
ties go to smaller ids; rows that share an id count as one, the smallest vector standing for them; fewer candidates
than ``k`` give fewer results; empty tables give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_ready, staged

SHARD_ROWS, MAX_SHARDS, MAX_SHARD_ROWS = 4096, 1024, 1_000_000
LINKS = 16
EF_BUILD = 100
EF_SEARCH = 128


@dataclass
class Graph:
    """``near[i]`` are node ``i``'s neighbours on the ground level, -1 after the last; ``upper[at[i] + l - 1]`` those on
    level ``l`` of ``level[i]``. ``ids[first[i]:first[i + 1]]`` are the ids of node ``i``, smallest first."""
    vectors: np.ndarray
    level: np.ndarray
    at: np.ndarray
    near: np.ndarray
    upper: np.ndarray
    entry: int
    ids: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        self.stamp, self.turn = np.zeros(len(self.vectors), np.int64), 0

    def links(self, node: int, level: int) -> np.ndarray:
        row = self.near[node] if level == 0 else self.upper[self.at[node] + level - 1]
        return row[row >= 0]

    def distances(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", gap, gap)

    def search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a best-first walk on a level finds, nearest first."""
        self.turn += 1
        turn, stamp = self.turn, self.stamp
        stamp[[i for _, i in starts]] = turn
        todo = list(starts)
        heapq.heapify(todo)
        found = [(-d, i) for d, i in starts]
        heapq.heapify(found)
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            own = self.links(node, level)
            own = own[stamp[own] != turn]
            if not len(own):
                continue
            stamp[own] = turn
            gaps = self.distances(own, q)
            if len(found) >= ef:
                close = gaps < -found[0][0]
                own, gaps = own[close], gaps[close]
            for g, i in zip(gaps.tolist(), own.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (-g, i))
                    heapq.heappush(todo, (g, i))
                elif g < -found[0][0]:
                    heapq.heapreplace(found, (-g, i))
                    heapq.heappush(todo, (g, i))
        return sorted((-d, i) for d, i in found)

    def choose(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Up to ``m`` nodes, nearest first, none of them closer to a chosen one than to the centre; the nearest of the
        others fill up."""
        if len(near) <= m:
            return [i for _, i in near]
        nodes = np.array([i for _, i in near])
        v = self.vectors[nodes]
        norm = np.einsum("ij,ij->i", v, v)
        between = norm[:, None] + norm[None, :] - 2 * (v @ v.T)
        closest = np.full(len(nodes), np.inf)
        kept, rest = [], []
        for k, (d, i) in enumerate(near):
            if d < closest[k]:
                kept.append(i)
                if len(kept) == m:
                    return kept
                np.minimum(closest, between[k], out=closest)
            else:
                rest.append(i)
        return kept + rest[:m - len(kept)]

    def connect(self, node: int, to: list[int], level: int) -> None:
        """Link a node both ways; a list that overflows is chosen anew."""
        for i in to:
            row = self.near[i] if level == 0 else self.upper[self.at[i] + level - 1]
            free = int(np.count_nonzero(row >= 0))
            if free < len(row):
                row[free] = node
                continue
            own = np.append(row, node)
            gaps = self.distances(own, self.vectors[i])
            order = np.argsort(gaps, kind="stable")
            row[:] = self.choose(list(zip(gaps[order].tolist(), own[order].tolist())), len(row))
        row = self.near[node] if level == 0 else self.upper[self.at[node] + level - 1]
        row[:len(to)] = to


def build(ids: np.ndarray, vectors: np.ndarray, m: int = LINKS, ef: int = EF_BUILD, keep_ids: int = 1 << 62) -> Graph:
    """A graph over the distinct rows of ``vectors``, inserted in the order of a fixed permutation."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    sorted_ids, owner = ids[order], node.ravel()[order]
    start = np.searchsorted(owner, np.arange(len(distinct) + 1))
    rank = np.arange(len(owner)) - start[owner]
    held = rank < keep_ids
    first = np.searchsorted(owner[held], np.arange(len(distinct) + 1))
    rng = np.random.default_rng(len(distinct))
    level = np.minimum((-np.log(1 - rng.random(len(distinct))) / np.log(m)).astype(np.int32), 12)
    at = np.concatenate([[0], np.cumsum(level)])[:-1].astype(np.int32)
    g = Graph(distinct, level, at, np.full((len(distinct), 2 * m), -1, np.int32), np.full((int(level.sum()), m), -1, np.int32), 0, sorted_ids[held], first)
    turns = rng.permutation(len(distinct)).tolist()
    g.entry = turns[0] if turns else -1
    for node in turns[1:]:
        q, top = distinct[node], int(level[g.entry])
        near = [(float(g.distances(np.array([g.entry]), q)[0]), g.entry)]
        for lv in range(top, -1, -1):
            near = g.search(q, near[:1] if lv >= level[node] else near, 1 if lv > level[node] else ef, lv)
            if lv <= level[node]:
                g.connect(node, g.choose(near, m), lv)
        if level[node] > top:
            g.entry = node
    return g


def nearest(g: Graph, query_id: int, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
    """The ``k`` nearest ids but the query's own with exact distances, ties by id."""
    if g.entry < 0:
        return []
    near = [(float(g.distances(np.array([g.entry]), q)[0]), g.entry)]
    for lv in range(int(g.level[g.entry]), -1, -1):
        near = g.search(q, near[:1], ef if lv == 0 else 1, lv)
    nodes = np.array([i for _, i in near])
    gap = g.vectors[nodes].astype(np.float64) - q.astype(np.float64)
    exact = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    out = []
    for j in np.argsort(exact, kind="stable").tolist():
        if len(out) >= k and exact[j] > out[k - 1][0]:
            break
        own = g.ids[g.first[nodes[j]]:g.first[nodes[j] + 1]][:k + 1].tolist()
        out += [(float(exact[j]), i) for i in own if i != query_id]
        out.sort()
    return out[:k]


ARRAYS = (("vectors", None), ("level", np.int32), ("at", np.int32), ("near", np.int32), ("upper", np.int32), ("ids", np.int64), ("first", np.int64))
INDEX_SCHEMA = "shard int, dim int, width int, entry int, links int, " + ", ".join(f"{a} binary" for a, _ in ARRAYS)


def to_row(shard: int, g: Graph) -> dict:
    return {"shard": shard, "dim": g.vectors.shape[1], "width": g.vectors.itemsize, "entry": g.entry, "links": g.upper.shape[1]} | {a: np.ascontiguousarray(getattr(g, a), t).tobytes() for a, t in ARRAYS}


def from_row(row: dict) -> Graph:
    got = {a: np.frombuffer(row[a], t or f"f{row['width']}") for a, t in ARRAYS}
    got["vectors"] = got["vectors"].reshape(-1, row["dim"])
    got["near"], got["upper"] = got["near"].reshape(-1, 2 * row["links"]), got["upper"].reshape(-1, row["links"])
    return Graph(entry=row["entry"], **got)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part; ``vec`` is of floats if the column is, else of doubles."""
    vec = vectors[vec_col]
    if vectors.schema[vec_col].dataType != T.ArrayType(T.FloatType()):
        vec = vec.cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(vectors[id_col].cast("long").alias("id"), vec.alias("vec"), F.coalesce(bad, F.lit(True)).alias("bad"))
            .where("id is not null and not bad").where(F.exists("vec", lambda x: x != 0)).select("id", "vec"))


def shards_of(n: int, shard_rows: int | None = None) -> int:
    """The number of shards of ``n`` vectors."""
    size = shard_rows or min(MAX_SHARD_ROWS, max(SHARD_ROWS, -(-n // MAX_SHARDS)))
    return max(1, -(-n // size))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int | None = None, k: int = 10) -> tuple[DataFrame, int]:
    """The written index, a row per shard and vector length, and the number of shards."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = usable(vectors, id_col, vec_col)
    n_shards = shards_of(rows.count(), shard_rows)

    def shard_graphs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task has one shard."""
        shard, ids, vecs = 0, {}, {}
        for part in parts:
            for length, own in part.groupby(part["vec"].map(len)):
                shard = int(own["shard"].iloc[0])
                ids.setdefault(length, []).append(own["id"].to_numpy(np.int64))
                vecs.setdefault(length, []).append(np.stack(own["vec"].to_numpy()))
        for length in sorted(ids):
            own, vec = np.concatenate(ids.pop(length)), np.concatenate(vecs.pop(length))
            order = np.lexsort((*vec.T[::-1], own))
            once = order[np.concatenate([[True], np.diff(own[order]) != 0])]
            yield pd.DataFrame([to_row(shard, build(own[once], vec[once], keep_ids=k + 1))])

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).repartitionById(n_shards, F.col("shard"))
    return staged(sharded.mapInPandas(shard_graphs, INDEX_SCHEMA), "hnsw"), n_shards


def search(index: DataFrame, n_shards: int, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``queries`` have ``id, vec``.

    Index rows and query rows of a shard meet in one task, the index row first, so that a task holds one graph and one
    batch of queries however many there are.
    """
    spark = index.sparkSession
    python_ready(spark)
    # rows that share an id count as one
    once = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    asked = once.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("kind", F.lit(1))
    both = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    both = both.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "kind", "dim", "id")

    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, graphs = None, {}
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if row["shard"] != shard:
                    shard, graphs = row["shard"], {}
                if row["kind"] == 0:
                    graphs[int(row["dim"])] = from_row({**row, "dim": int(row["dim"]), "width": int(row["width"]), "entry": int(row["entry"]), "links": int(row["links"])})
                else:
                    q = np.asarray(row["vec"])
                    if len(q) in graphs:
                        out += [(int(row["id"]), i, d) for d, i in nearest(graphs[len(q)], int(row["id"]), q, k, ef)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = both.mapInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Index all vectors and search for those whose id is divisible by ``every``."""
    index, n_shards = build_index(vectors, k=k)
    queries = usable(vectors, "vec_id", "embedding").where(F.col("id") % every == 0)
    return search(index, n_shards, queries, k)
