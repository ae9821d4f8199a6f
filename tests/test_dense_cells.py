"""Bounded dense search: equal to all pairs, and most cells stay unvisited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rageval.operators import dense


def made(seed=1, n=900, dims=16, groups=30):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims)) * 4
    m = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.4
    m[5] = m[6] = m[7] * 3.0  # equal directions tie
    m[8:12] = 0.0
    return m


def brute(q, d, k, skip):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    sims = np.round(unit(q) @ unit(d).T, 10)
    out = []
    for i, row in enumerate(sims):
        order = [j for j in np.lexsort((-np.arange(len(d)), -row)) if not (skip and i == j)][:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order)]
    return out


def frame(spark, m, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, vec array<double>").repartition(3)


@pytest.mark.parametrize("k, skip", [(3, True), (40, False)])
def test_same_rows_as_all_pairs(spark, k, skip):
    m = made()
    got = dense.dense_search(frame(spark, m[:60], "query_id"), frame(spark, m, "doc_id"), k, part_rows=20, cell_rows=25, max_cells=3000, skip_self=skip)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got.collect()) == sorted(brute(m[:60], m, k, skip))


def test_most_cells_stay_unvisited(spark):
    m = made()
    asked = frame(spark, m[20:80], "query_id")
    index = dense.build_dense(frame(spark, m, "doc_id"), cell_rows=25)
    full = dense.search_index(asked, index, 3)
    least = full.where("rank = 3").select("query_id", F.col("score").alias("least"))
    first = dense.visits(asked, index, 3).count()
    more = dense.visits(asked.join(least, "query_id"), index, 3).count()
    assert first + more < 60 * len(index.cells.rows) / 4


def test_bounds_hold():
    m = made(3)
    units = dense._unit_rows(m)
    pivots = units[20:50]
    cell, angle = dense.nearest(units, pivots)
    radius = np.array([angle[cell == c].max(initial=0) for c in range(31)])
    rows = np.bincount(cell, minlength=31)
    bounds = dense.score_bounds(units[:100], dense.Cells(pivots, radius, rows, np.ones(31, int)))
    assert (units[:100] @ units.T <= bounds[:, cell] + 1e-9).all()


def test_one_direction_and_no_documents(spark):
    same = np.ones((50, 4))
    got = dense.dense_search(frame(spark, same[:2], "query_id"), frame(spark, same, "doc_id"), 2, part_rows=7, cell_rows=10).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == [(0, 48, 2), (0, 49, 1), (1, 48, 2), (1, 49, 1)]
    zero = dense.dense_search(frame(spark, same[:1], "query_id"), frame(spark, np.zeros((5, 4)), "doc_id"), 2).collect()
    assert sorted((r.doc_id, r["rank"]) for r in zero) == [(3, 2), (4, 1)]
