import numpy as np

from rageval.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, kind string"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float32)
        good[i] = v if i not in good or tuple(v) < tuple(good[i]) else good[i]
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(((good[q].astype(float) - v.astype(float)) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def test_small_table_exactly_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # more copies of a query than results
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [None] + [1.0] * 7), (404, [float("nan")] * 8), (405, [float("inf")] + [1.0] * 7)]
    rows += [(410, [1.0, 2.0]), (420, [1.0, 2.5]), rows[5], rows[5], (None, rows[7][1])]
    docs = spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], SCHEMA)
    want = brute(rows, 10, 10)
    got = {}
    for r in hnsw.nearest_neighbours(docs, every=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert {q for q, near in want.items() if near} == set(got)
    for q, near in want.items():
        own = [got[q][k] for k in sorted(got.get(q, {}))]
        assert sorted(got.get(q, {})) == list(range(1, len(near) + 1))
        assert [i for _, i in own] == [i for _, i in near] and np.allclose([s for s, _ in own], [s for s, _ in near], rtol=1e-12)


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (1e6 + 1e-6 * rng.normal(size=4)).tolist()) for i in range(60)] + [(100, [1e60] * 4), (200, [2e60] * 4)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["rank"]: r for r in hnsw.nearest_neighbours(docs, every=100).collect() if r["query_id"] == 0}
    at = {i: np.array(v) for i, v in rows}
    want = sorted((float(np.sqrt(((at[0] - at[i]) ** 2).sum())), i) for i in at if i != 0)[:10]
    assert [got[k]["vec_id"] for k in range(1, 11)] == [i for _, i in want] and np.allclose([got[k]["score"] for k in range(1, 11)], [d for d, _ in want], rtol=1e-12)


def test_shards_stay_few():
    assert [hnsw.shards_of(n) for n in (0, 1, 4096, 4097, 51_282, 10 ** 7, 10 ** 9, 10 ** 10)] == [1, 1, 1, 2, 13, 1024, 1024, 10_000]


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.5 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(2500)]
    docs = spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], SCHEMA)
    index, n = hnsw.build_index(docs, shard_rows=800)
    assert n == 4 and index.count() == 4
    want = brute(rows, 50, 10)
    queries = hnsw.usable(docs, "vec_id", "embedding").where("id % 50 = 0")
    found = {}
    for r in hnsw.search(index, n, queries).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_empty_and_alone(spark):
    assert hnsw.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hnsw.nearest_neighbours(spark.createDataFrame([(0, [1.0], 1, 1, "x")], SCHEMA)).count() == 0
