"""Blocks hold the postings of the tokens asked for; hashed components are added up before they are gathered."""

from pyspark.sql import functions as F

from rageval.operators import dense, lexical
from rageval.plans.fixtures import Fixtures


def found(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


def test_blocks_hold_the_tokens_asked_for_and_other_queries_find_theirs(spark, tmp_path):
    docs = [f"{'word ' * 60}own{i} term{i % 3} other{i % 7}" for i in range(30)] + [f"{'word ' * 60}term1 term1", f"{'word ' * 90}term1 more"]
    ids = [*range(30), 50, 50]  # one id has texts of two lengths
    spark.createDataFrame(list(zip(ids, docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "term1 other2"), (2, "own5"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fx = Fixtures(spark, str(tmp_path))
    for index, search in ((fx.ws_index, lexical.bm25_search), (fx.std_index, lexical.match_search)):
        plain = lexical.LexicalIndex(**{**index.__dict__, "impacts": None})
        got = found(search(index, fx.queries.where("query_id = 2"), 3, small=True))
        assert got == found(search(plain, fx.queries.where("query_id = 2"), 3, small=True))
        assert {r["token"] for r in index.impacts.postings.select("token").distinct().collect()} == {"term1", "other2", "own5"}
        unknown = spark.createDataFrame([(7, "own9 own11"), (8, "term2")], "query_id long, text string")
        assert found(search(index, unknown, 3, small=True)) == found(search(plain, unknown, 3, small=True))
    both = found(lexical.match_search(fx.std_index, spark.createDataFrame([(9, "term1 more")], "query_id long, text string"), 40, small=True))
    asked = found(lexical.match_search(fx.std_index, fx.queries.where("query_id = 1"), 40, small=True))
    assert sum(r[1] == 50 for r in both) == sum(r[1] == 50 for r in asked) == 2  # by either way
    fx.close()


def test_a_text_gathers_its_dimensions_at_most(spark):
    """500 tokens, 8 components."""
    postings = spark.createDataFrame([(d, f"t{i}", 1 + i % 3) for d in (1, 2) for i in range(500 if d == 1 else 3)], "doc_id long, token string, tf int")
    vectors = dense.hashed_cells(postings, "doc_id", 8, "s")
    gathered = vectors.select(F.col("vec"))._jdf.queryExecution().optimizedPlan().toString()
    assert gathered.count("Aggregate") == 2
    import hashlib
    want = {1: [0.0] * 8, 2: [0.0] * 8}
    for r in postings.collect():
        h = hashlib.md5(f"s{r['token']}".encode()).hexdigest()
        want[r["doc_id"]][int(h[:4], 16) % 8] += r["tf"] * (1 if h[4] < "8" else -1)
    assert {r["doc_id"]: list(r["vec"]) for r in vectors.collect()} == want
