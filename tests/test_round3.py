"""Index building, bucketed writes and dense search that stay bounded as the tables grow."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rageval.operators import dense, lexical, pruned
from rageval.plans import oracle
from rageval.plans.fixtures import Fixtures
from rageval.session import write_bucketed

TEXTS = ["b a b  B c", "", None, "...", "x", "a a a a", "é e é \u2028 a", " ".join(f"w{i % 37}" for i in range(5000))]


def folder(spark, tmp_path, texts=None):
    docs = texts or [f"{'word ' * 60}own{i} term{i % 3} other{i % 7}" for i in range(30)]
    tables = {"documents": spark.createDataFrame([(i, t, "en", "web", 9) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long"),
              "benchmark": spark.createDataFrame([(1, "term1 other2"), (2, "own5")], "item_id long, text string"),
              "labels": spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_term_counts_equal_a_count_of_all_pairs_without_grouping_them(spark):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for kind in (lexical.WS, lexical.STD, lexical.BOUNDARY):
        toks = corpus.select("doc_id", lexical.tokenize(kind, "text").alias("toks"))
        want = (toks.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
                .groupBy("doc_id", "dl", "token").agg(F.count(F.lit(1)).cast("int").alias("tf")))
        got = lexical.term_counts(toks)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        built = lexical.build_index(corpus, kind, materialize=None).postings
        assert "Aggregate" not in built._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_id_and_length_are_counted_together(spark):
    corpus = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a b c"), (2, "a a"), (None, "a b"), (None, "b b")], "doc_id long, text string")
    got = lexical.build_index(corpus, lexical.WS, materialize=None).postings
    assert sorted((r.doc_id or 0, r.dl, r.token, r.tf) for r in got.collect()) == [
        (0, 2, "a", 1), (0, 2, "b", 3), (1, 2, "a", 2), (1, 2, "b", 1), (1, 2, "c", 1), (1, 3, "a", 1), (1, 3, "b", 1), (1, 3, "c", 1), (2, 2, "a", 2)]


def test_a_table_made_from_another_in_its_buckets_has_one_file_a_bucket(spark):
    corpus = write_bucketed(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text")), "round3_corpus", "doc_id", 5)
    auto = spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    toks = corpus.select("doc_id", lexical.tokenize(lexical.WS, "text").alias("toks"))
    try:
        made = write_bucketed(lexical.term_counts(toks), "round3_postings", "doc_id", 5, "token")
        assert len(made.inputFiles()) == 5
        assert made.count() == 9000
        assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == auto
    finally:
        for t in ("round3_corpus", "round3_postings"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_term_statistics_build_no_blocks_and_a_search_does(spark, tmp_path):
    fx = Fixtures(spark, folder(spark, tmp_path))
    index = fx.ws_index
    assert not [t for t in fx._tables if "blocks" in t]
    assert isinstance(index.impacts, pruned.LazyImpacts)
    assert fx.bm25().where("query_id = 2 and rank = 1").first()["doc_id"] == 5
    assert len([t for t in fx._tables if "blocks" in t]) == 2
    fx.close()


def test_term_idf_has_every_term(spark, tmp_path):
    import duckdb

    from rageval.plans.catalog import queries
    d = folder(spark, tmp_path)
    got = queries()["term_idf"](spark, d)
    assert got.columns == ["token", "df", "idf"] and got.count() == 30 + 3 + 7 + 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert sorted(con.execute(oracle.oracle_sql()["term_idf"]).fetchall()) == sorted(map(tuple, got.collect()))


def test_dense_documents_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    m = np.random.default_rng(3).normal(size=(300, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, vec array<double>").mapInPandas(counted, "doc_id long, vec array<double>")
    dense.build_dense(docs)
    assert seen.value == 300


def test_visits_leave_a_worker_in_short_frames():
    rng = np.random.default_rng(1)
    units = dense._unit_rows(rng.normal(size=(900, 4)))
    cells = dense.Cells(dense._unit_rows(rng.normal(size=(60, 4))), np.full(61, 3.2), np.full(61, 50), np.ones(61, np.int64))
    frames = list(dense._visits(cells, 3, True)([pd.DataFrame({"query_id": np.arange(900), "vec": list(units), "least": -2.0})]))
    assert max(map(len, frames)) <= dense.VISIT_ROWS < sum(map(len, frames))
    first = dense.first_cells(dense.score_bounds(units, cells), cells.rows, 4)
    assert sum(map(len, frames)) == (~first).sum()
    steps = [len(ids) for ids, _ in dense._units([pd.DataFrame({"doc_id": np.arange(900), "vec": list(units)})], "doc_id", 100)]
    assert steps == [100] * 9


def test_cells_of_a_text_are_added_up():
    got = dense.added_up(pd.Series([np.array([1, 1, 3]), np.array([0])]), pd.Series([np.array([2, -5, 1]), np.array([7])]), 4)
    assert np.array_equal(np.stack(got.to_list()), [[0, -3, 0, 1], [7, 0, 0, 0]])
    assert not len(dense.added_up(pd.Series([], dtype=object), pd.Series([], dtype=object), 4))
