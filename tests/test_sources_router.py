"""TSV round trips, optional sources and router persistence."""

import tempfile

from pyspark.sql import functions as F

from rageval.operators import router
from rageval.sources import tsv


def test_tsv_roundtrip_keeps_quotes_newlines_and_spaces(spark):
    d = tempfile.mkdtemp(prefix="tsv-")
    df = spark.createDataFrame([(1, '  a "quoted"\ttab\nnew line  '), (2, "plain")], "id long, t string")
    tsv.write_tsv(df, f"{d}/x_results.tsv")
    back = tsv.read_suffix_dir(spark, d, "_results.tsv", "id long, t string")
    assert sorted((r.retriever, r.id, r.t) for r in back.collect()) == \
        [("x", 1, '  a "quoted"\ttab\nnew line  '), ("x", 2, "plain")]


def test_missing_optional_source_is_empty(spark):
    df = tsv.read_optional(spark, "/nonexistent/rrf_results.tsv", "query_id long, doc_id long, rank int")
    assert df.count() == 0 and df.columns == ["query_id", "doc_id", "rank"]


def test_missing_work_only_lists_absent(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "retriever string")
    stored = spark.createDataFrame([("a", 1)], "retriever string, query_id long")
    assert [r.retriever for r in tsv.missing_work(expected, stored, ["retriever"]).collect()] == ["b"]


def test_router_train_save_load_route(spark):
    rows = [(i, i, "apple banana fruit" if i % 2 else "engine wheel car", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, router_text string, label double")
    split = router.hash_split(df)
    model, table = router.train_router(split.where("split = 'train'"), split.where("split = 'validation'"),
                                       grid=(0.0, 0.1))
    assert table.count() == 2
    path = tempfile.mkdtemp(prefix="router-") + "/m"
    router.save_router(model, path)
    llms = spark.createDataFrame([("m0", 0), ("m1", 1)], "llm string, llm_idx int")
    routed = router.route(router.load_router(path), df, llms)
    acc = routed.select(F.avg((F.col("llm_idx") == F.col("label").cast("int")).cast("double"))).first()[0]
    assert acc > 0.9
