"""Cheaper steps of the shared stages give what the plain ones gave."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rageval.functions import text as T
from rageval.operators import dense, lexical
from rageval.plans.fixtures import ENCODERS, Fixtures

ODD = ["", " ", "one", " a  b\tc\n", "x" * 5000, "ZÜRICH 3.14 don't_stop", "　a b c\x1fd", "\U0001d538\U0001d7d9 \U0001f600 İǅ", "a " * 51, None]


def corpus(sf_dir, spark, rows):
    sf_dir.mkdir(parents=True)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, "term1 common")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return Fixtures(spark, str(sf_dir))


def test_tokens_and_word_limits_are_as_before(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, text string")
    std = F.regexp_extract_all(F.lower("text"), F.lit(T.STD_TOKEN_PATTERN), 0)
    assert df.where(~std.eqNullSafe(T.std_tokens("text"))).isEmpty()
    for n in (-1, 0, 1, 2, 3, 50, 51):
        assert df.where(~(T.word_count("text") > n).eqNullSafe(T.more_words_than("text", n))).isEmpty(), n


def test_hashed_vectors_come_from_texts_in_one_pass(spark, tmp_path):
    """Both encoders' vectors equal those from the postings, also where an id repeats; the plan has no shuffle."""
    rows = [(d, " ".join(f"Term{(d * i) % 37} common" for i in range(60))) for d in range(1, 9)]
    for name, own in (("once", rows), ("twice", [*rows, (3, "again " * 70)])):
        fx = corpus(tmp_path / name, spark, own)
        got = {}
        for r in fx.text_vectors.collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert sum(map(len, got.values())) == len(own)
        for salt, dims in ENCODERS.items():
            for r in dense.hashed_cells(fx.std_index.postings, "doc_id", dims, salt).collect():
                assert all(np.array_equal(x[salt], r["vec"]) for x in got[r["doc_id"]])
        fx.close()
    toks = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "doc_id long, toks array<string>")
    vectors = dense.hashed_texts(toks, "doc_id", {"s": 4})
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: bool(any(r["s"])) for r in vectors.collect()} == {1: True, 2: False, 3: False}


def test_postings_are_written_without_a_sort(spark, tmp_path):
    """Nothing reads postings by a literal token, so their sort by token within buckets was for nothing."""
    fx = corpus(tmp_path / "c", spark, [(d, f"term{d} common " * 60) for d in range(1, 9)])
    for table in (fx.ws_index.postings, fx.ws_index.impacts.postings, fx.ws_index.impacts.bounds):
        plan = table._jdf.queryExecution().analyzed().toString()
        assert "rageval_" in plan
        name = next(x for x in plan.replace(",", " ").replace("[", " ").split() if "rageval_" in x).split(".")[-1]
        assert "Sort Columns" not in {r["col_name"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["data_type"] not in ("", "[]")}
    assert lexical.has_repeated_ids(fx.corpus) is False
    fx.close()


def test_a_row_adds_up_its_norm_once(spark):
    """The norm was part of the function that divides by it, so a text of n features added up n squared of them."""
    from rageval.operators.gradient_router import hashed_features
    rows = hashed_features(spark.createDataFrame([("a b b",), ("",), (None,)], "router_text string"), 1 << 14)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(SQRT(aggregate(" in plan and "/ SQRT(" not in plan
    got = [r["val"] for r in rows.collect()]
    norm = (1.0 + (1.0 + np.log(2.0)) ** 2) ** 0.5
    assert np.allclose(sorted(got[0]), [1.0 / norm, (1.0 + np.log(2.0)) / norm]) and got[1:] == [[], []]
