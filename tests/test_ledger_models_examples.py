"""The answer ledger, saved router versions and the judge by labelled examples, on small tables."""

import os
import tempfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rageval.operators import example_judge, ledger, model_table, router
from rageval.session import written

ROWS = [("a", 1, 1, "one"), ("a", 1, 2, "two"), ("b", 1, 1, "one"), ("a", 2, 1, "refused"), ("a", 3, 1, "down"),
        (None, 1, 1, "one"), ("a", 4, 1, None), ("a", 1, 1, "one")]
SCHEMA = "llm string, query_id long, doc_id long, prompt string"


def model(calls):
    """Writes each call to a file of its own, as tasks run in other processes."""
    def fn(llm, prompts, system):
        for p in prompts:
            if p == "refused":
                raise ledger.PermanentError(p)
            if p == "down":
                raise OSError(p)
        for p in prompts:
            with open(tempfile.mkstemp(dir=calls)[1], "w") as f:
                f.write(f"{llm}|{p}")
        return [f"{system}{llm}:{p}" for p in prompts]
    return fn


def answered(calls):
    return sorted(open(os.path.join(calls, f)).read() for f in os.listdir(calls))


def test_a_stopped_run_is_taken_up_without_second_calls(spark):
    calls, path = tempfile.mkdtemp(), tempfile.mkdtemp() + "/ledger"
    rows = spark.createDataFrame(ROWS, SCHEMA)
    first = ledger.answer_with_ledger(rows, model(calls), path, "S ", max_attempts=3, commit_rows=2, max_blocks=2)
    n_first = len(answered(calls))
    assert n_first < 5 and first.where("error_class = 'not_asked'").count() > 0
    got = {(r.llm, r.query_id, r.doc_id): (r.answer, r.attempts, r.error_class)
           for r in ledger.answer_with_ledger(rows, model(calls), path, "S ", max_attempts=3, commit_rows=2).collect()}
    assert got == {("a", 1, 1): ("S a:one", 1, None), ("a", 1, 2): ("S a:two", 1, None), ("b", 1, 1): ("S b:one", 1, None),
                   ("a", 2, 1): (None, 1, "permanent"), ("a", 3, 1): (None, 3, "transient"),
                   (None, 1, 1): ("S None:one", 1, None), ("a", 4, 1): ("S a:", 1, None)}
    assert answered(calls) == ["None|one", "a|", "a|one", "a|two", "b|one"]
    again = ledger.answer_with_ledger(rows, model(calls), path, "S ", max_attempts=3)
    assert again.count() == 7 and len(answered(calls)) == 5
    changed = ledger.answer_with_ledger(rows.where("llm = 'b'"), model(calls), path, "other ", max_attempts=3).collect()
    assert [r.answer for r in changed] == ["other b:one"] and len(answered(calls)) == 6


def test_ledger_of_no_requests_and_waits(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(ledger, "time", SimpleNamespace(sleep=waits.append))
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert ledger.answer_with_ledger(rows.limit(0), model(""), tempfile.mkdtemp() + "/x").count() == 0
    down = rows.where("prompt = 'down'")
    assert ledger.answer_with_ledger(down, model(""), tempfile.mkdtemp() + "/y", max_attempts=4, wait=0.5).first().attempts == 4
    assert waits == [0.5, 1.0, 2.0]


def test_saved_router_says_the_same_and_refuses_others(spark):
    feats = spark.createDataFrame([(1, 1, 0, "red red blue"), (2, 1, 1, "green"), (3, 1, 0, "red")], "query_id long, doc_id long, label int, router_text string")
    fitted = router.fit_naive_bayes(feats, 2, written, smoothing=0.1)
    path = tempfile.mkdtemp()
    assert model_table.save(fitted, path, ["x", "y"]) == 1 and model_table.save(fitted, path, ["y", "x"]) == 2
    loaded = model_table.load(spark, path, ["x", "y"], 1)
    assert (loaded.rows, loaded.totals, loaded.n_tokens, loaded.smoothing) == (fitted.rows, fitted.totals, fitted.n_tokens, 0.1)
    assert sorted(router.naive_bayes_scores(loaded, feats).collect()) == sorted(router.naive_bayes_scores(fitted, feats).collect())
    with pytest.raises(ValueError, match="labels"):
        model_table.load(spark, path, ["x", "y"])
    with pytest.raises(ValueError, match="tokeniser"):
        model_table.load(spark, path, ["x", "y"], 1, tokeniser=r"\w+")
    with pytest.raises(ValueError, match="no finished version 3"):
        model_table.load(spark, path, ["x", "y"], 3)
    os.makedirs(f"{path}/versions/v000003")  # a save that was cut short
    assert model_table.versions(spark, path) == [1, 2]
    with pytest.raises(ValueError, match="labels for a model"):
        model_table.save(fitted, path, ["x"])
    loaded.tokens.limit(1).write.mode("append").parquet(os.path.dirname(loaded.tokens.inputFiles()[0]))
    with pytest.raises(ValueError, match="not the one"):
        model_table.load(spark, path, ["x", "y"], 1)


def by_hand(examples, cell, k, gone=None):
    """The vote of single examples (cell, label), nearest first, whole cells at a time."""
    def vec(c):
        s = [c // 289, c // 17 % 17, c % 17]
        return np.array(s + [16 - x for x in s], float)

    left = list(examples)
    if gone is not None:
        left.remove((cell, gone))
    cells = sorted({c for c, _ in examples}, key=lambda c: (-round(vec(c) @ vec(cell) / np.sqrt((vec(c) @ vec(c)) * (vec(cell) @ vec(cell))), 10), c))
    n = weight = yes = 0.0
    for c in cells:
        if n >= k:
            break
        cos = vec(c) @ vec(cell) / np.sqrt((vec(c) @ vec(c)) * (vec(cell) @ vec(cell)))
        own = [x for y, x in left if y == c]
        n, weight, yes = n + len(own), weight + cos * len(own), yes + cos * sum(own)
    return yes / weight if weight else None


def test_votes_and_threshold_equal_single_examples(spark):
    rng = np.random.default_rng(1)
    words = "red green blue old new big small".split()
    rows = []
    for _ in range(60):
        q, t = " ".join(rng.choice(words, 4)), " ".join(rng.choice(words, 5))
        rows.append((q, t, int(len(set(q.split()) & set(t.split())) >= 2)))
    df = spark.createDataFrame(rows + [("red", "red", None)], "q string, t string, label int")
    fitted = example_judge.fit(df, written, "q", "t", k=5)
    cells = example_judge.with_cell(df.where("label is not null"), "q", "t").collect()
    examples = [(r.cell, r.label) for r in cells]
    right = {}
    for t in example_judge.THRESHOLDS:
        right[t] = sum(int((by_hand(examples, c, 5, y) or 0) >= t - 1e-9) == y for c, y in examples)
    assert {r.threshold: (r.n_examples, r.n_right) for r in fitted.fit.collect()} == {t: (60, n) for t, n in right.items()}
    assert fitted.threshold == min(right, key=lambda t: (-right[t], t))
    corpus = spark.createDataFrame([(1, "red green old"), (2, ""), (3, "zz")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red green"), (2, None), (3, "old zz blue")], "query_id long, text string")
    pairs = spark.createDataFrame([(q, d, "x") for q in (1, 2, 3) for d in (1, 2, 3)] + [(1, 1, "y")], "query_id long, doc_id long, prediction_by string")
    got = example_judge.judge_pairs(pairs, corpus, queries, fitted, written).collect()
    texts = {(q.query_id, d.doc_id): (q.text, d.text) for q in queries.collect() for d in corpus.collect()}
    own = {(r.query_id, r.doc_id): r.cell for r in example_judge.with_cell(
        spark.createDataFrame([(*k, *v) for k, v in texts.items()], "query_id long, doc_id long, qtext string, dtext string")).collect()}
    assert len(got) == 10
    for r in got:
        assert r.example_score == pytest.approx(by_hand(examples, own[r.query_id, r.doc_id], 5), abs=1e-8)
        assert r.prediction == int(r.example_score >= fitted.threshold)
    turned = example_judge.fit(df.withColumn("label", 1 - F.col("label")), written, "q", "t", k=5)
    other = example_judge.judge_pairs(pairs, corpus, queries, turned, written).collect()
    assert sorted((r.query_id, r.doc_id, r.prediction) for r in got) != sorted((r.query_id, r.doc_id, r.prediction) for r in other)


def test_cells_and_no_examples(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b c", "c b"), ("", "a"), (None, None), ("a", "b a")], "qtext string, dtext string")
    base = 17 * 17
    assert [r.cell for r in example_judge.with_cell(df).collect()] == [16 * base + 16 * 17 + 16, 11 * base + 11 * 17, 0, 0, 16 * base + 16 * 17 + 16]
    none = example_judge.fit(spark.createDataFrame([], "q string, t string, label int"), written, "q", "t")
    pairs = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    got = example_judge.judge_pairs(pairs, spark.createDataFrame([(1, "a")], "doc_id long, text string"),
                                    spark.createDataFrame([(1, "a")], "query_id long, text string"), none, written).first()
    assert got.example_score is None and got.prediction == 0
