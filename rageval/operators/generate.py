"""Answer generation (U2, X11, X18, X19), answer judging (U3), per-model scores (A13, A14), U9.

A model is a name in the model dimension ``llm_dim(llm, llm_idx)``. The
built-in providers are extractive and written as SQL expressions, so the
whole pipeline runs in the JVM; real models plug in as
``answer_fn(llm: str, prompts: pandas.Series) -> pandas.Series`` and run in
``mapInPandas`` over Arrow batches, with a bounded number of attempts per
batch and per-row failure isolation (an ``error`` column instead of a
failed job).
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_FAILED_ANSWER, prompt, std_tokens
from ..session import ship_package
from .common import top_k
from .consensus import coverage

# The stand-in providers, in model order, and generation settings.
PROVIDERS = ("coverage", "density", "length")
MAX_ATTEMPTS = 5
ANSWER_THRESHOLD = 0.5


def line_score(llm: str, query: Column, line: Column) -> Column:
    """How well a line answers the query. ``coverage``: its distinct query tokens; ``density``: these as a share of its
    distinct tokens and one more; ``length``: their characters, as long words say more."""
    own = F.array_distinct(std_tokens(line))
    hit = F.array_intersect(F.array_distinct(std_tokens(query)), own)
    if llm == "coverage":
        return F.size(hit).cast("double")
    if llm == "density":
        return F.size(hit).cast("double") / (F.size(own) + 1)
    if llm == "length":
        return F.aggregate(hit, F.lit(0), lambda n, t: n + F.length(t)).cast("double")
    raise ValueError(f"unknown provider {llm}")


def provider_answer(llm: str, query: Column, doc: Column) -> Column:
    """Extractive stand-in answers: the document's line with the highest score, the first of equals."""
    lines = F.transform(F.split(doc, "\n"), lambda x, i: F.struct(line_score(llm, query, x).alias("score"), (-i).alias("at"), x.alias("line")))
    return F.array_max(lines)["line"]


def llm_dim(spark, names=PROVIDERS) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "llm string, llm_idx int")


def with_models(pairs: DataFrame, names=PROVIDERS) -> DataFrame:
    """One row per (pair, model): a generator over the fixed model list, not a join."""
    models = F.array(*[F.struct(F.lit(n).alias("llm"), F.lit(i).alias("llm_idx"))
                       for i, n in enumerate(names)])
    return pairs.select("*", F.inline(models))


def generate_answers(pairs: DataFrame, corpus: DataFrame, queries: DataFrame,
                     names=PROVIDERS) -> DataFrame:
    """U2 with the built-in providers: (llm, llm_idx, query_id, doc_id, answer)."""
    texts = (pairs.select("query_id", "doc_id").distinct()
             .join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
             .join(queries.select("query_id", F.col("text").alias("qtext")), "query_id"))
    rows = with_models(texts, names)
    return rows.select("llm", "llm_idx", "query_id", "doc_id", F.trim(chosen_answer(names)).alias("answer"))


def chosen_answer(names=PROVIDERS) -> Column:
    """The answer of the provider that ``llm`` names, to ``qtext`` from ``dtext``."""
    answer = F.lit(None).cast("string")
    for n in names:
        answer = F.when(F.col("llm") == n, provider_answer(n, F.col("qtext"), F.col("dtext"))).otherwise(answer)
    return answer


def answer_with_fn(rows: DataFrame, answer_fn: Callable, max_attempts: int = MAX_ATTEMPTS,
                   retry_wait: float = 0.0) -> DataFrame:
    """U2/U9 with an external model.

    ``rows`` has (llm, query_id, doc_id, prompt). Each Arrow batch is answered
    per model with up to ``max_attempts`` tries; if a batch keeps failing, its
    rows are answered one by one, with as many tries each, so a single bad row
    only marks itself: ``answer`` null and ``error`` set. Answers belong to
    prompts by position; a wrong number of them counts as a failure. Nothing
    is dropped, rows without a model included.
    """
    ship_package(rows.sparkSession)

    def attempt(llm, batch):
        error = None
        for _ in range(max_attempts):
            try:
                got = list(answer_fn(llm, batch))
                if len(got) != len(batch):
                    raise ValueError(f"{len(got)} answers to {len(batch)} prompts")
                return got, None
            except Exception as e:  # noqa: BLE001 - isolate, then retry per row
                error = f"{type(e).__name__}: {e}"
                if retry_wait:
                    time.sleep(retry_wait)
        return None, error

    def run(batches):
        for pdf in batches:
            answers, errors = np.empty(len(pdf), object), np.empty(len(pdf), object)
            prompts_ = pdf["prompt"].reset_index(drop=True)
            code, models = pd.factorize(pdf["llm"], use_na_sentinel=False)
            for k, llm in enumerate(models):
                places, llm = np.flatnonzero(code == k), None if pd.isna(llm) else llm
                got, _ = attempt(llm, prompts_.iloc[places].reset_index(drop=True))
                if got is not None:
                    for i, x in zip(places, got):
                        answers[i] = None if pd.isna(x) else str(x)
                    continue
                for i in places:
                    one, errors[i] = attempt(llm, prompts_.iloc[[i]].reset_index(drop=True))
                    answers[i] = None if one is None or pd.isna(one[0]) else str(one[0])
            if len(pdf):
                yield pdf[["llm", "query_id", "doc_id"]].assign(answer=answers, error=errors)
    return rows.select("llm", "query_id", "doc_id", "prompt").mapInPandas(
        run, "llm string, query_id long, doc_id long, answer string, error string")


def prompts(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """X11: (query_id, doc_id, prompt) for each distinct pair."""
    return (pairs.select("query_id", "doc_id").distinct()
            .join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
            .join(queries.select("query_id", F.col("text").alias("qtext")), "query_id")
            .select("query_id", "doc_id", prompt("qtext", "dtext").alias("prompt")))


def default_answer(answer: Column) -> Column:
    """The fixed text a failed generation is reported with."""
    return F.coalesce(answer, F.lit(DEFAULT_FAILED_ANSWER))


def judge_answers(answers: DataFrame, queries: DataFrame, threshold: float = ANSWER_THRESHOLD) -> DataFrame:
    """U3 for answers: ``grade``, the share of the query's terms that the answer has, and ``prediction``, 1 when it
    reaches ``threshold``. A null answer gets nulls (skipped by the mean)."""
    q = queries.select("query_id", F.col("text").alias("qtext"))
    grade = F.when(F.col("answer").isNotNull(), coverage(F.col("qtext"), F.col("answer")))
    return answers.join(q, "query_id").select(
        *answers.columns, grade.alias("grade"), (grade >= F.lit(threshold)).cast("int").alias("prediction"))


def llm_scores(judged_answers: DataFrame) -> DataFrame:
    """Mean answer-relevance prediction per model (nulls skipped)."""
    return (judged_answers.groupBy("llm", "llm_idx")
            .agg(F.count(F.lit(1)).alias("n_answers"),
                 F.count("prediction").alias("n_scored"),
                 F.round(F.avg("prediction"), 6).alias("score")))


def best_llm(scores: DataFrame) -> DataFrame:
    """The model with the highest mean; ties to the earlier model; all-null never wins."""
    return (scores.where(F.col("score").isNotNull())
            .orderBy(F.col("score").desc(), F.col("llm_idx").asc()).limit(1)
            .select("llm", "score"))


def best_per_pair(judged_answers: DataFrame) -> DataFrame:
    """Per (query, document), the model with the best grade (then model order); the 0/1 prediction would tie
    nearly always."""
    ranked = top_k(judged_answers.where(F.col("grade").isNotNull()),
                   ["query_id", "doc_id"], [F.col("grade").desc(), F.col("llm_idx").asc()], 1)
    return ranked.select("query_id", "doc_id", F.col("llm").alias("best_llm"),
                         F.col("llm_idx").alias("label"))
