"""Resumable answering (U2, U9, S9): an append-only ledger of what was asked of which model.

A request is a model, a pair and its prompt under a system prompt; the hash of both prompts tells a changed request from
a stored one. Each attempt appends a row (llm, query_id, doc_id, prompt_hash, attempt, answer, error_class, error) to
Parquet files. A request is settled once it has an answer, a permanent error or ``max_attempts`` transient ones. A run
writes the unsettled requests once, dealt into blocks of about ``commit_rows``, and appends block by block: a killed run
loses at most the block it was in, and the next one asks only what is not settled. Rounds over transient errors wait
``wait`` seconds, doubled each time, between them.

A null prompt is asked as an empty one; a null model is a model of its own; requests given twice are asked once. A task that
Spark runs again asks again, but only the committed attempt is stored.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SYSTEM_PROMPT
from ..session import scratch_path, ship_package
from .generate import MAX_ATTEMPTS

KEY = ("llm", "query_id", "doc_id", "prompt_hash")
SCHEMA = ("llm string, query_id long, doc_id long, prompt_hash string, attempt int, answer string, "
          "error_class string, error string")
COMMIT_ROWS = 100_000


class PermanentError(Exception):
    """Raised by a model for a request that no further attempt can answer, such as refused content."""


def error_class(e: Exception) -> str:
    return "permanent" if isinstance(e, PermanentError) else "transient"


def requests(rows: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """(llm, query_id, doc_id, prompt, prompt_hash), each request once."""
    prompt = F.coalesce("prompt", F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{len(system)}:{system}"), prompt), 256)
    return (rows.select("llm", "query_id", "doc_id", prompt.alias("prompt"), hashed.alias("prompt_hash"))
            .dropDuplicates(list(KEY)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The attempts stored so far; none where nothing was written yet."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def state(ledger: DataFrame) -> DataFrame:
    """Per request: ``attempts``, the stored ``answer`` and the ``error_class`` of the last attempt (null with an answer)."""
    done = F.max(F.col("error_class").isNull())
    return (ledger.groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("int").alias("attempts"), done.alias("answered"),
        F.min_by(F.struct("answer"), F.when(F.col("error_class").isNull(), F.col("attempt")))["answer"].alias("answer"),
        F.when(~done, F.max_by("error_class", "attempt")).alias("error_class")))


def same_request(a: DataFrame, b: DataFrame):
    condition = None
    for c in KEY:
        own = a[c].eqNullSafe(b[c])
        condition = own if condition is None else condition & own
    return condition


def unsettled(asked: DataFrame, ledger: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The requests to ask now, with ``attempts`` made before."""
    past = state(ledger)
    open_ = ~F.coalesce(past["answered"], F.lit(False)) & (F.coalesce(past["error_class"], F.lit("")) != "permanent") \
        & (F.coalesce(past["attempts"], F.lit(0)) < max_attempts)
    return (asked.join(past, same_request(asked, past), "left").where(open_)
            .select(*[asked[c] for c in asked.columns], F.coalesce(past["attempts"], F.lit(0)).alias("attempts")))


def ask(rows: DataFrame, answer_fn: Callable, system: str = SYSTEM_PROMPT) -> DataFrame:
    """One attempt at each request, as ledger rows. A batch that fails is asked row by row, so that one bad request
    marks only itself."""
    ship_package(rows.sparkSession)

    def attempt(llm, prompts):
        got = list(answer_fn(llm, prompts, system))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return [None if pd.isna(x) else str(x) for x in got]

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            answers, classes, errors = (np.full(len(pdf), None, object) for _ in range(3))
            code, models = pd.factorize(pdf["llm"], use_na_sentinel=False)
            for k, llm in enumerate(models):
                places, llm = np.flatnonzero(code == k), None if pd.isna(llm) else llm
                try:
                    answers[places] = attempt(llm, pdf["prompt"].iloc[places].reset_index(drop=True))
                    continue
                except Exception as e:  # noqa: BLE001 - the class is stored, then each row is asked by itself
                    if len(places) == 1:
                        classes[places[0]], errors[places[0]] = error_class(e), f"{type(e).__name__}: {e}"
                        continue
                for i in places:
                    try:
                        answers[i] = attempt(llm, pdf["prompt"].iloc[[i]].reset_index(drop=True))[0]
                    except Exception as e:  # noqa: BLE001
                        classes[i], errors[i] = error_class(e), f"{type(e).__name__}: {e}"
            if len(pdf):
                yield pdf[list(KEY)].assign(attempt=(pdf["attempts"] + 1).astype("int32"), answer=answers,
                                            error_class=classes, error=errors)
    return rows.select(*KEY, "prompt", "attempts").mapInPandas(run, SCHEMA)


def answer_with_ledger(rows: DataFrame, answer_fn: Callable, path: str, system: str = SYSTEM_PROMPT,
                       max_attempts: int = MAX_ATTEMPTS, commit_rows: int = COMMIT_ROWS, wait: float = 0.0,
                       max_blocks: int | None = None) -> DataFrame:
    """Ask what the ledger at ``path`` has not settled; return its state for the given ``rows``.

    ``rows`` has (llm, query_id, doc_id, prompt); ``answer_fn(llm, prompts, system)`` answers a batch in its order.
    ``max_blocks`` ends the run after so many blocks, as an allowance of calls; the rest stays unsettled. One writer at a time.
    """
    spark = rows.sparkSession
    asked = requests(rows, system)
    blocks_left = math.inf if max_blocks is None else max_blocks
    for again in range(max_attempts):
        open_ = unsettled(asked, read_ledger(spark, path), max_attempts)
        todo = scratch_path(spark, "requests")
        n = open_.count()
        if not n or blocks_left <= 0:
            break
        if again and wait:
            time.sleep(wait * 2 ** (again - 1))
        n_blocks = -(-n // commit_rows)
        (open_.withColumn("block", F.pmod(F.xxhash64(*KEY), F.lit(n_blocks)).cast("int"))
         .repartition("block", F.pmod(F.xxhash64("prompt_hash"), F.lit(spark.sparkContext.defaultParallelism)))
         .write.partitionBy("block").parquet(todo))
        written = spark.read.schema(f"{open_._jdf.schema().toDDL()}, block int").parquet(todo)
        for block in range(n_blocks):
            if blocks_left <= 0:
                break
            ask(written.where(F.col("block") == block), answer_fn, system).write.mode("append").parquet(path)
            blocks_left -= 1
    past = state(read_ledger(spark, path))
    return (asked.join(past, same_request(asked, past), "left")
            .select(*[asked[c] for c in KEY], past["answer"], F.coalesce(past["attempts"], F.lit(0)).alias("attempts"),
                    F.when(past["attempts"].isNull(), F.lit("not_asked")).otherwise(past["error_class"]).alias("error_class")))
