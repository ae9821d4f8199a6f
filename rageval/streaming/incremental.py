"""Judge newly arriving run files exactly once (S9 as a stream).

The batch pipeline skips a stage whose output already exists. As a stream,
the runs folder is a file source: every new ``{retriever}_results.tsv`` part
file is read once, its pairs are judged, and the judged rows are appended to
a parquet table. Progress lives in the streaming checkpoint (in the shared
checkpoint folder), so a restarted or failed job resumes without judging a
file twice; ``foreachBatch`` writes each micro-batch under its batch id, so a
retried batch overwrites rather than duplicates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consensus import judge_pairs
from ..session import checkpoint_root
from ..sources.tsv import read_tsv

RUN_SCHEMA = "query_id long, doc_id long, rank int"
# Files of a micro-batch, read each by its own header.
FILES_PER_BATCH = 256


def stream_run_files(spark: SparkSession, runs_dir: str, suffix: str = "_results.tsv") -> DataFrame:
    """Streaming DataFrame of (retriever, path), a row per line of each newly arrived file."""
    pattern = "([^/]+)" + suffix.replace(".", "\\.") + "/[^/]*$"
    path = F.col("_metadata.file_path")
    return (spark.readStream.option("maxFilesPerTrigger", FILES_PER_BATCH).text(f"{runs_dir.rstrip('/')}/*{suffix}")
            .select(F.regexp_extract(path, pattern, 1).alias("retriever"), path.alias("path")))


def read_runs(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """(retriever, query_id, doc_id, rank) of the files, columns taken by name whatever their order; None without files."""
    out = None
    for r in files.distinct().collect():  # at most FILES_PER_BATCH rows
        own = read_tsv(spark, r["path"], RUN_SCHEMA).withColumn("retriever", F.lit(r["retriever"]))
        out = own if out is None else out.unionByName(own)
    return out


def judge_new_runs(spark: SparkSession, runs_dir: str, out_path: str, corpus: DataFrame,
                   queries: DataFrame, checkpoint: str | None = None, available_now: bool = True):
    """Start (and, with ``available_now``, finish) the incremental judging query."""
    ckpt = checkpoint or f"{checkpoint_root(spark)}/stream-judge-{hashlib.md5(f'{runs_dir}|{out_path}'.encode()).hexdigest()[:16]}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        runs = read_runs(spark, batch)
        if runs is None:
            return
        judged = judge_pairs(runs, corpus, queries)
        (judged.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))

    writer = (stream_run_files(spark, runs_dir).writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query
