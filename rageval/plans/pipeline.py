"""The whole pipeline -- retrieval and evaluation, answering and model choice,
router training, and both routings -- with every stage written to a folder.

Stages hand over through tables, as the original stages hand over through
files; each output is a folder that a later run (or another job)
can read instead of recomputing. A finished folder has a mark of what it was made from: the tables' files with their sizes
and times, and the settings. A run with ``mode="resume"`` leaves alone the folders that are finished and made from the same,
and computes none of them; one that was cut short, or made from other tables, is written anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from ..operators import consensus as consensus_ops
from ..operators import generate, metrics
from ..sources import tsv
from .fixtures import Fixtures, fixtures, listing

MARK = "_MADE_FROM_"


def made_from(fx: Fixtures) -> str:
    """Of the tables' files and the settings."""
    return hashlib.md5(repr((listing(fx.spark, fx.sf_dir), fx.k, fx.pool_depth)).encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def mark(spark: SparkSession, folder: str, value: str) -> None:
    """An empty file, written last, so that a folder with a mark is whole; Spark's readers pass over it."""
    fs, path = _file(spark, f"{folder}/{MARK}{value}")
    fs.create(path, True).close()


def finished(spark: SparkSession, folder: str, value: str) -> bool:
    """Whether the folder was written to its end, from the same."""
    return all(fs.exists(path) for fs, path in (_file(spark, f"{folder}/{name}") for name in ("_SUCCESS", MARK + value)))


def run_pipeline(spark: SparkSession, sf_dir: str, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    """The folders by stage. ``mode``: a mode of Spark's writers, or ``resume``."""
    fx, out_dir = fixtures(spark, sf_dir), out_dir.rstrip("/")
    value = made_from(fx)
    stages = {
        # The text file at the edge
        "consensus_results.tsv": lambda: consensus_ops.consensus_as_text(fx.consensus(), fx.corpus, fx.queries),
        "runs": lambda: fx.all_runs,                                        # P1: retrieval + consensus
        "judged": lambda: fx.judged,
        "leaderboard": lambda: metrics.macro_metrics(fx.all_runs, fx.qrels),
        "micro_metrics": lambda: metrics.micro_metrics(fx.all_runs, fx.qrels, fx.retriever_dim(), fx.k),
        "best_retriever_docs": lambda: fx.best_pairs,
        "answers": lambda: fx.judged_answers,                               # P2: answers + best model
        "best_llm": lambda: generate.best_llm(generate.llm_scores(fx.judged_answers)),
        "router_training_rows": lambda: fx.training_rows,                   # P3
        "router_eval": lambda: fx.router[1],
        "baseline_routing": lambda: fx.baseline_answers,                    # P4
        "dynamic_routing": lambda: fx.dynamic_answers,                      # P5
        "routing_eval": lambda: fx.routing_eval(),                          # P6
    }
    paths = {}
    for name, make in stages.items():
        paths[name] = path = f"{out_dir}/{name}"
        if mode == "resume" and finished(spark, path, value):
            continue
        how = "overwrite" if mode == "resume" else mode
        if name.endswith(".tsv"):
            tsv.write_tsv(make(), path, how)
        else:
            make().write.mode(how).parquet(path)
        if how != "ignore":  # that leaves what is there, whatever it was made from
            mark(spark, path, value)
    return paths
