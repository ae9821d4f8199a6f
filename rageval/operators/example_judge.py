"""A judge that learns from labelled examples (U3, S10): nearest examples by cosine, weighted vote, fitted threshold.

What counts is how a text relates to its query, so a pair is described by three shares: of the query's distinct tokens that
the text has, of these tokens' characters, and of the query's adjacent token pairs that the text has in a row. Each share
is taken in sixteenths, with its complement, so that the cosine tells large from small. There are 17 ** 3 = 4913 such cells
at most, whatever the data: all examples are counted into their cells, the vote is worked out once per cell and pairs look
theirs up. A vote takes the nearest cells until they hold ``k`` examples (equal cosine: smaller cell first), each example
weighing its cosine. The threshold is the one of 0.05 to 0.95 that gets most examples right when each is judged by
the others, the smallest of equals.

A query without tokens has no shares (cell 0); null texts are empty; examples without a label are left out; without
examples no pair has a score and none is relevant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import std_tokens
from .common import maybe_broadcast

LEVELS = 16
NEIGHBOURS = 15
THRESHOLDS = tuple(i / 20 for i in range(1, 20))


def adjacent(tokens: Column) -> Column:
    """Adjacent token pairs, each once, in order."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.array_distinct(F.transform(F.slice(tokens, 1, n), lambda t, i: F.concat_ws(" ", t, F.get(tokens, i + 1))))


def in_sixteenths(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part.cast("double") / whole * LEVELS + 0.5)).otherwise(0).cast("int")


def with_cell(df: DataFrame, query: str = "qtext", text: str = "dtext") -> DataFrame:
    """Add ``cell``: the three shares as one number."""
    def chars(ts):
        return F.aggregate(ts, F.lit(0), lambda n, t: n + F.length(t))

    names = ("_ej_query", "_ej_text", "_ej_hit")
    df = df.withColumns({"_ej_query": std_tokens(F.coalesce(query, F.lit(""))), "_ej_text": std_tokens(F.coalesce(text, F.lit("")))})
    q, t = F.col("_ej_query"), F.col("_ej_text")
    df = df.withColumn("_ej_hit", F.array_intersect(F.array_distinct(q), t))
    own, hit, two = F.array_distinct(q), F.col("_ej_hit"), adjacent(q)
    a = in_sixteenths(F.size(hit), F.size(own))
    b = in_sixteenths(chars(hit), chars(own))
    c = F.when(F.size(two) > 0, in_sixteenths(F.size(F.array_intersect(two, adjacent(t))), F.size(two))).otherwise(a)
    return df.withColumn("cell", (a * (LEVELS + 1) + b) * (LEVELS + 1) + c).drop(*names)


def shares(cell: Column) -> list[Column]:
    base = LEVELS + 1
    return [F.floor(cell / (base * base)), F.floor(cell / base) % base, cell % base]


def cosine(x: Column, y: Column) -> Column:
    """Of two cells, from whole numbers, at 10 decimals."""
    def dot(u, v):
        out = F.lit(0).cast("long")
        for s, t in zip(shares(u), shares(v)):
            out = out + s * t + (LEVELS - s) * (LEVELS - t)
        return out
    return F.round(dot(x, y) / F.sqrt((dot(x, x) * dot(y, y)).cast("double")), 10)


@dataclass(frozen=True)
class ExampleJudge:
    """``cells``: (cell, n, positives) of the examples; ``fit``: (threshold, n_examples, n_right); ``threshold`` is the chosen one."""
    cells: DataFrame
    fit: DataFrame
    threshold: float
    k: int


def votes(askers: DataFrame, cells: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Add ``score`` to (cell, without): the vote of the nearest cells. ``without`` is the label of one example of the asker's own
    cell that takes no part, or null. ``cells`` travels whole, as it has 4913 rows at most."""
    every = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "n", "positives")))).scalar()
    gone = F.col("without").isNotNull()

    def seen(x):
        own = (gone & (x["cell"] == F.col("cell"))).cast("long")
        return F.struct((-cosine(F.col("cell"), x["cell"])).alias("far"), x["cell"].alias("cell"), (x["n"] - own).alias("n"),
                        (x["positives"] - own * F.coalesce("without", F.lit(0))).alias("positives"))

    def add(acc, x):
        take = acc["n"] < k
        return F.struct(F.when(take, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"),
                        F.when(take, acc["weight"] - x["far"] * x["n"]).otherwise(acc["weight"]).alias("weight"),
                        F.when(take, acc["yes"] - x["far"] * x["positives"]).otherwise(acc["yes"]).alias("yes"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("yes"))
    total = F.aggregate(F.sort_array(F.transform(F.col("_ej_every"), seen)), start, add)
    return (askers.withColumn("_ej_every", every).withColumn("_ej_total", total)
            .withColumn("score", F.when(F.col("_ej_total.weight") > 0, F.round(F.col("_ej_total.yes") / F.col("_ej_total.weight"), 9)))
            .drop("_ej_every", "_ej_total"))


def fit(examples: DataFrame, written, query: str = "Query", text: str = "Answer", label: str = "label", k: int = NEIGHBOURS) -> ExampleJudge:
    """From (query, text, label 0/1) rows. ``written`` cuts a table's lineage."""
    if k < 1:
        raise ValueError("k must be >= 1")
    own = with_cell(examples.where(F.col(label).isNotNull()).select(F.col(query).alias("qtext"), F.col(text).alias("dtext"), F.col(label).alias("label")))
    cells = written(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives")))
    askers = cells.select("cell", F.inline(F.array(F.struct(F.lit(1).alias("without"), F.col("positives").alias("times")),
                                                   F.struct(F.lit(0).alias("without"), (F.col("n") - F.col("positives")).alias("times"))))).where("times > 0")
    judged = votes(askers, cells, k)
    tried = judged.select("without", "times", "score", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    right = (F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int") == F.col("without")).cast("long")
    table = written(tried.groupBy("threshold").agg(F.sum("times").alias("n_examples"), F.sum(right * F.col("times")).alias("n_right")))
    best = table.orderBy(F.col("n_right").desc(), "threshold").first()
    return ExampleJudge(cells, table, best["threshold"] if best else THRESHOLDS[len(THRESHOLDS) // 2], k)


def judge_pairs(pairs: DataFrame, corpus: DataFrame, queries: DataFrame, model: ExampleJudge, written, small: bool | None = None) -> DataFrame:
    """Add ``example_score`` and ``prediction`` (0/1) to (…, query_id, doc_id) rows; each distinct pair is described once."""
    texts = (maybe_broadcast(small, pairs.select("query_id", "doc_id").distinct())
             .join(corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
             .join(maybe_broadcast(small, queries.select("query_id", F.col("text").alias("qtext"))), "query_id"))
    described = written(with_cell(texts).select("query_id", "doc_id", "cell"))
    verdicts = votes(described.select("cell", F.lit(None).cast("int").alias("without")).distinct(), model.cells, model.k)
    # One row a cell: 4913 at most.
    judged = described.join(F.broadcast(verdicts.select("cell", F.col("score").alias("example_score"))), "cell")
    return pairs.join(judged.select("query_id", "doc_id", "example_score",
                                    F.coalesce(F.col("example_score") >= F.lit(model.threshold), F.lit(False)).cast("int").alias("prediction")),
                      ["query_id", "doc_id"], "left")
