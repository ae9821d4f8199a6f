"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are hashed into blocks of their source, a source having blocks in proportion to its size. A source's blocks
are permuted, again for each repetition, and drawn in that order until its target is reached; so each source has an
exact quota of draws. The tree halves the output shards again and again: at each node the left half's share of every
source's quota is drawn from the multivariate hypergeometric distribution, the right half keeps the rest. A shard
then takes its quotas as the next draws of each source, which are disjoint, and orders its rows by a hash.

The last draw of a source is partial: documents of that block are taken in the order of their hashes, the one at the
end only up to the words that are left, so that a source's taken words miss its target by less than one, unless equal
rows meet there. The mixed rows are whole documents: the one at the end is in if at least half of it would be taken.

Defined cases: a null text has no words and is part of its block; a null source is a source, the last one; a source
without words gives nothing; an empty table gives an empty mix. Equal rows share a block and are taken alike.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fits, free_name, staged, text_of

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
#: Blocks of the whole corpus, about; the plan holds a row for each.
BLOCKS = 16384
N_SHARDS = 16
SEED = 20260101
#: Sources whose table is broadcast at most; more are joined.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT) -> list[float]:
    """Shares of ``share * sum(sizes)`` by the repeating weights, stopped at ``most`` times the size; what that frees is
    shared anew by weight until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        above = [i for i in open_ if unit * weight[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def split_tree(quotas: np.ndarray, n_shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows): exact in both directions, even across shards."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def halve(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        n = int(own.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, n, method="marginals") if len(own) else own
        halve(lo, mid, left)
        halve(mid, hi, own - left)

    halve(0, n_shards, quotas)
    return out


def measured(docs: DataFrame, seed: int = SEED) -> dict:
    """Columns of a row: its words and its hash."""
    text = text_of(docs)
    return {"size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "hash": F.xxhash64(F.lit(seed), docs["doc_id"], F.crc32(text.cast("binary")))}


@dataclass(frozen=True)
class Mix:
    """``sources``: source, index, size, blocks, target. ``draws``: index, block and the list of its draws, each with its
    shard, its repetition and, if partial, the hash where it ends and the words it takes there."""
    sources: DataFrame
    draws: DataFrame
    n_sources: int
    n_shards: int


def plan(rows: DataFrame, n_shards: int = N_SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> Mix:
    """``rows``: ``source, size, hash`` of all documents, read a few times."""
    spark = rows.sparkSession
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    goal, words = targets(sizes), max(1, -(-sum(sizes) // blocks))
    n_blocks = [max(1, -(-n // words)) for n in sizes]
    sources = spark.createDataFrame([(s, i, n, b, t) for i, ((s, n), b, t) in enumerate(zip(found, n_blocks, goal))],
                                    "source string, si int, source_size long, n_blocks int, target double")
    mix = Mix(sources, sources, len(found), n_shards)
    held = with_block(rows, mix).groupBy("si", "block").agg(F.sum("size").alias("size")).toPandas()  # about ``blocks`` rows
    by_source: dict[int, np.ndarray] = {i: np.zeros(b, np.int64) for i, b in enumerate(n_blocks)}
    for i, own in held.groupby("si"):
        by_source[int(i)][own["block"].to_numpy(int)] = own["size"].to_numpy(np.int64)

    order: dict[int, list[tuple[int, int, int]]] = {}  # of each source: block, repetition, words if partial or -1
    for i, own in by_source.items():
        due, order[i] = round(goal[i]), []
        for repeat in range(MAX_REPEAT):
            for block in np.random.default_rng([seed, i, repeat]).permutation(len(own)).tolist():
                if due <= 0:
                    break
                order[i].append((block, repeat, -1 if own[block] <= due else int(due)))
                due -= int(own[block])
    quotas = np.array([len(order[i]) for i in range(len(found))], np.int64)
    shard_draws = split_tree(quotas, n_shards, seed)
    cuts = _cuts(rows, mix, {i: (o[-1][0], o[-1][2]) for i, o in order.items() if o and o[-1][2] >= 0})
    taken: dict[tuple[int, int], list] = defaultdict(list)
    for i, own in order.items():
        shards = np.repeat(np.arange(n_shards), shard_draws[:, i]).tolist()
        for (block, repeat, part), shard in zip(own, shards):
            taken[i, block].append((shard, repeat, *(cuts[i] if part >= 0 else (None, None))))
    draws = spark.createDataFrame([(*k, v) for k, v in taken.items()],
                                  "si int, block int, draws array<struct<shard:int,repeat:int,end_hash:long,end_words:long>>")
    return Mix(sources, draws, len(found), n_shards)


def with_block(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds the source's columns and the block; ``rows`` have ``source`` and ``hash``."""
    sources = mix.sources.withColumnRenamed("source", "of_source")
    sources = F.broadcast(sources) if mix.n_sources <= BROADCAST_SOURCES else sources
    return (rows.join(sources, rows["source"].eqNullSafe(sources["of_source"])).drop("of_source")
            .withColumn("block", F.pmod(F.xxhash64("hash"), F.col("n_blocks")).cast("int")))


def _cuts(rows: DataFrame, mix: Mix, partial: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Where each source's partial draw ends: the hash of the last document taken and the words taken of it."""
    from pyspark.sql import Window

    if not partial:
        return {}
    spark = rows.sparkSession
    due = spark.createDataFrame([(i, b, w) for i, (b, w) in partial.items()], "si int, block int, due long")
    due = F.broadcast(due) if len(partial) <= BROADCAST_SOURCES else due
    own = with_block(rows, mix).join(due, ["si", "block"]).groupBy("si", "due", "hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    so_far = F.sum("size").over(Window.partitionBy("si").orderBy("hash"))  # a block's documents, by far not a source's
    last = own.withColumn("upto", so_far).where("upto >= due").groupBy("si").agg(
        F.min(F.struct("hash", F.floor((F.col("due") - F.col("upto") + F.col("size")) / F.col("n")).alias("words"))).alias("end"))
    return {r["si"]: (r["end"]["hash"], r["end"]["words"]) for r in last.collect()}


def _draws(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``draws``, null where a block isn't drawn. The plan has a row for each block: about ``BLOCKS`` of them, and one
    for each further source; it is broadcast within a bound."""
    return with_block(rows, mix).join(fits(mix.draws), ["si", "block"], "left")


def _words(draw, size, hash_):
    return (F.when(draw["end_hash"].isNull() | (hash_ < draw["end_hash"]), size)
            .when(hash_ == draw["end_hash"], F.least(size, draw["end_words"])).otherwise(F.lit(0)).cast("long"))


def taken_words(rows: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row."""
    got = _draws(rows, mix)
    parts = F.transform(F.coalesce("draws", F.array().cast(mix.draws.schema["draws"].dataType)), lambda d: _words(d, F.col("size"), F.col("hash")))
    return got.select("doc_id", "size", "source_size", "target", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


def measure(docs: DataFrame) -> DataFrame:
    """The narrow rows that planning reads, written once."""
    return staged(docs.select("doc_id", docs["source"].cast("string").alias("source"), *[c.alias(k) for k, c in measured(docs).items()]), "mix-rows")


def mix_documents(docs: DataFrame, n_shards: int = N_SHARDS, blocks: int = BLOCKS, seed: int = SEED, keep_plan: bool = False) -> DataFrame:
    """The mixed rows: each draw of a document is a row with all its columns as they are, in the order of its shard.
    ``keep_plan`` adds ``mix_shard``, ``mix_repeat`` and ``mix_words``."""
    chosen = plan(measure(docs), n_shards, blocks, seed)
    doc = free_name(docs, "doc")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(doc), docs["source"].cast("string").alias("source"),
                       *[c.alias(k) for k, c in measured(docs, seed).items()])
    drawn = _draws(rows, chosen).where("draws is not null").withColumn("draw", F.explode("draws"))
    drawn = drawn.where("draw.end_hash is null or hash < draw.end_hash or hash = draw.end_hash and size > 0 and 2 * draw.end_words >= size")
    drawn = drawn.withColumn("order", F.xxhash64(F.lit(seed), "draw.shard", "hash", "draw.repeat"))
    shuffled = drawn.repartition("draw.shard", "order").sortWithinPartitions("draw.shard", "order")
    extra = [F.col("draw.shard").alias("mix_shard"), F.col("draw.repeat").alias("mix_repeat"), F.col("size").alias("mix_words")]
    return shuffled.select(*[F.col(doc)[c].alias(c) for c in docs.columns], *(extra if keep_plan else []))


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    rows = measure(docs)
    return taken_words(rows, plan(rows))
