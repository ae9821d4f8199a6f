"""Prefix trie of turn sequences by van Emde Boas recursion.

A node is a distinct prefix of the sequences; its members are the sequences that start with it, and the smallest member
owns it. Prefixes are named by cutting: a sequence of height 2h is cut at h, the cut prefix is named by the name where
its trie starts and a fingerprint of the turns up to the cut, and the lower part is a sequence of the forest below that
name. Upper and lower parts are cut further, all at once, down to single turns. Cuts at multiples of ``HEIGHT`` are
Spark joins over one row a block of turns, the recursion calling itself for the blocks; those below run on arrays in
tasks that hold blocks of at most ``HEIGHT`` turns. So no task needs a whole sequence, and the number of steps grows
with the logarithm of the longest one.

A sequence owns a downward path of nodes, at the ends of which other paths hang. Totals of subtrees are sums along the
paths, block totals being grafted upward onto the blocks above by the same recursion, plus the whole paths of those
members that own nothing up to there.

Defined cases: turns without a sequence id take no part; turns are ordered by ``turn`` (null first), then role and
text, repeated rows standing one after another; a null role or text is empty; a sequence without turns ends at the
root; no sequences give no nodes; further columns play no part. Names are 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, python_ready, staged
from .neardup import mix

#: Turns of a block, a power of two; what a task holds of a sequence.
HEIGHT = 1024
#: Ids of a piece of a list of members.
PIECE = 16_384
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def batches_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}


def places(seq: np.ndarray, carry: tuple[int, int] | None) -> np.ndarray:
    """The place of each row among those of its sequence; ``carry``: the last sequence so far and its rows."""
    new = np.concatenate([[True], seq[1:] != seq[:-1]])
    first = np.flatnonzero(new)
    out = np.arange(len(seq)) - np.repeat(first, np.diff(np.append(first, len(seq))))
    if carry is not None and seq[0] == carry[0]:
        out[:first[1] if len(first) > 1 else len(seq)] += carry[1]
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """``seq, d`` (from 1), ``f1, f2`` (hashes of the turn), ``size`` (code points) of ``seq, turn, role, text``.

    Rows are dealt out by ranges of the order, so that a long sequence spreads over tasks; each task counts its own
    part, and the parts' sizes give what goes before."""
    spark = rows.sparkSession
    python_ready(spark)
    order = [F.col("seq"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # only tells equal rows apart
    dealt = rows.repartitionByRange(*order, F.col("copy")).sortWithinPartitions(*order)
    narrow = dealt.select("seq", F.spark_partition_id().alias("part"), F.xxhash64(F.lit(1), "role", "text").alias("f1"),
                          F.xxhash64(F.lit(2), "text", "role").alias("f2"), F.char_length("text").cast("long").alias("size"))

    def count(batches):
        carry = None
        for x in batches_of(batches, ["seq", "part", "f1", "f2", "size"]):
            at = places(x["seq"], carry)
            carry = (x["seq"][-1], int(at[-1]) + 1)
            yield pa.RecordBatch.from_pydict({**x, "at": at})

    parts = staged(narrow.mapInArrow(count, "seq long, part int, f1 long, f2 long, size long, at long"), "turns")
    held = parts.groupBy("seq", "part").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a sequence goes on in a further part only where a part ends: there are fewer such rows than parts
    later = staged(held.withColumn("before", before).where("before is not null").select("seq", "part", "before"), "later")
    return (parts.join(fits(later), ["seq", "part"], "left")
            .select("seq", (F.col("at") + F.coalesce("before", F.lit(0)) + 1).alias("d"), "f1", "f2", "size"))


def name_prefixes(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``rows``: ``seq, j, f1, f2`` with j = 0, 1, ... in each sequence, and further columns. Adds ``a, b``, the name of
    the prefix before the row."""
    levels = height.bit_length() - 1
    extra = [c for c in rows.columns if c not in ("seq", "j", "f1", "f2")]
    i = F.col("j") % height
    rows = rows.select("seq", "j", F.floor(F.col("j") / height).alias("block"), F.xxhash64(F.lit(1), "f1", i).alias("g1"),
                       F.xxhash64(F.lit(2), "f2", i).alias("g2"), *extra)
    tall = rows.where("block > 0").select("seq").distinct()
    if tall.limit(1).count():
        tall = staged(tall, "tall")
        blocks = (rows.join(fits(tall), "seq", "left_semi").groupBy("seq", F.col("block").alias("j"))
                  .agg(F.bit_xor("g1").alias("f1"), F.bit_xor("g2").alias("f2")))
        above = name_prefixes(staged(blocks, "blocks"), height).select("seq", F.col("j").alias("block"), "a", "b").where("block > 0")
        rows = rows.join(fits(above), ["seq", "block"], "left")
    else:
        rows = rows.withColumns({"a": F.lit(None).cast("long"), "b": F.lit(None).cast("long")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("a", "b")})
    names = ["seq", "block", "j", "g1", "g2", "a", "b", *extra]

    def cut(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        """All sequences of the arrays at once, from the highest cut down."""
        at = x["j"] % height
        first = np.arange(len(at)) - at
        out = dict(x)
        for lane, salt, g in (("a", _SALTS[0], "g1"), ("b", _SALTS[1], "g2")):
            upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x[g].view(np.uint64))])
            name = x[lane].view(np.uint64).copy()
            for level in reversed(range(levels)):
                low = np.flatnonzero(at >> level & 1)  # rows below this cut
                top = first[low] + (at[low] >> level + 1 << level + 1)
                fingerprint = upto[top + (1 << level)] ^ upto[top]
                name[low] = mix(mix(name[low] + salt) ^ fingerprint) + np.uint64(level + 1)
            out[lane] = name.view(np.int64)
        return pa.RecordBatch.from_pydict({k: out[k] for k in ["seq", "j", "a", "b", *extra]})

    def deal(batches):
        held = None
        for x in batches_of(batches, names):
            if held is not None:
                x = {k: np.concatenate([held[k], x[k]]) for k in names}
            last = len(x["j"]) - 1 - int(x["j"][-1] % height)  # where the block begins that may go on
            if last:
                yield cut({k: v[:last] for k, v in x.items()})
            held = {k: v[last:] for k, v in x.items()}
        if held is not None:
            yield cut(held)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["seq", "j", "a", "b", *extra])
    dealt = rows.select(*names).repartition("seq", "block").sortWithinPartitions("seq", "block", "j")
    return staged(dealt.mapInArrow(deal, schema), "prefixes")


def sums_below(paths: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """``paths``: ``seq, j`` and values. Each value becomes the sum from its row to the end of its sequence."""
    rows = paths.withColumn("block", F.floor(F.col("j") / height))
    below = Window.partitionBy("seq", "block").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({v: F.sum(v).over(below) for v in values})
    spans = rows.groupBy("seq").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("seq")
    if not spans.limit(1).count():
        return out.drop("block")
    totals = rows.join(fits(staged(spans, "spans")), "seq", "left_semi").groupBy("seq", F.col("block").alias("j")).agg(*[F.sum(v).alias(v) for v in values])
    totals = staged(totals, "totals")
    above = sums_below(totals, values, height).join(totals.select("seq", "j", *[F.col(v).alias(f"own_{v}") for v in values]), ["seq", "j"])
    graft = staged(above.select("seq", F.col("j").alias("block"), *[(F.col(v) - F.col(f"own_{v}")).alias(f"graft_{v}") for v in values]), "grafts")
    got = out.join(fits(graft), ["seq", "block"], "left")
    return got.select("seq", "j", *[c for c in paths.columns if c not in ("seq", "j", *values)],
                      *[(F.col(v) + F.coalesce(f"graft_{v}", F.lit(0))).alias(v) for v in values])


def list_digests(rows: DataFrame) -> DataFrame:
    """``owner, j, digest``: the SHA-256 of the decimal ``seq`` of each (owner, j), ascending and joined by commas. Tasks
    join pieces of ranges; one task runs through the pieces of a list, holding one."""
    key = ["owner", "j"]
    dealt = rows.select("owner", "j", "seq").repartitionByRange("owner", "j", "seq").sortWithinPartitions("owner", "j", "seq")

    def join(batches):
        no = 0
        for x in batches_of(batches, ["owner", "j", "seq", "part"]):
            new = np.concatenate([[True], (x["owner"][1:] != x["owner"][:-1]) | (x["j"][1:] != x["j"][:-1])])
            new[::PIECE] = True
            first = np.flatnonzero(new)
            text = [",".join(map(str, x["seq"][a:b].tolist())) for a, b in zip(first, np.append(first[1:], len(new)))]
            yield pa.RecordBatch.from_pydict({"owner": x["owner"][first], "j": x["j"][first], "part": x["part"][first],
                                              "no": no + np.arange(len(first)), "ids": text})
            no += len(first)

    pieces = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(join, "owner long, j long, part int, no long, ids string")
    pieces = staged(pieces, "pieces")

    def digest(batches):
        own, state = None, None
        for batch in batches:
            done = []
            for owner, j, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "j", "ids"))):
                if own == (owner, j):
                    state.update(b",")
                else:
                    if own is not None:
                        done.append((*own, state.hexdigest()))
                    own, state = (owner, j), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=[*key, "digest"])
        if own is not None:
            yield pa.RecordBatch.from_pydict({"owner": [own[0]], "j": [own[1]], "digest": [state.hexdigest()]})

    return pieces.repartition(*key).sortWithinPartitions(*key, "part", "no").mapInArrow(digest, "owner long, j long, digest string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of ``turns`` (``seq, d, f1, f2, size``, d = 1 to the sequence's length, written already) and
    ``lengths`` (``seq, n``, a row a sequence): ``conv_id`` (owner), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Owner and depth name the turn that a node adds."""
    python_ready(turns.sparkSession)
    end = lengths.select("seq", F.col("n").alias("j"), F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit(True).alias("last"))
    rows = turns.select("seq", (F.col("d") - 1).alias("j"), "f1", "f2", F.lit(False).alias("last")).unionByName(end)
    members = name_prefixes(rows, height)
    named = staged(members.groupBy("a", "b").agg(F.min("seq").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.any_value("j").alias("j")), "named")
    owned = staged(members.join(named.select("a", "b", "owner"), ["a", "b"]).select("seq", "j", "owner", "last"), "owned")
    # a sequence owns its nodes from ``top`` down to its end; there it hangs from a node of ``above``
    guests = owned.where("seq <> owner")
    top = guests.groupBy("seq").agg((F.max("j") + 1).alias("top"), F.max_by("owner", "j").alias("above"))
    paths = staged(lengths.join(top, "seq", "left").select("seq", "n", F.coalesce("top", F.lit(0)).alias("top"), "above"), "paths")
    hanging = paths.where("above is not null and top <= n").groupBy(F.col("above").alias("owner"), (F.col("top") - 1).alias("j")).agg(F.count(F.lit(1)).alias("hanging"))
    nodes = (named.drop("a", "b").join(hanging, ["owner", "j"], "left")
             .join(turns.select(F.col("seq").alias("owner"), F.col("d").alias("j"), "size"), ["owner", "j"], "left")
             .join(fits(paths.withColumnRenamed("seq", "owner")), "owner"))
    children = F.coalesce("hanging", F.lit(0)) + (F.col("j") < F.col("n")).cast("long")
    nodes = nodes.select(F.col("owner").alias("seq"), "j", "n_convs", children.alias("n_children"),
                         F.when(F.col("j") > F.col("top"), F.col("owner")).otherwise(F.col("above")).alias("parent"),
                         (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("saved"))
    nodes = staged(nodes, "nodes")
    whole = staged(nodes.groupBy("seq").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "whole")
    brought = (guests.join(fits(whole), "seq").groupBy(F.col("owner").alias("seq"), "j")
               .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    digests = list_digests(owned.where("last")).withColumnRenamed("owner", "seq")
    got = sums_below(nodes, ["leaves", "saved"], height).join(brought, ["seq", "j"], "left").join(digests, ["seq", "j"], "left")
    zero = F.lit(0).cast("long")
    return got.select(F.col("seq").alias("conv_id"), F.col("j").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                      (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
                      (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
                      F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """The numbered turns of ``conv_id, turn, role, text``; written."""
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return staged(numbered(rows.where("seq is not null")), "numbered")


def head_turns(seq: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(seq.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation's first turns were replaced by those of the first one of its hundred; as
    many as that one has, at most ``head_turns``. Written."""
    seqs = turns.groupBy("seq").agg(F.max("d").alias("own"))
    seqs = staged(seqs.select("seq", "own", head_turns(F.col("seq")).alias("h"), (F.col("seq") - F.pmod("seq", F.lit(100))).alias("base")), "seqs")
    bases = seqs.where("seq = base").select("base", F.col("own").alias("has"))
    seqs = seqs.join(fits(bases), "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    seqs = staged(seqs.select("seq", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilt-lengths")
    own = turns.join(fits(seqs.select("seq", "h", "taken")), "seq").where("d > h").select("seq", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "f1", "f2", "size")
    heads = turns.where("d <= 5").select(F.col("seq").alias("base"), "d", "f1", "f2", "size")
    heads = seqs.where("taken > 0").select("seq", "base", "taken").join(heads, "base").where("d <= taken").select("seq", "d", "f1", "f2", "size")
    return staged(own.unionByName(heads), "rebuilt"), seqs.select("seq", "n")
