"""Sharding by fixed virtual slots.

Each record is hashed into one of a few thousand slots, once and for all. Bytes are summed per slot, and a small
slot-to-shard map places the slots: heaviest first, each on the lightest shard so far. The map is a Parquet table
with a version; rebalancing writes a new version that moves only the slots it must, so records never change slot.

Defined cases: a null text has no bytes (size 1), a null id is hashed as a null, rows that agree in id and text share
a slot and are numbered among themselves, an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path
from .common import text_of

N_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, n_rows long, first_row long"


def record_columns(docs: DataFrame, n_slots: int) -> dict[str, Column]:
    text = text_of(docs)
    crc = F.crc32(text.cast("binary"))
    return {"size": (F.octet_length(text) + F.lit(1)).cast("long"), "text_crc32": crc,
            "vslot": F.pmod(F.xxhash64(docs["doc_id"], crc), F.lit(n_slots)).cast("int")}


def slot_totals(docs: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """Bytes and rows of every slot, by slot number: ``n_slots`` pairs, however large the table is."""
    cols = record_columns(docs, n_slots)
    got = docs.select(cols["vslot"].alias("v"), cols["size"].alias("s")).groupBy("v").agg(F.sum("s"), F.count("s"))
    totals = [(0, 0)] * n_slots
    for v, size, n in got.collect():
        totals[v] = (size, n)
    return totals


def place(totals: list[tuple[int, int]], n_shards: int) -> list[int]:
    """Heaviest slot first, each to the lightest shard so far; ties go to smaller numbers."""
    shards, out = [(0, s) for s in range(n_shards)], [0] * len(totals)
    for v in sorted(range(len(totals)), key=lambda v: (-totals[v][0], v)):
        load, s = heapq.heappop(shards)
        out[v] = s
        heapq.heappush(shards, (load + totals[v][0], s))
    return out


def rebalance(slot_map: list[int], totals: list[tuple[int, int]], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """An edited map over ``n_shards``: slots leave only shards that are too heavy or no longer exist.

    From each shard above ``(1 + tolerance)`` times the mean the smallest sufficient slots go to the lightest shard,
    as long as a move narrows the gap.
    """
    out = list(slot_map)
    members: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    homeless = []
    for v, s in enumerate(out):
        members[s].append(v) if s < n_shards else homeless.append(v)
    load = {s: sum(totals[v][0] for v in vs) for s, vs in members.items()}
    light = [(b, s) for s, b in load.items()]
    heapq.heapify(light)

    def lightest() -> int:
        while light[0][0] != load[light[0][1]]:
            heapq.heappop(light)
        return light[0][1]

    def move(v: int, to: int) -> None:
        out[v] = to
        load[to] += totals[v][0]
        members[to].append(v)
        heapq.heappush(light, (load[to], to))

    for v in sorted(homeless, key=lambda v: (-totals[v][0], v)):
        move(v, lightest())
    most = sum(load.values()) / n_shards * (1 + tolerance)
    for s in sorted(load, key=lambda s: (-load[s], s)):
        for v in sorted(members[s], key=lambda v: (-totals[v][0], v)):
            to = lightest()
            if load[s] <= most:
                break
            if to != s and 0 < totals[v][0] < load[s] - load[to]:
                load[s] -= totals[v][0]
                members[s].remove(v)
                heapq.heappush(light, (load[s], s))
                move(v, to)
    return out


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int], totals: list[tuple[int, int]]) -> None:
    """Append one version of the map: a row per slot, with the number of its shard's rows in smaller slots."""
    before: dict[int, int] = {}
    rows = []
    for v, s in enumerate(slot_map):
        rows.append((version, v, s, *totals[v], before.get(s, 0)))
        before[s] = before.get(s, 0) + totals[v][1]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest if none is named."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(version))


def assign(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, shard, slot`` of each row; ``slot`` numbers a shard's rows from 0.

    The map has ``n_slots`` rows, so it is broadcast. Rows are numbered within their virtual slot, which hashing
    keeps small, and the map says how many rows of the shard precede it.
    """
    cols = record_columns(docs, n_slots)
    rows = docs.select("doc_id", *[c.alias(k) for k, c in cols.items()])
    in_slot = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("at", F.row_number().over(in_slot) - 1)
            .join(F.broadcast(slot_map.select("vslot", "shard", "first_row")), "vslot")
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first_row") + F.col("at")).alias("slot")))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, n_slots: int = N_SLOTS) -> None:
    """Write whole rows into one folder per shard; a shard's slots are written by several tasks."""
    shard = "shard"
    cols = docs.withColumn("vslot", record_columns(docs, n_slots)["vslot"])
    placed = cols.join(F.broadcast(slot_map.select("vslot", shard)), "vslot")
    placed.repartition("vslot").write.partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """Build and store version 1 of the map from the table's own bytes, then assign every row by it."""
    spark = docs.sparkSession
    totals = slot_totals(docs, n_slots)
    path = scratch_path(spark, "slot-map")
    save_map(spark, path, 1, place(totals, n_shards), totals)
    return assign(docs, load_map(spark, path), n_slots)
