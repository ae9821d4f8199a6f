"""Packing by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences and a rest. Rests fall into classes of ``unit`` tokens,
and the histogram of classes, which is small, is all that the plan needs. A linear program chooses patterns (sets of
classes that fit a sequence) and how often to use each; a knapsack dynamic program prices new patterns with the
program's duals until none helps. Uses are rounded down, and first-fit-decreasing patterns take what remains. Patterns
that would waste more than ``max_waste`` aren't used: their documents, and any that found no place, are laid end to
end and cut where a sequence ends. Rests are ranked within their class, and rank ``r`` of a class takes the class's
``r``-th place in the patterns.

Ranks are made of a running number within each task, kept with the tokens, plus the number of the class's rests in
earlier tasks, so no class, however frequent, meets in one task.

Defined cases: a null text is empty and has the end id only; rows that repeat are packed each; an empty table gives no
pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, staged
from .rans import narrow, widen
from .tokens import chunks, encoder

SEQUENCE = 4096
UNIT = 8
MAX_WASTE = 1 / 64
MAX_COLUMNS = 3000
#: Rows of 32 bytes that are broadcast at most; more are joined.
BROADCAST_ROWS = 500_000


def best_pattern(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's value and its numbers of each class, by dynamic programming over the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(weight, c, "right")
        best[c], pick[c] = best[c - 1], -1
        if fits:
            got = best[c - weight[:fits]] + value[:fits]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], pick[c] = got[k], k
    out, c = np.zeros(len(weight), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= weight[pick[c]]
    return float(best[room]), out


def solve_cutting_stock(weight: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and uses of a nearly optimal solution of the linear program, by the revised simplex method.

    It starts with patterns of one class each and stops once no pattern is worth ``1 + gap``: the bound then says
    that no solution is better by more than that share.
    """
    m = len(weight)
    basis = np.diag(room // weight).astype(float)  # a column per pattern
    inverse = np.diag(1 / basis.diagonal())
    cost, uses = np.ones(m), inverse @ demand
    for _ in range(MAX_COLUMNS):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a class that is worth leaving over
            column, price = np.zeros(m), 0.0
            column[dual.argmin()] = -1
        else:
            value, pattern = best_pattern(dual, weight, room)
            if value <= 1 + gap:
                break
            column, price = pattern.astype(float), 1.0
        step = inverse @ column
        positive = step > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, uses / np.where(positive, step, 1), np.inf)
        out = int(ratio.argmin())
        uses -= ratio[out] * step
        uses[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    real = (cost > 0) & (uses > 1e-9)
    return np.rint(basis[:, real].T).astype(np.int64), uses[real]


def first_fit(weight: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns that hold the whole demand, filled from the largest class down."""
    left, out = demand.copy(), []
    while left.sum():
        free, pattern = room, np.zeros(len(weight), np.int64)
        for k in range(len(weight) - 1, -1, -1):
            n = min(left[k], free // weight[k])
            pattern[k] = n
            free -= n * weight[k]
        left -= pattern
        out.append(pattern)
    return out


@dataclass(frozen=True)
class Plan:
    """Places of ranked rests. For class ``c`` entry ``i`` takes ranks from ``begin[c][i]``, ``per[c][i]`` of them in
    each of consecutive sequences from ``sequence[c][i]`` on; ranks from ``pool[c][0]`` on lie end to end, the first of
    them at unit ``pool[c][1]`` of the sequences from ``pool_sequence`` on; full sequences start at ``full_sequence``."""
    begin: dict
    per: dict
    sequence: dict
    pool: dict
    pool_sequence: int
    full_sequence: int


def make_plan(histogram: dict[int, int], n_full: int, room: int, max_waste: float = MAX_WASTE) -> Plan:
    """``histogram``: rests by class, at most ``room`` classes."""
    classes = sorted(histogram)
    weight = np.array(classes, np.int64)
    demand = np.array([histogram[c] for c in classes], np.int64)
    begin, per, sequence = defaultdict(list), defaultdict(list), defaultdict(list)
    taken, at = np.zeros(len(classes), np.int64), 0
    if classes:
        patterns, uses = solve_cutting_stock(weight, demand.astype(float), room)
        chosen = [(p, int(np.floor(u + 1e-6))) for p, u in zip(patterns, uses)]
        left = demand.copy()
        used: list[tuple[np.ndarray, int]] = []
        for p, u in sorted(chosen, key=lambda x: -int(x[0] @ weight)):
            held = p > 0
            u = min([u, *(left[held] // p[held])])  # classes may be covered more than once
            if u and (room - p @ weight) <= max_waste * room:
                used.append((p, int(u)))
                left -= p * u
        rounded = left <= 0
        small = np.where(rounded, 0, np.minimum(left, 2 * room))  # the uses lost by rounding; frequent wasteful ones go to the pool
        for p in first_fit(weight, small, room):
            if (room - p @ weight) <= max_waste * room:
                used.append((p, 1))
        for p, u in used:
            for k in np.flatnonzero(p):
                c = classes[k]
                begin[c].append(int(taken[k]))
                per[c].append(int(p[k]))
                sequence[c].append(at)
                taken[k] += p[k] * u
            at += u
    pool, units = {}, 0
    for k in range(len(classes) - 1, -1, -1):
        pool[classes[k]] = (int(taken[k]), units)
        units += int(demand[k] - taken[k]) * classes[k]
    to_array = {x: (np.array(begin[x], np.int64), np.array(per[x], np.int64), np.array(sequence[x], np.int64)) for x in classes}
    return Plan({c: v[0] for c, v in to_array.items()}, {c: v[1] for c, v in to_array.items()}, {c: v[2] for c, v in to_array.items()},
                pool, at, at + -(-units // room))


def place(plan: Plan, cls: int, rank: int, rest: int, room: int, unit: int) -> list[tuple[int, int]]:
    """The ``(sequence, length)`` of the one or two pieces of a rest."""
    first, units = plan.pool[cls]
    if rank < first:
        i = int(np.searchsorted(plan.begin[cls], rank, "right")) - 1
        return [(int(plan.sequence[cls][i] + (rank - plan.begin[cls][i]) // plan.per[cls][i]), rest)]
    at = units + (rank - first) * cls
    here = (room - at % room) * unit
    sequence = plan.pool_sequence + at // room
    return [(sequence, rest)] if cls * unit <= here else [(sequence, here), (sequence + 1, rest - here)]


TOKEN_SCHEMA = "part int, row long, doc_id long, n_tokens long, cls int, cls_row long, full_row long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, spaced: bool, end: int, sequence: int, unit: int) -> DataFrame:
    """Each document's ids, its class, and its number within the task and class."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, full, seen = TaskContext.get().partitionId(), 0, 0, defaultdict(int)
        for table in chunks(batches, "text"):
            ids, counts = encoder(tokenizer, spaced).encode(table["text"].combine_chunks(), end)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            rows = []
            for i, doc_id in enumerate(table["doc_id"].to_pylist()):
                n = int(counts[i])
                cls = -(-(n % sequence) // unit)
                rows.append((part, row, doc_id, n, cls, seen[cls], full, narrow(ids[bounds[i]:bounds[i + 1]])))
                seen[cls] += 1
                row, full = row + 1, full + n // sequence
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows[at:at + 2000]], schema=ARROW)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return staged(rows.mapInArrow(run, TOKEN_SCHEMA), "pack-tokens")


ARROW = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("cls", pa.int32()),
                   ("cls_row", pa.int64()), ("full_row", pa.int64()), ("ids", pa.binary())])
NAMES = ARROW.names
PIECE_SCHEMA = ("doc_id long, part int, row long, piece int, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, ids binary")


def pieces(tokens: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT, max_waste: float = MAX_WASTE, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents with their sequences, not yet their offsets."""
    spark, room = tokens.sparkSession, sequence // unit
    counts = tokens.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most room + 1 rows
    histogram.pop(0, None)
    full = tokens.groupBy("part").agg(F.sum(F.floor(F.col("n_tokens") / sequence)).cast("long").alias("n"))
    n_full = full.agg(F.sum("n")).first()[0] or 0
    plan = make_plan(histogram, n_full, room, max_waste)
    # rests of the class, and full sequences, in earlier tasks: a row per task and class, windows hold a row per task
    def earlier(*by):
        return Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    first = counts.withColumn("cls_first", F.coalesce(F.sum("n").over(earlier("cls")), F.lit(0))).drop("n")
    full_first = full.withColumn("full_first", F.coalesce(F.sum("n").over(earlier()), F.lit(0))).drop("n")
    offsets = staged(first.join(full_first, "part"), "pack-offsets")
    small = offsets.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(offsets) if small else offsets, ["part", "cls"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, n, at = widen(r["ids"]), r["n_tokens"], 0
                whole = n // sequence
                full_at = plan.full_sequence + r["full_first"] + r["full_row"]
                places = [(full_at + i, sequence) for i in range(whole)]
                if n % sequence:
                    places += place(plan, r["cls"], r["cls_first"] + r["cls_row"], n % sequence, room, unit)
                for k, (where, length) in enumerate(places):
                    own = ids[at:at + length]
                    rows.append({"doc_id": r["doc_id"], "part": r["part"], "row": r["row"], "piece": k, "start": at, "length": length,
                                 "ids_crc32": zlib.crc32(own.astype("<u4").tobytes()), "doc_tokens": n, "sequence_id": where,
                                 "ids": own.astype("<u4").tobytes() if with_ids else None})
                    at += length
            yield pa.RecordBatch.from_pylist(rows, schema=PIECE_ARROW)

    return placed.select("part", "row", "doc_id", "n_tokens", "cls", "cls_row", "full_row", "ids", "cls_first", "full_first").mapInArrow(cut, PIECE_SCHEMA)


PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                         ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, spaced: bool = False, end: int = 2, sequence: int = SEQUENCE, unit: int = UNIT,
         max_waste: float = MAX_WASTE, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and its ids as bytes."""
    found = pieces(tokenised(docs, tokenizer, spaced, end, sequence, unit), sequence, unit, max_waste, with_ids)
    found = found if with_ids else found.drop("ids")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("part", "row", "piece")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its length and its ids; a sequence has few pieces by construction."""
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
