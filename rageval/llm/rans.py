"""Token files coded by a static range asymmetric numeral system.

One table of token frequencies, counted over the whole corpus, is shared by all blocks. A block codes some whole
documents on its own: token ``i`` belongs to lane ``i % lanes``, and all lanes advance together, so coding is a few
array operations per ``lanes`` tokens. Each lane is a 64-bit state that gives out 32-bit words. Every
``CHECKPOINT_STEPS`` steps the block notes the states and the place in the stream, from where a reader can decode a
part of the block; checksums cover the stream and the ids.

File format, little-endian, one frame per block, a line end after each::

    magic "RNS1", header (see HEADER), document ids int64[docs], null flags uint8[docs], counts uint32[docs],
    checkpoint places uint32[points], checkpoint states uint64[points][lanes], stream uint32[words]

The first checkpoint is the start. The table is a frame of its own, magic "RNT1", in the folder ``table``.

Defined cases: a null text is empty, its only id is the end id; null ids come first and ties keep all rows, ordered by
text; an empty table has no blocks. A document is never cut, so a very long one makes a long block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import python_ready, staged
from .tokens import chunks, encoder

PROB_BITS = 18
LOW = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT_STEPS = 512
BLOCK_TOKENS = 1 << 20
BLOCKS_PER_FILE = 16
#: Rows of 16 bytes that are broadcast at most; more are joined.
BROADCAST_PARTS = 100_000
#: part, block, ids before the block in the corpus; documents, tokens, lanes, checkpoints, words; crc32 of what follows
#: the header and of the ids as unsigned 32-bit integers.
HEADER = struct.Struct("<IIqIIIIIII")


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to ``2 ** PROB_BITS``; every token that occurs has one of at least 1."""
    freq: np.ndarray
    start: np.ndarray
    token: np.ndarray

    @staticmethod
    def of(freq: np.ndarray) -> Table:
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        return Table(freq.astype(np.uint64), start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq))

    @staticmethod
    def from_counts(counts: np.ndarray) -> Table:
        """Shares rounded down, at least 1; what is left or missing is spread over the most frequent tokens."""
        total, room = counts.sum(), 1 << PROB_BITS
        if not total:
            return Table.of(np.zeros(0, np.int64))
        if np.count_nonzero(counts) > room:
            raise ValueError(f"more than {room} distinct tokens")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) / total * room).astype(np.int64)), 0)
        by_size = np.argsort(-freq, kind="stable")
        gap, i = room - int(freq.sum()), 0
        while gap:
            k = by_size[i % np.count_nonzero(freq)]
            step = max(1, abs(gap) // 64)
            step = step if gap > 0 else -min(step, int(freq[k]) - 1)
            freq[k] += step
            gap -= step
            i += 1
        return Table.of(freq)

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return b"RNT1" + struct.pack("<II", len(self.freq), zlib.crc32(body)) + body

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        n, crc = struct.unpack_from("<II", data, 4)
        body = data[12:12 + 4 * n]
        if data[:4] != b"RNT1" or zlib.crc32(body) != crc:
            raise ValueError("damaged table")
        return Table.of(np.frombuffer(body, "<u4").astype(np.int64))


def encode_stream(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word stream, the checkpoints' places in it and their states.

    Coding runs from the last token to the first, so that decoding runs forwards.
    """
    shift, high = np.uint64(PROB_BITS), np.uint64((int(LOW) >> PROB_BITS) << 32)
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words, sizes, notes = [], np.zeros(steps + 1, np.int64), {}
    for s in range(steps - 1, -1, -1):
        own = ids[s * lanes:(s + 1) * lanes]
        x, f = state[:len(own)], table.freq[own]
        full = x >= high * f
        words.append(x[full].astype(np.uint32))
        sizes[s] = len(words[-1])
        x[full] >>= np.uint64(32)
        q, r = np.divmod(x, f)
        state[:len(own)] = (q << shift) + r + table.start[own]
        if s % CHECKPOINT_STEPS == 0:
            notes[s] = state.copy()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(sizes)])
    marks = sorted(notes)
    return stream, before[marks].astype(np.uint32), np.array([notes[s] for s in marks], np.uint64).reshape(len(marks), lanes)


def decode_stream(stream: np.ndarray, n: int, table: Table, states: np.ndarray, places: np.ndarray, lanes: int,
                  first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens of the checkpoints ``first`` to ``last`` (all by default) of a block of ``n`` tokens."""
    shift, mask = np.uint64(PROB_BITS), np.uint64((1 << PROB_BITS) - 1)
    steps = -(-n // lanes)
    stop = min(steps, (len(places) if last is None else last) * CHECKPOINT_STEPS)
    begin = first * CHECKPOINT_STEPS
    out = np.empty(max(0, min(n, stop * lanes) - begin * lanes), np.uint32)
    if not len(out):
        return out
    state, at, done = states[first].copy(), int(places[first]), 0
    for s in range(begin, stop):
        x = state[:min(lanes, n - s * lanes)]
        slot = x & mask
        token = table.token[slot.astype(np.int64)]
        out[done:done + len(token)] = token
        done += len(token)
        x = table.freq[token] * (x >> shift) + slot - table.start[token]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[at:at + len(low)]
        at += len(low)
        state[:len(x)] = x
    return out


def encode_block(part: int, block: int, start: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids)))
    stream, places, states = encode_stream(ids, table, lanes)
    body = b"".join((np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
                     counts.astype("<u4").tobytes(), places.astype("<u4").tobytes(), states.astype("<u8").tobytes(), stream.astype("<u4").tobytes()))
    return b"RNS1" + HEADER.pack(part, block, start, len(doc_ids), len(ids), lanes, len(places), len(stream),
                                 zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def frames(data: bytes) -> Iterator[tuple[dict, dict]]:
    """Header and arrays of each frame of a file."""
    at = 0
    while at < len(data):
        if data[at:at + 4] != b"RNS1":
            raise ValueError(f"no block at byte {at}")
        part, block, start, docs, n, lanes, points, words, crc, ids_crc = HEADER.unpack_from(data, at + 4)
        at += 4 + HEADER.size
        head = {"part": part, "block": block, "start": start, "n": n, "lanes": lanes, "ids_crc": ids_crc}
        body, begin = {}, at
        for name, kind, k in (("doc_ids", "<i8", docs), ("null", "u1", docs), ("counts", "<u4", docs), ("places", "<u4", points),
                              ("states", "<u8", points * lanes), ("stream", "<u4", words)):
            body[name] = np.frombuffer(data, kind, k, at)
            at += body[name].nbytes
        if zlib.crc32(memoryview(data)[begin:at]) != crc:
            raise ValueError(f"damaged block {part}.{block}")
        body["states"] = body["states"].reshape(points, lanes)
        yield head, body
        at += 1


def decode_block(head: dict, body: dict, table: Table) -> np.ndarray:
    ids = decode_stream(body["stream"], head["n"], table, body["states"], body["places"], head["lanes"])
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["ids_crc"]:
        raise ValueError(f"block {head['part']}.{head['block']} decodes to other ids")
    return ids


BLOCK_SCHEMA = "part int, block int, inside long, n_tokens long, doc_ids array<long>, counts array<int>, ids binary"


def tokenised_blocks(docs: DataFrame, tokenizer: str, spaced: bool, end: int) -> DataFrame:
    """Blocks of whole documents in ascending order of id: partitions hold ranges of ids, blocks cut them up.

    Ids are kept as 16-bit integers where the vocabulary allows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, inside, held = TaskContext.get().partitionId(), 0, 0, []
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("counts", pa.list_(pa.int32())), ("ids", pa.binary())])

        def give():
            nonlocal held, size, block, inside
            ids = np.concatenate([h[2] for h in held])
            docs_ = [d for h in held for d in h[0]]
            counts = np.concatenate([h[1] for h in held])
            row = (part, block, inside, len(ids), docs_, counts.tolist(), narrow(ids))
            held, size, block, inside = [], 0, block + 1, inside + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        size = 0
        for table in chunks(batches, "text"):
            ids, counts = encoder(tokenizer, spaced).encode(table["text"].combine_chunks(), end)
            names, bounds, done = table["doc_id"].to_pylist(), np.concatenate([[0], np.cumsum(counts)]), 0
            while done < len(names):
                upto = max(done + 1, int(np.searchsorted(bounds, bounds[done] + BLOCK_TOKENS - size, "right")) - 1)
                held.append((names[done:upto], counts[done:upto], ids[bounds[done]:bounds[upto]]))
                size += int(bounds[upto] - bounds[done])
                if upto < len(names) or size >= BLOCK_TOKENS:
                    yield give()
                done = upto
        if held:
            yield give()

    return staged(rows.mapInArrow(cut, BLOCK_SCHEMA), "token-blocks")


def narrow(ids: np.ndarray) -> bytes:
    """A byte that says the width, then the ids."""
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint32)


def corpus_table(blocks: DataFrame) -> Table:
    """Frequencies of all tokens; a row for each of them, as many as the vocabulary has, comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                own = np.bincount(widen(data.as_py()))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[:len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    got = blocks.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(got["token"].max()) + 1 if len(got) else 0, np.int64)
    counts[got["token"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return Table.from_counts(counts)


def write_files(blocks: DataFrame, table: Table, path: str) -> None:
    """Write the frames with Spark's text sink, whose committer also takes care of lost executors; a task's blocks are
    in ascending order, and each says how many ids the corpus has before it."""
    spark = blocks.sparkSession
    starts, at = [], 0
    for part, n in blocks.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # a row per writing task
        starts.append((part, at))
        at += n
    first = spark.createDataFrame(starts, "part int, part_start long")
    whole = blocks.join(F.broadcast(first) if len(starts) <= BROADCAST_PARTS else first, "part")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = encode_block(row["part"], row["block"], row["part_start"] + row["inside"], row["doc_ids"], np.array(row["counts"]), widen(row["ids"]), table)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])

    (whole.sortWithinPartitions("part", "block").mapInArrow(code, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{path}/blocks"))
    spark.createDataFrame([(bytearray(table.to_bytes()),)], "b binary").coalesce(1).select(
        F.col("b").cast("string").alias("value")).write.text(f"{path}/table")


def read_table(spark: SparkSession, path: str) -> Table:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/table").where("length > 0")
    return Table.from_bytes(bytes(files.first()["content"]))


DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document, decoded from the files; ``start`` counts the ids of all documents before it."""
    python_ready(spark)
    table = read_table(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for head, body in frames(content.as_py()):
                    ids = decode_block(head, body, table)
                    counts = body["counts"].astype(np.int64)
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    plain = ids.astype("<u4")
                    crc = [zlib.crc32(plain[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(crc), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(body["doc_ids"], mask=body["null"].astype(bool)), pa.array(head["start"] + bounds[:-1]),
                         pa.array(counts), pa.array(crc, pa.int64()), lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    return files.mapInArrow(decode, DOC_SCHEMA)


def write_corpus(docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end: int = 2) -> None:
    """Tokenise all documents, count tokens, and write the files under ``path``."""
    blocks = tokenised_blocks(docs, tokenizer, spaced, end)
    write_files(blocks, corpus_table(blocks), path)


def round_trip(docs: DataFrame, tokenizer: str, spaced: bool = True, end: int = 2) -> DataFrame:
    """Write the corpus in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "rans")
    write_corpus(docs, path, tokenizer, spaced, end)
    return read_documents(docs.sparkSession, path, with_ids=False)
