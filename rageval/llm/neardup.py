"""Near-duplicate classes by DartMinHash.

A document is a weighted set of five-word shingles, in lower case; weights are 1 (the similarity is that of sets) or
the shingles' counts. Hashed darts are thrown at each element's region of the plane of weight and rank: the region is
cut into dyadic cells, a cell's hash says how many darts fall into it (a Poisson number) and where. Darts above the
element's weight miss. Each dart belongs to one of ``coordinates``; the earliest by rank is the coordinate's value.
Ranks are thrown band by band until every coordinate has its dart, so a long text throws few darts per element. Two
sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of ``rows`` coordinates make join keys. Of the texts with a key, the most central one (that shares most keys) is
compared with each other: a group of n costs n comparisons. Links, of at least ``similarity`` by exact comparison,
give connected components. Where a key's texts are then in several components, the signatures of all pairs across
components are compared, block by block within a task. Texts that have a partner whose agreement comes within
``MARGIN`` standard errors of the wanted similarity, and whose size allows it, are fetched once for their block and
compared there exactly; only links leave the task, and components are made anew.

Defined cases: texts with equal word sequences are one node, whatever their number; a text of fewer than five words
has one shingle of them all; texts that are null or have no words are alike to nothing, each its own class; classes
are named by their smallest id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fits, python_ready, staged
from .tokens import chunks

WORDS = re.compile(WORD)
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Ranks below this make the first band; each further one doubles what the bands cover.
FIRST_RANK = 0.125
#: A pair at the wanted similarity falls short by more standard errors in 1 of 4000 cases.
MARGIN = 3.5
#: Texts of a key that are compared with each other in one task.
BLOCK = 512
#: Bytes of text that are signed together; each takes some hundred bytes of memory.
CHUNK_CHARS = 2 << 20
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@dataclass
class Sets:
    """Elements of all texts, by text and element; ``key`` are two hashes of the word sequence, ``words`` its length."""
    doc: np.ndarray
    element: np.ndarray
    weight: np.ndarray
    key: np.ndarray
    words: np.ndarray

    def __post_init__(self):
        self.bounds = np.searchsorted(self.doc, np.arange(len(self.words) + 1))


def shingle_sets(texts: list[str | None], weighting: str = "set") -> Sets:
    lists = [WORDS.findall((t or "").lower()) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for x in lists for w in x]
    code, unique = pd.factorize(flat)
    word = pd.util.hash_array(unique.astype(object), categorize=False)[code] if len(flat) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    place = (np.arange(len(flat)) - first[doc]).astype(np.uint64)
    key = np.zeros((len(texts), 2), np.uint64)
    for k, seed in enumerate((_A, _D)):
        np.add.at(key[:, k], doc, mix(word ^ mix(place * seed + np.uint64(k + 1))))
    m = max(0, len(flat) - SHINGLE + 1)
    rolled = np.zeros(m, np.uint64)
    for i in range(SHINGLE):
        rolled = mix(rolled + _A) + word[i:m + i]
    whole = np.flatnonzero(doc[:m] == doc[SHINGLE - 1:]) if m else np.zeros(0, np.int64)
    element, owner = [mix(rolled[whole])], [doc[whole]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        h = np.zeros(1, np.uint64)
        for w in word[first[i]:first[i] + n[i]]:
            h = mix(h + _D) + w
        element.append(mix(h))
        owner.append(np.array([i]))
    element, owner = np.concatenate(element), np.concatenate(owner)
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    new = np.concatenate([[True], (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(element))).astype(float)
    return Sets(owner[at], element[at], counts if weighting == "count" else np.ones(len(at)), key, n)


@lru_cache(4096)
def poisson(mean: float) -> np.ndarray:
    """The distribution function at 0, 1, 2, ... as far as it differs from 1."""
    top = int(mean + 12 * np.sqrt(mean) + 24)
    logs = np.arange(1, top + 1)
    log_p = -mean + np.concatenate([[0], np.cumsum(np.log(mean) - np.log(logs))])
    return np.cumsum(np.exp(log_p))


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The signatures, a row per text; rows of texts without elements mean nothing."""
    # an element has a cell column for [0, 1), [1, 2), [2, 4), ... as far as its weight reaches
    columns = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    columns[weight <= 0] = 0
    source = np.repeat(np.arange(len(doc)), columns)
    column = np.arange(len(source)) - np.repeat(np.cumsum(columns) - columns, columns)
    doc, element, weight = doc[source], element[source], weight[source]
    out, done = np.zeros((n_docs, k), np.uint32), np.zeros(n_docs * k, bool)
    open_ = np.bincount(doc, minlength=n_docs) > 0
    for band in range(64):
        if not len(doc):
            break
        height = FIRST_RANK * (2.0 ** (band - 1) if band else 1)
        darts = []
        for c in np.unique(column):
            own = np.flatnonzero(column == c)
            low, width = (2.0 ** (c - 1), 2.0 ** (c - 1)) if c else (0.0, 1.0)
            cell = mix(element[own] + np.uint64((int(c) * 64 + band + 1) * int(_A) % 2 ** 64))
            number = np.searchsorted(poisson(width * height), unit(cell), "right")
            which = np.repeat(np.arange(len(own)), number)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(cell[which] + (turn + 1).astype(np.uint64) * _D)
            hit = low + width * unit(mix(dart ^ _A)) < weight[own][which]
            slot = doc[own][which] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            hit &= ~done[slot]
            darts.append((slot[hit], dart[hit]))
        slot, dart = (np.concatenate(x) for x in zip(*darts))
        order = np.lexsort((mix(dart ^ _B), slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[first]] = (mix(dart[first] ^ _C) >> np.uint64(32)).astype(np.uint32)
        done[slot[first]] = True
        open_ &= ~done.reshape(n_docs, k).all(axis=1)
        keep = open_[doc]
        doc, element, weight, column = doc[keep], element[keep], weight[keep], column[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    own = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1)) * _A
    for i in range(rows):
        key = mix(key + own[:, :, i])
    return key.view(np.int64)


def pair_similarity(sets: Sets, i: int, j: int) -> float:
    """The weighted Jaccard similarity of two texts, exactly (but for collisions of 64-bit hashes)."""
    x, y = slice(sets.bounds[i], sets.bounds[i + 1]), slice(sets.bounds[j], sets.bounds[j + 1])
    _, p, q = np.intersect1d(sets.element[x], sets.element[y], assume_unique=True, return_indices=True)
    both = np.minimum(sets.weight[x][p], sets.weight[y][q]).sum()
    total = sets.weight[x].sum() + sets.weight[y].sum() - both
    return float(both / total) if total else 0.0


def similarity(a: list[str], b: list[str], weighting: str) -> np.ndarray:
    """The similarity of each pair of texts."""
    sets = shingle_sets([*a, *b], weighting)
    return np.array([pair_similarity(sets, i, len(a) + i) for i in range(len(a))])


@dataclass(frozen=True)
class Settings:
    bands: int = BANDS
    rows: int = ROWS
    similarity: float = SIMILARITY
    weighting: str = "set"


OWN = ("nd_node", "nd_key", "nd_size", "nd_bands", "nd_signature")


def signed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows with a node number, a hash of the word sequence (null without words), the set's size, the band keys and
    a byte of each coordinate. Written once; earlier columns of those names go."""
    python_ready(docs.sparkSession)
    docs = docs.drop(*OWN)
    schema = T.StructType([*docs.schema.fields, T.StructField("nd_node", T.LongType()), T.StructField("nd_key", T.StringType()),
                           T.StructField("nd_size", T.DoubleType()), T.StructField("nd_bands", T.ArrayType(T.LongType())),
                           T.StructField("nd_signature", T.BinaryType())])
    bands, rows, weighting = settings.bands, settings.rows, settings.weighting

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 33
        for batch in (b for t in chunks(batches, "text", CHUNK_CHARS) for b in t.to_batches()):
            sets = shingle_sets(batch.column("text").to_pylist(), weighting)
            n = len(sets.words)
            signatures = dart_minhash(sets.doc, sets.element, sets.weight, n, bands * rows)
            keys = band_keys(signatures, bands, rows)
            empty = sets.words == 0
            names = [None if e else f"{a:016x}{b:016x}" for e, (a, b) in zip(empty.tolist(), sets.key.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            weights = np.bincount(sets.doc, weights=sets.weight, minlength=n)
            columns = [pa.array(node + np.arange(n)), pa.array(names, pa.string()), pa.array(weights), lists,
                       pa.array([x.tobytes() for x in signatures.astype(np.uint8)], pa.binary())]
            node += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *OWN])

    return staged(docs.mapInArrow(sign, schema), "signed")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component. Labels go to neighbours and labels of labels are
    looked up until nothing changes; each round is written."""
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        labels = staged(hooked.join(up, "next").select("node", "old", F.least("next", "above").alias("label")), "labels")
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough; written."""
    least, weighting = settings.similarity, settings.weighting

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                own = part.iloc[at:at + 256]
                s = similarity(own["text_a"].tolist(), own["text_b"].tolist(), weighting)
                yield pd.DataFrame({"a": own["a"], "b": own["b"], "s": s})[s >= least]

    both = (pairs.join(texts.select(F.col("nd_node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("nd_node").alias("b"), F.col("text").alias("text_b")), "b"))
    return staged(both.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a long, b long, s double"), "links")


def group_pairs(node, label, size, block, signature, keys, band: int, two_blocks: bool, settings: Settings) -> np.ndarray:
    """Places of texts of different labels that may be similar enough, for one key. A pair is given for the first band
    whose key it shares only; bytes don't tell that, as they may agree where keys differ. Labels other than the commonest
    one are compared with everything."""
    names, counts = np.unique(label, return_counts=True)
    if len(names) == 1:
        return np.zeros((0, 2), np.int64)
    s, k = settings.similarity, settings.bands * settings.rows
    least = s - MARGIN * np.sqrt(s * (1 - s) / k)
    odd = label != names[counts.argmax()]
    left, out = np.flatnonzero(odd), []
    step = max(1, (8 << 20) // (len(node) * k))
    for at in range(0, len(left), step):
        i = left[at:at + step]
        same = signature[i][:, None, :] == signature[None, :, :]
        fit = (same.mean(axis=2) >= least) & (label[i][:, None] != label[None, :])
        fit &= np.minimum(size[i][:, None], size[None, :]) >= s * np.maximum(size[i][:, None], size[None, :])
        fit &= ~odd[None, :] | (np.arange(len(node))[None, :] > i[:, None])  # two odd ones only once
        if two_blocks:
            fit &= block[i][:, None] != block[None, :]
        x, y = np.nonzero(fit)
        new = (keys[i[x]] == keys[y]).argmax(axis=1) == band
        out.append(np.stack([i[x[new]], y[new]], axis=1))
    return np.concatenate(out)


GROUP = ["key", "lo", "hi"]


def groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each group in turn, from batches that are sorted by group."""
    held = None
    for part in parts:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        if not len(held):
            continue
        at = held[GROUP].to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
        for x, y in zip(bounds, bounds[1:]):
            yield held.iloc[x:y]
        held = held.iloc[bounds[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def cross_links(rows: DataFrame, members: DataFrame, labels: DataFrame, heads: DataFrame, settings: Settings) -> DataFrame:
    """``a, b, s``: links between texts that share a key and are in different components. Keys with many texts are dealt
    out as pairs of blocks, so that a task holds two blocks at most."""
    placed = members.join(labels, "node", "left").select("key", "band", "node", "size", "n", F.coalesce("label", "node").alias("label"))
    placed = staged(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    halves = F.transform("bands", lambda key: F.shiftright(key, 32).cast("int"))  # 32 bits of a band's key tell it from others
    rest = (placed.where("n > 2").join(mixed.select("key"), "key").join(heads.select("node", "signature", halves.alias("bands")), "node")
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "node", "label", "size", "block", "signature", "bands"))

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The texts that have a partner in their group, the partners listed with one of both."""
        for own in groups(parts):
            node = own["node"].to_numpy()
            signature = np.frombuffer(b"".join(own["signature"]), np.uint8).reshape(len(own), -1)
            first = own.iloc[0]
            pairs = group_pairs(node, own["label"].to_numpy(), own["size"].to_numpy(), own["block"].to_numpy(), signature,
                                np.stack(own["bands"].to_numpy()), int(first["band"]), first["lo"] != first["hi"], settings)
            if len(pairs):
                used = np.unique(pairs)
                partners = [node[pairs[pairs[:, 0] == i, 1]].tolist() for i in used]
                yield pd.DataFrame({"key": first["key"], "lo": first["lo"], "hi": first["hi"], "node": node[used], "partners": partners})

    dealt = rest.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    wanted = staged(dealt.mapInPandas(find, "key long, lo int, hi int, node long, partners array<long>"), "partners")
    ids = staged(wanted.select(F.col("node").alias("nd_node")).distinct(), "wanted")
    texts = staged(rows.join(fits(ids), "nd_node", "left_semi").select(F.col("nd_node").alias("node"), "text"), "texts")
    least, weighting = settings.similarity, settings.weighting

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in groups(parts):
            sets = shingle_sets(own["text"].tolist(), weighting)
            place = {n: i for i, n in enumerate(own["node"].tolist())}
            pairs = [(i, place[p]) for i, ps in enumerate(own["partners"]) for p in ps]
            s = np.array([pair_similarity(sets, i, j) for i, j in pairs])
            node, at = own["node"].to_numpy(), np.array(pairs, np.int64).reshape(-1, 2)[s >= least]
            ends = np.sort(node[at], axis=1)
            yield pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "s": s[s >= least]})

    both = wanted.join(texts, "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    return staged(both.mapInPandas(compare, "a long, b long, s double"), "links")


def classes(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``nd_key, nd_head`` (the node that stands for the class), ``class_id``, ``n_links`` of each distinct text."""
    heads = (rows.where("nd_key is not null").groupBy("nd_key")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("nd_node").alias("node"))).alias("head"),
                  F.any_value("nd_size").alias("size"), F.any_value("nd_bands").alias("bands"), F.any_value("nd_signature").alias("signature")))
    heads = staged(heads.select("nd_key", F.col("head.node").alias("node"), F.col("head.doc_id").alias("doc_id"), "size", "bands", "signature"), "heads")
    postings = heads.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(postings.join(shared, "key"), "members")
    central = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("central"))
    pivots = (members.join(central, "node").groupBy("key").agg(F.max(F.struct("central", -F.col("node"))).alias("top"))
              .select("key", (-F.col("top.col2")).alias("pivot")))
    first = (members.join(pivots, "key").where("node <> pivot")
             .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    first = staged(first, "pairs")
    wanted = staged(members.select("node").distinct(), "wanted")
    texts = staged(rows.join(fits(wanted), rows["nd_node"] == wanted["node"], "left_semi").select("nd_node", "text"), "texts")
    links = verified(first, texts, settings)
    labels = components(links)
    found = cross_links(rows, members, labels, heads, settings)
    if found.limit(1).count():
        links = links.unionByName(found).dropDuplicates(["a", "b"])
        labels = components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = (heads.select("nd_key", "node", "doc_id").join(labels, "node", "left").join(ends, "node", "left")
             .select("nd_key", "node", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    named = staged(named, "named")
    of_class = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("head"))
    return staged(named.join(of_class, "label").select("nd_key", "n_links", F.col("head.node").alias("nd_head"), F.col("head.doc_id").alias("class_id")), "classes")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` of each row: its class, the links of its text to different ones, and whether it
    is the row that stands for the class."""
    rows = signed(docs, settings)
    found = classes(rows, settings)
    got = rows.select("doc_id", "nd_node", F.coalesce("nd_key", F.concat(F.lit("-"), F.col("nd_node").cast("string"))).alias("nd_key"))
    got = got.join(found, "nd_key", "left")
    alone = F.col("nd_head").isNull()
    return got.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("nd_head") == F.col("nd_node"))).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, the one with the smallest id; all columns stay."""
    rows = signed(docs, settings)
    found = classes(rows, settings)
    dropped = (rows.select("nd_key", "nd_node").join(found.select("nd_key", "nd_head"), "nd_key").where("nd_node <> nd_head")
               .select(F.col("nd_node").alias("node")))
    dropped = staged(dropped, "dropped")
    kept = rows.join(fits(dropped), rows["nd_node"] == dropped["node"], "left_anti")
    return kept.select([f"`{c}`" for c in docs.columns if c not in OWN])
