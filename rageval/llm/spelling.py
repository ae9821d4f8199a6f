"""Spelling variants by k-d trees over letter counts.

Words are counted in Spark. One edit moves a word's vector of letter counts by an L1 distance of two at most (a
replaced letter) or of one (a letter more). So the words of each length are the points of a k-d tree, which words of
the same length search within two and words that are one letter shorter within one; boxes that lie farther are pruned,
and the letters of the points that are left are compared in order.

A length's tree is cut at the top into cells of about ``CELL`` words by splits found on ``SAMPLE`` of its words (that
concerns the balance only). Each word goes to its own cell as a point, and as a query to every cell whose region is near
enough; a task builds the tree of one cell as flat arrays and streams the queries past it.

Of a word's near words, the commonest is its form if it is commoner by ``RATIO``; forms of forms lead to the root, found
by doubling.

Defined cases: a null or empty text has no words; a null id counts as an empty one; copies of rows count again; very
long runs of letters are words like others (counts over 255 of a letter count as 255, which can only bring vectors
nearer); no words give no rows; further columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, staged
from .tokens import chunks

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Fixed values of the query's stand-in for typing errors: one run of 199 loses a letter, told by a hash of document and run.
ERROR_EVERY = 199
#: Words of a cell, about, and of a sample that cells are cut by; of a leaf.
CELL, SAMPLE, LEAF = 16_384, 8_192, 24
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Queries searched together.
AT_ONCE = 8_192
#: Dimensions: a to z have their own, other letters share the rest.
DIMS = 32
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, error_every: int | None = None) -> DataFrame:
    """``word, n, length``: runs of letters in lower case, of at least so many letters and occurrences; written. Every
    ``error_every``-th run of a document, by a hash, loses a letter first."""
    python_ready(docs.sparkSession)
    shortest = least_letters
    run = re.compile(rf"(?<![a-zÀ-ÿ])[a-zÀ-ÿ]{{{shortest},}}")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()

        for part in chunks(batches, "text"):
            for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                own = Counter(run.findall(text.encode().lower().decode()))  # bytes change A-Z only
                if error_every:
                    start = crc32(f"{id_}:".encode())
                    hit = [w for w in own if crc32(w.encode(), start) % error_every == 0]
                    for word, n in [(w, own.pop(w)) for w in hit]:  # all go before any comes back shorter
                        at = crc32(word.encode(), start) % len(word)
                        if len(word) > shortest:
                            own[word[:at] + word[at + 1:]] += n
                for word, n in own.items():
                    held[word] += n
                if len(held) > COUNTED:
                    yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return staged(counts.withColumn("length", F.char_length("word")), "words")


def letters(words: list[str]) -> np.ndarray:
    """Rows of codes, all words being of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Counts of letters by dimension, at most 255; a few letters at a time, whatever the words' length."""
    out = np.zeros((len(codes), DIMS), np.int64)
    rows = np.arange(len(codes))
    for at in range(codes.shape[1]):
        out[rows, _DIM[codes[:, at]]] += 1
    return np.minimum(out, 255).astype(np.uint8)


@dataclass
class Tree:
    """Nodes in flat arrays: tight boxes, the points' span in ``order``, and children (0: a leaf)."""
    lo: np.ndarray
    hi: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    order: np.ndarray


def split(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension of most spread that can be cut, and the largest count of its lower half."""
    spread = points.var(axis=0)
    for dim in np.argsort(-spread, kind="stable"):
        if spread[dim] == 0:
            return None
        values = np.sort(points[:, dim])
        cut = int(values[(len(values) - 1) // 2])
        if cut == values[-1]:
            cut = int(values[np.searchsorted(values, cut) - 1])
        return int(dim), cut
    return None


def build(points: np.ndarray) -> Tree:
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        own = points[order[begin:end]]
        node = [own.min(axis=0), own.max(axis=0), begin, end, [0, 0]]
        if parent >= 0:
            nodes[parent][4][side] = len(nodes)
        nodes.append(node)
        found = split(own) if end - begin > LEAF else None
        if found:
            low = own[:, found[0]] <= found[1]
            order[begin:end] = np.concatenate([order[begin:end][low], order[begin:end][~low]])
            middle = begin + int(low.sum())
            todo += [(begin, middle, len(nodes) - 1, 0), (middle, end, len(nodes) - 1, 1)]
    lo, hi, begin, end, child = zip(*nodes)
    return Tree(np.array(lo), np.array(hi), np.array(begin), np.array(end), np.array(child), order)


def box_distance(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """L1 distances of points to a box; all are bytes, and differences taken where they are positive only."""
    return ((np.maximum(points, lo) - points) + (points - np.minimum(points, hi))).sum(axis=1, dtype=np.int32)


def search(tree: Tree, points: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and points within the radius, by L1 distance."""
    left, right, todo = [], [], [(0, np.arange(len(asked)))]
    while todo:
        node, who = todo.pop()
        who = who[box_distance(asked[who], tree.lo[node], tree.hi[node]) <= radius]
        if not len(who):
            continue
        if tree.child[node, 0]:
            todo += [(int(c), who) for c in tree.child[node]]
            continue
        own = tree.order[tree.begin[node]:tree.end[node]]
        step = max(1, (1 << 20) // len(own))
        for at in range(0, len(who), step):
            some = who[at:at + step]
            x, y = asked[some][:, None, :], points[own][None, :, :]
            near = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=2, dtype=np.int32) <= radius
            i, j = np.nonzero(near)
            left.append(some[i])
            right.append(own[j])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether two rows of codes differ by one replaced letter or, if the second is longer, by one more letter there."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    n = short.shape[1]
    prefix = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    suffix = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return prefix + suffix >= n


@dataclass
class Cells:
    """The top of a length's tree: inner nodes (dimension, largest lower count, children) by number; a leaf's number is
    negative and tells its cell."""
    nodes: list[tuple[int, int, int, int]]
    first: int
    count: int

    def regions(self, asked: np.ndarray, radius: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the cells whose region is within the radius; with ``home`` only the cell that each lies in. Distances
        to a region are sums, over dimensions, of the distance to the farthest side passed."""
        out_q, out_c, todo = [], [], [(self.first, np.arange(len(asked)), np.zeros((len(asked), DIMS), np.uint8))]
        while todo:
            at, who, gap = todo.pop()
            if at < 0:
                out_q.append(who)
                out_c.append(np.full(len(who), -at - 1))
                continue
            dim, cut, low, high = self.nodes[at]
            value = asked[who, dim].astype(np.int64)
            for child, beyond in ((low, np.maximum(value - cut, 0)), (high, np.maximum(cut + 1 - value, 0))):
                g = gap.copy()
                g[:, dim] = np.maximum(g[:, dim], np.minimum(beyond, 255))
                keep = g.sum(axis=1, dtype=np.int32) <= (0 if home else radius)
                if keep.any():
                    todo.append((child, who[keep], g[keep]))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *out_q]), np.concatenate([empty, *out_c])


def cells_of(sample: np.ndarray, n: int, cell: int) -> Cells:
    """Cells of about ``cell`` of the n words that the sample stands for, cut by the rule of the tree."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def cut(own: np.ndarray, share: float) -> int:
        nonlocal count
        found = split(own) if share > cell and len(own) > 1 else None
        if found is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append(None)  # type: ignore[arg-type]
        low = own[:, found[0]] <= found[1]
        nodes[at] = (*found, cut(own[low], share * low.mean()), cut(own[~low], share * (1 - low.mean())))
        return at

    first = cut(sample, float(n))
    return Cells(nodes, first, count)


def cut_cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Cells]:
    """The cells of each length. The driver gets a row a length and, of lengths with several cells, ``sample`` words."""
    sizes = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [k for k, n in sizes.items() if n > cell]
    by_hash = Window.partitionBy("length").orderBy(F.xxhash64("word"), "word")
    some = words.where(F.col("length").isin(large)).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= sample)
    samples: dict[int, list[str]] = {k: [] for k in large}
    for r in some.select("length", "word").collect():
        samples[r["length"]].append(r["word"])
    none = np.zeros((0, DIMS), np.uint8)
    return {k: cells_of(vectors(letters(samples[k])) if k in samples else none, n, cell) for k, n in sizes.items()}


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``word, other, other_n``: each word with each other one that differs by one edit, from both sides; written.
    ``words``: ``word, n, length``, written already."""
    python_ready(words.sparkSession)
    cells = cut_cells(words, cell, sample)
    bases = dict(zip(sorted(cells), np.cumsum([0, *[cells[k].count for k in sorted(cells)]]).tolist()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                points = vectors(letters(own.column("word").to_pylist()))
                who, home = cells[length].regions(points, 0, True)
                parts = [(0, who, bases[length] + home)]
                q, c = cells[length].regions(points, 2, False)
                at_home = np.empty(len(points), np.int64)
                at_home[who] = home
                parts.append((1, q[c != at_home[q]], bases[length] + c[c != at_home[q]]))
                if length + 1 in cells:
                    q, c = cells[length + 1].regions(points, 1, False)
                    parts.append((2, q, bases[length + 1] + c))
                for kind, q, c in parts:
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.full(len(q), kind), pa.int32()), own.column("word").take(pa.array(q)),
                                                          own.column("n").take(pa.array(q))], names=["cell", "kind", "word", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = -1, [], None
        points = codes = names = counts = None

        def found(asked: list[str], n: np.ndarray, shorter: bool, same: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(asked), AT_ONCE):
                some, own_n = asked[at:at + AT_ONCE], n[at:at + AT_ONCE]
                own = letters(some)
                i, j = search(tree, points, vectors(own), 1 if shorter else 2)
                if same:
                    i, j = i[i + at != j], j[i + at != j]
                for k in range(0, len(i), 1 << 18):
                    a, b = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
                    good = one_edit(own[a], codes[b])
                    a, b = pa.array(a[good]), pa.array(b[good])
                    x, y, x_n, y_n = pa.array(some, pa.string()).take(a), names.take(b), pa.array(own_n).take(a), counts.take(b)
                    yield pa.RecordBatch.from_arrays([x, y, y_n], names=["word", "other", "other_n"])
                    if shorter:
                        yield pa.RecordBatch.from_arrays([y, x, x_n], names=["word", "other", "other_n"])

        for batch in batches:
            kinds, place = batch.column("kind").to_numpy(), batch.column("cell").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (place[1:] != place[:-1])])) if len(kinds) else []
            for a, b in zip(new, [*new[1:], len(kinds)]):
                own = batch.slice(int(a), int(b - a))
                if place[a] != now:
                    if held:  # a cell without queries of other cells
                        points, codes, names, counts, tree = ready(held)
                        yield from found(names.to_pylist(), counts.to_numpy(), False, True)
                    now, held, tree = int(place[a]), [], None
                if kinds[a] == 0:
                    held.append(own)
                    continue
                if held:
                    points, codes, names, counts, tree = ready(held)
                    yield from found(names.to_pylist(), counts.to_numpy(), False, True)
                    held = []
                if tree is not None:
                    yield from found(own.column("word").to_pylist(), own.column("n").to_numpy(), bool(kinds[a] == 2), False)
        if held:
            points, codes, names, counts, tree = ready(held)
            yield from found(names.to_pylist(), counts.to_numpy(), False, True)

    dealt = words.mapInArrow(route, "cell int, kind int, word string, n long").repartition("cell").sortWithinPartitions("cell", "kind")
    return staged(dealt.mapInArrow(compare, "word string, other string, other_n long"), "near-words")


def ready(held: list[pa.RecordBatch]):
    """Points, codes, words, counts and the tree of a cell."""
    own = pa.Table.from_batches(held).combine_chunks()
    names, counts = own.column("word").combine_chunks(), own.column("n").combine_chunks()
    codes = letters(names.to_pylist())
    points = vectors(codes)
    return points, codes, names, counts, build(points)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed to the last, each round twice as far. A form is commoner than
    its word by a factor, so there are few rounds."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = staged(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = far.select("word", "root")
        if not far.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = RATIO, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``count_words``."""
    best = F.min(F.struct((-F.col("other_n")).alias("least"), "other"))
    near = staged(near_words(words, cell, sample).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    own = words.select("word", "n").join(near, "word", "left")
    right = -F.col("best.least") >= ratio * F.col("n")
    own = staged(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(right, F.col("best.other")).alias("form"),
                            F.when(right, -F.col("best.least")).alias("form_n")), "forms")
    last = roots(own.where("form is not null"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
