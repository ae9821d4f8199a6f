import random
import re
from itertools import combinations

import numpy as np
import pytest

from rageval.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, count):
    words = WORDS.findall((text or "").lower())
    own = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return {s: own.count(s) if count else 1 for s in own}


def jaccard(a, b):
    both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0


def brute(texts, count=False):
    """Class of each text: the smallest number of its component."""
    sets = [shingles(t, count) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def families(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for size in (1, 1, 2, 5, 40):
        base = [word() for _ in range(rng.randint(60, 200))]
        for k in range(size):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 60) if k else 0):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    # a chain whose ends aren't alike, and many texts that share a passage
    chain = [word() for _ in range(100)]
    for k in range(6):
        texts.append(" ".join(chain[3 * k:] + [word() for _ in range(3 * k)]))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_classes_like_brute_force(spark, weighting):
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, neardup.Settings(weighting=weighting)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == brute(texts, weighting == "count")
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_odd_rows(odd):
    rows = odd.collect()
    known = sorted({(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None}, key=lambda r: r[0])
    want = dict(zip([i for i, _ in known], brute([t for _, t in known])))
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["class_id"] == want[r["doc_id"]]
    kept = neardup.keep_one(odd)
    assert kept.columns == [c for c in odd.columns if c != "nd_node"]
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    with_words = [t for t in texts if WORDS.search(t[1] or "")]
    assert len({" ".join(WORDS.findall(t.lower())) for _, t in with_words}) == len(with_words)  # one of each repeated row
    assert {i for i, _ in texts if i is not None} == set(want.values())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(20):
        element = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
        a = rng.random(300) * 6
        b = np.where(rng.random(300) < 0.7, a, rng.random(300) * 6)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = neardup.dart_minhash(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([a, b]), 2, 1024)
        gaps.append((got[0] == got[1]).mean() - true)
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_pair_whose_bytes_agree_in_an_earlier_band(spark):
    """All bytes of the first band agree, but not its keys: the pair meets in the second band and is compared there."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), "quite another text that shares a key"]
    same = np.arange(neardup.BANDS * neardup.ROWS).astype(np.uint8)
    keys = [[1000 * node + band << 32 for band in range(neardup.BANDS)] for node in range(3)]
    for own in keys:
        own[1] = 77
    neardup.python_ready(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "nd_node long, text string")
    members = spark.createDataFrame([(77, node, 50.0, 1, 3) for node in range(3)], "key long, node long, size double, band int, n long")
    labels = spark.createDataFrame([], "node long, label long")
    heads = spark.createDataFrame([(node, bytearray((same if node < 2 else 255 - same).tobytes()), keys[node]) for node in range(3)],
                                  "node long, signature binary, bands array<long>")
    got = neardup.cross_links(rows, members, labels, heads, neardup.Settings()).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1)]


def test_empty(none):
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one(none).count() == 0
