import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rageval.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words_of(rows, every=199):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x)) if near else None
        form = best if best and words[best] >= 5 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


def some_rows(n=120, seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["élèveé", "naïvetés", "Straße", "aaaaaa", "aaaaaaa"]
    common = sorted(stems, key=lambda _: rng.random())[:12]

    def typo(w):
        i, c = rng.randrange(len(w)), rng.choice("aeinrsté")
        return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[::-1]])

    rows = []
    for i in range(n):
        own = [rng.choice(common if rng.random() < 0.7 else stems) for _ in range(60)]
        own = [typo(w) if rng.random() < 0.25 else w.upper() if rng.random() < 0.1 else w for w in own]
        rows.append((i, rng.choice([" ", "\n", ", ", "1"]).join(own)))
    return rows + [rows[0], rows[0], (None, rows[1][1]), (None, None), (n, ""), (n + 1, "x" * 3000 + " " + ("x" * 2999 + " ") * 5 + ("x" * 3000 + "!") * 4)]


@pytest.mark.parametrize("cell", [8, 16_384])
def test_like_brute_force(spark, cell):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    words = spelling.count_words(docs, error_every=7)
    want = words_of(rows, 7)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    got = spelling.variants(words, cell=cell, sample=50).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == brute(want)


def test_roots_of_a_chain(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(13)] + [("x", "w05")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {**{f"w{i:02}": "w13" for i in range(13)}, "x": "w13"}


def test_search_like_all_pairs():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (700, spelling.DIMS)).astype(np.uint8)
    points[:, 5:] = 0
    points = np.concatenate([points, points[:40]])
    far = np.abs(points[:, None, :].astype(int) - points[None, :, :].astype(int)).sum(axis=2)
    for radius in (1, 2):
        got = set(zip(*(x.tolist() for x in spelling.search(spelling.build(points), points, points, radius))))
        assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))
        cells = spelling.cells_of(points[:300], len(points), 40)
        who, home = cells.regions(points, 0, True)
        assert sorted(who.tolist()) == list(range(len(points)))
        home_of = dict(zip(who.tolist(), home.tolist()))
        reach = set(zip(*(x.tolist() for x in cells.regions(points, radius, False))))
        assert all((i, home_of[j]) in reach for i, j in zip(*(x.tolist() for x in np.nonzero(far <= radius))))


def test_no_words(spark, none):
    assert spelling.variants(spelling.count_words(none)).count() == 0
    few = spark.createDataFrame([(1, "short one"), (2, "onlytwice onlytwice")], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(few, error_every=199)).count() == 0
