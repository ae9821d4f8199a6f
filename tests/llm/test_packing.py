import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rageval.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, sequence):
    plain = Tokenizer.from_file(WORD)
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(plain.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= sequence
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    for (doc_id, ids), n in want.items():
        starts = sorted({r["start"] for r in by_doc[doc_id] if r["doc_tokens"] == len(ids)})
        assert starts[0] == 0
        for (d, start, length, crc, total), k in pieces.items():
            if d == doc_id and total == len(ids) and doc_id is not None:
                assert zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc
        if doc_id is not None:
            assert sum(r["length"] for r in by_doc[doc_id] if r["doc_tokens"] == len(ids)) == n * len(ids)
    return by_sequence


def test_every_id_once(odd):
    got = packing.pack(odd, WORD, sequence=256, unit=8).collect()
    by_sequence = check(got, [(r["doc_id"], r["text"]) for r in odd.collect()], 256)
    total = sum(r["length"] for r in got)
    assert len(by_sequence) * 256 < 1.12 * total + 256


def test_sequences_hold_the_ids(odd):
    packed = packing.pack(odd, WORD, sequence=512)
    got = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert sum(r["length"] for r in got) == packed.agg({"length": "sum"}).first()[0]


def test_empty(none):
    assert packing.pack(none, WORD).count() == 0


def test_linear_program_reaches_the_bound():
    # three of 3 and two of 4 fill ten and eight; the optimum is known: patterns (2, 1) and (0, 2) of room 10
    patterns, uses = packing.solve_cutting_stock(np.array([3, 4]), np.array([20.0, 15.0]), 10, gap=1e-9)
    assert np.all(patterns @ np.array([3, 4]) <= 10)
    assert np.all(uses @ patterns >= np.array([20, 15]) - 1e-6)
    assert abs(uses.sum() - 12.5) < 1e-6


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        weight, value, room = np.sort(rng.choice(np.arange(1, 12), 4, replace=False)), rng.random(4), 17
        best, pattern = packing.best_pattern(value, weight, room)
        table = [0.0] * (room + 1)
        for c in range(1, room + 1):
            table[c] = max([table[c - 1], *(table[c - w] + v for w, v in zip(weight, value) if w <= c)])
        assert abs(best - table[room]) < 1e-9 and pattern @ weight <= room and abs(pattern @ value - best) < 1e-9


def test_little_padding_whatever_the_lengths():
    rng = np.random.default_rng(3)
    for lengths in ([2100] * 500, rng.integers(1, 4095, 3000), rng.lognormal(6.3, 1.1, 5000).clip(1, 4095).astype(int), [1500] * 3, []):
        histogram = Counter((-(-int(n) // 8) for n in lengths))
        plan = packing.make_plan(dict(histogram), 0, 512)
        used = defaultdict(int)
        for c, n in histogram.items():
            for rank in range(n):
                for where, length in packing.place(plan, c, rank, c * 8, 512, 8):
                    used[where] += length
        assert all(0 < n <= 4096 for n in used.values())
        assert sorted(used) == list(range(plan.full_sequence))
        total = sum(c * 8 * n for c, n in histogram.items())
        assert len(used) * 4096 <= total * 1.016 + 4096
