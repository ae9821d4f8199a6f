import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rageval.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """Turn sequences by conversation, each with the first turns of the first one of its hundred."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = ",".join(str(c) for c in own if len(seqs[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), sum(len(x) == len(node) + 1 for x in below),
                    sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def got(spark, rows, height):
    turns, lengths = trie.rebuilt(trie.turns_of(made(spark, rows)))
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(turns, lengths, height).collect())


def some_rows(n=25, longest=9, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(200, 200 + n), 399, 500]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", None, "assistant"]), rng.choice(["a", "bé", "", None, "long " * 40])))
    rows += [(700, t, "user", "same") for t in range(20)] + [(701, t, "user", "same") for t in range(20)] + [(702, t, "user", "same") for t in range(13)]
    rows += [(800, 1, "user", "tie"), (800, 1, "user", "tie"), (800, 1, "a", "x"), (800, None, "z", "first"), (801, 5, "user", "y" * 100_000)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (902, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 1024])
def test_nodes_like_brute_force(spark, height):
    rows = some_rows()
    assert got(spark, rows, height) == brute(rebuilt(rows))


def test_one_long_sequence_and_a_copy(spark):
    """Sequences of many blocks, one the prefix of the other; totals are grafted over three levels of blocks."""
    rng = random.Random(1)
    turns = [("user", str(rng.randint(0, 9))) for _ in range(90)]
    rows = [(100, i, *t) for i, t in enumerate(turns)] + [(1000, i, *t) for i, t in enumerate(turns[:70] + [("user", "other")])]
    assert got(spark, rows, 4) == brute(rebuilt(rows))


def test_many_copies_of_a_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c * 100, t, "user", f"turn {t}") for c in range(200) for t in range(3)]
    assert got(spark, rows, 1024) == brute(rebuilt(rows))


def test_clashing_columns_and_empty(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    names = "conv_id long, turn long, role string, text string, seq string, d int, j int, a string, last string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], names)
    turns, lengths = trie.rebuilt(trie.turns_of(df))
    assert sorted(tuple(r) for r in trie.prefix_trie(turns, lengths).collect()) == brute(rebuilt(rows))
    turns, lengths = trie.rebuilt(trie.turns_of(df.limit(0)))
    assert trie.prefix_trie(turns, lengths).count() == 0


def test_crc32_in_sql_like_zlib():
    import zlib

    import duckdb

    from rageval.llm.oracles import crc32
    for s in ("", "0", "-17", "12:wörd", "x" * 300):
        assert duckdb.execute(f"SELECT {crc32('s')} FROM (SELECT ?::VARCHAR AS s)", [s]).fetchone()[0] == zlib.crc32(s.encode())
