import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rageval.llm import rans, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_pieces_encode_like_whole_texts(path, spaced):
    rng = random.Random(1)
    parts = [" ", " ", "\n", "a", "B", "é", "'s", "1", "%", "\t", "<|endoftext|>", "ß", ".", "the", "Water", ",", "!!", " ", "\x1c", "é", "½", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, " lead", "trail ", "trail\n", "a  b", "日本 語 🙂 🙂"]
    own = tokens.Encoder(path, spaced)
    flat, counts = own.encode(pa.array(texts, pa.string()), 2)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        assert flat[bounds[i]:bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], repr(text)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    own = tokens.Encoder(WORD, False)
    for text in ("one two three four five six", "seven eight one", "two two"):
        got, _ = own.encode(pa.array([text]), 2)
        assert got.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 5000, 700_001])
def test_stream_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 40_000).astype(np.uint32)
    table = rans.Table.from_counts(np.bincount(ids, minlength=3))
    if n:
        assert table.freq.sum() == 1 << rans.PROB_BITS
    lanes = max(1, min(rans.LANES, n))
    stream, places, states = rans.encode_stream(ids, table, lanes)
    assert np.array_equal(rans.decode_stream(stream, n, table, states, places, lanes), ids)
    for k in range(1, len(places)):  # a reader may start at any checkpoint
        assert np.array_equal(rans.decode_stream(stream, n, table, states, places, lanes, first=k), ids[k * rans.CHECKPOINT_STEPS * lanes:])
    if n > 1000:  # near the entropy
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert stream.nbytes < 1.02 * entropy + 8 * lanes


def test_damage_is_noticed():
    ids = np.arange(3000, dtype=np.uint32) % 7
    table = rans.Table.from_counts(np.bincount(ids))
    data = bytearray(rans.encode_block(0, 0, 0, [1, None], np.array([1000, 2000]), ids, table))
    head, body = next(rans.frames(bytes(data)))
    assert np.array_equal(rans.decode_block(head, body, table), ids) and body["null"].tolist() == [0, 1]
    data[-3] ^= 1
    with pytest.raises(ValueError):
        next(rans.frames(bytes(data)))


def expected(rows):
    plain, out, start = Tokenizer.from_file(BYTE), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(odd, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 2000)
    got = rans.round_trip(odd, BYTE).drop("ids").collect()
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_ids_come_back(spark, odd, tmp_path):
    rans.write_corpus(odd, str(tmp_path / "x"), BYTE)
    got = {r["doc_id"]: r["ids"] for r in rans.read_documents(spark, str(tmp_path / "x")).collect()}
    plain = Tokenizer.from_file(BYTE)
    assert got[0] == plain.encode(odd.where("doc_id = 0").first()["text"], add_special_tokens=False).ids + [2]


def test_empty(none):
    assert rans.round_trip(none, BYTE).count() == 0
