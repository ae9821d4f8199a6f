"""Token ids of whole texts, each distinct word encoded once.

Both vocabularies used here never let a token cross from a non-space into a space, so a text's ids are those of its
pieces between spaces in turn. Pieces repeat a lot: a batch's distinct pieces are encoded, and a worker remembers
them. Nor does a token cross from letters into punctuation: a word with punctuation at its end is put together of both,
and a word of Latin letters, which no normalisation or division changes, goes to the merges directly. Where a text has runs of white space, in which the byte vocabulary's tokens do depend on their neighbours, the
text is encoded as a whole. Tests compare both ways.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation, twice as many for byte vocabularies, whose words cost more to encode. Beyond, a worker begins a new one, into which pieces of the one before move when they come up;
#: what doesn't come up in a whole generation is forgotten.
REMEMBERED = 250_000
#: Characters encoded together.
CHUNK_CHARS = 4 << 20


#: Latin letters and then ASCII punctuation, if any.
WORDLIKE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-^`{-~]*)")


def byte_characters() -> dict[int, int]:
    """What byte vocabularies write for each byte: printable ones of Latin-1 as they are, the others as the characters
    from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


CHARACTERS = byte_characters()
SPACE = chr(CHARACTERS[0x20])


class Encoder:
    """Encodes texts with one vocabulary file; ``spaced``: a piece carries the space before it, as in byte vocabularies."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), array("q", [0]), 0
        self.new_generation()

    def new_generation(self) -> None:
        self.old, self.old_ids, self.old_starts = self.known, self.ids[:self.used], np.array(self.starts)
        self.known = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), array("q", [0]), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in got]

    def learn(self, keys: list[str], texts: list[str]) -> None:
        for at in range(0, len(keys), 20_000):
            got = self.tokenizer.encode_batch_fast(texts[at:at + 20_000], add_special_tokens=False)
            self.remember(keys[at:at + 20_000], [x.ids for x in got])

    def merge(self, word: str) -> list[int]:
        """The ids of a word of Latin letters, with the space before it if it has one."""
        chars = word if self.spaced else word.lower()
        if not chars.isascii():
            chars = chars.encode().decode("latin-1").translate(CHARACTERS)
        if self.spaced:
            chars = SPACE + chars
        return [x.id for x in self.merges(chars)]

    def remember(self, keys: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.store(keys, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    def recall(self, keys: list[str]) -> None:
        """Move pieces of the generation before into this one."""
        place = np.fromiter(map(self.old.__getitem__, keys), np.int64, len(keys))
        begin, sizes = self.old_starts[place], np.diff(self.old_starts)[place]
        ends = np.cumsum(sizes)
        self.store(keys, self.old_ids[np.arange(int(sizes.sum())) + np.repeat(begin - (ends - sizes), sizes)], sizes)

    def store(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(flat)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(need, len(self.ids)), np.uint32)])
        self.ids[self.used:need] = flat
        self.known.update(zip(keys, range(len(self.starts) - 1, len(self.starts) - 1 + len(keys))))
        self.starts.frombytes((self.used + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.used = need

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The places of the pieces in memory, after new ones have been encoded or put together."""
        if len(self.known) > (2 if self.spaced else 1) * REMEMBERED:
            self.new_generation()
        known, old, space = self.known, self.old, " " if self.spaced else ""
        words: set[str] = set()
        back: set[str] = set()  # pieces of the generation before
        single: dict[str, str] = {}  # what is encoded, by its key; punctuation has the key "\0" and itself
        double = []
        for p in pieces:
            if p not in known:
                if p in old:
                    back.add(p)
                    continue
                m = WORDLIKE.fullmatch(p)
                if not m:
                    single[p] = space + p
                    continue
                word, end = m.groups()
                if word not in known:
                    (back if word in old else words).add(word)
                if end:
                    end_key = "\0" + end
                    double.append((p, word, end_key))
                    if end_key in old and end_key not in known:
                        back.add(end_key)
                    elif end_key not in known:
                        single[end_key] = end
        self.recall(list(back))
        self.learn(list(single), list(single.values()))
        new = list(words)
        self.remember(new, [self.merge(w) for w in new])
        if double:
            flat, starts = memoryview(self.ids), self.starts

            def ids(key):
                i = known[key]
                return flat[starts[i]:starts[i + 1]].tolist()

            self.remember([p for p, _, _ in double], [ids(word) + ids(end) for _, word, end in double])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and the number of ids of each text. Nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not self.spaced:  # such vocabularies drop white space, so a line's end is as good as a space
            texts = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        whole: dict[int, np.ndarray] = {}
        if self.spaced:
            trimmed = pc.binary_length(pc.utf8_trim_whitespace(coded.dictionary))
            size = pc.binary_length(coded.dictionary)
            odd = pc.or_(pc.equal(size, 0), pc.not_equal(size, trimmed)).to_numpy(zero_copy_only=False)
            bad = np.flatnonzero(np.add.reduceat(odd[code], offsets[:-1]) > 0) if n else []
            whole = dict(zip(map(int, bad), self.whole([texts[int(i)].as_py() for i in bad])))
            first = [i for i in range(n) if i not in whole]
            heads = dict(zip(first, self.whole([pieces[code[offsets[i]]] for i in first])))
        gc.disable()  # many small lists come and go, none of them in a cycle
        place = self.numbers(pieces)
        gc.enable()
        starts = np.frombuffer(self.starts, np.int64).copy()
        begin, size = starts[place][code], np.diff(starts)[place][code]
        if self.spaced:
            doc = np.repeat(np.arange(n), np.diff(offsets))
            skip = np.zeros(n, bool)
            skip[list(whole)] = True
            size[skip[doc]] = 0
            size[offsets[:-1]] = 0
        # gather the pieces' ids in turn, leaving room for what was encoded apart and for the end
        total = np.add.reduceat(size, offsets[:-1]) if n else np.zeros(0, np.int64)
        extra = np.zeros(n, np.int64)
        if self.spaced:
            for i, x in (*whole.items(), *heads.items()):
                extra[i] = len(x)
        counts = total + extra + 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(bounds[-1]), np.uint32)
        ends = np.cumsum(size)
        source = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(begin - (ends - size), size)
        body = np.arange(len(source), dtype=np.int64) + np.repeat(bounds[:-1] + extra - (np.cumsum(total) - total), total)
        out[body] = self.ids[source]
        if self.spaced:
            for i, x in (*whole.items(), *heads.items()):
                out[bounds[i]:bounds[i] + len(x)] = x
        out[bounds[1:] - 1] = end
        return out, counts


@lru_cache(2)
def encoder(path: str, spaced: bool) -> Encoder:
    return Encoder(path, spaced)


def chunks(batches: Iterator[pa.RecordBatch], text: str, size_: int | None = None) -> Iterator[pa.Table]:
    """Batches put together or cut so that each has about ``size_`` bytes of text, or a single row."""
    most = size_ or CHUNK_CHARS
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        done = 0
        for cut in [*(np.flatnonzero(np.diff((size + np.cumsum(lengths)) // most)) + 1), len(lengths)]:
            held.append(batch.slice(done, int(cut) - done))
            done = int(cut)
            if done < len(lengths):
                yield pa.Table.from_batches(held)
                held = []
        size = (size + int(lengths.sum())) % most if len(lengths) else size
    if held:
        yield pa.Table.from_batches(held)
