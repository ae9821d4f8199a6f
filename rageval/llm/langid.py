"""Language identification with language-bitmask n-gram filters.

Training collects, per language, the character n-grams that make up at least ``min_share`` of the language's n-grams,
so no more than ``1 / min_share`` each. All of them go into one bit-sliced Bloom filter: row ``i`` of the bit table
holds one bit per language, and the AND of an n-gram's rows has the bits of all languages that (seem to) contain it.
A text's bits are counted per language. As a share ``p`` of a language's answers is false, ``hits`` of ``n`` n-grams
stand for ``(hits - n * p) / (1 - p)`` true ones; the language with the most wins, ties going to the smaller name.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything when nothing could be
learned. Rows with a null text or lang teach nothing. Texts are read whole. Training takes at most about
``max_train_docs`` documents per language, chosen by a hash of text and id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_crc, python_ready

UNKNOWN = "und"
NGRAM = 4
N_HASHES = 3
MIN_SHARE = 5e-5
MAX_TRAIN_DOCS = 20_000
MAX_LANGUAGES = 1024
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """For each code point its letter in lower case, 0 if it isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_hashes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams' hashes, the index of their texts, and which texts have letters.

    Letters are lowered, all else becomes a space, runs of spaces count as one, and n-grams don't leave their text.
    """
    joined = "".join(f"\0{t or ''} " for t in texts)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letters = letter_codes()[points]
    breaks = np.zeros(len(points), bool)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    breaks[np.cumsum(sizes + 2) - (sizes + 2)] = True
    # a break is the space that opens its text
    keep = (letters != 0) | breaks | np.concatenate([[True], letters[:-1] != 0])
    letters, breaks = letters[keep], breaks[keep]
    text = np.cumsum(breaks) - 1
    has = np.bincount(text, weights=letters != 0, minlength=len(texts))[:len(texts)] > 0
    m = len(letters) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ letters[i:m + i].astype(np.uint64)) * _MIX[i % 4]
        h ^= h >> np.uint64(29)
    inside = text[:m] == text[n - 1:]
    return h[inside], text[:m][inside], has


@dataclass(frozen=True)
class Filter:
    """``bits[i, w]``: row ``i`` of the table, languages ``64 w`` to ``64 w + 63``; ``false_share``: per language."""
    languages: tuple[str, ...]
    bits: np.ndarray
    false_share: np.ndarray
    n: int

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The bitmasks of the languages that contain each n-gram."""
        size, out = np.uint64(len(self.bits) - 1), None
        for seed in _SEEDS:
            at = ((hashes * seed) >> np.uint64(24)) & size
            got = self.bits[at.astype(np.int64)]
            out = got if out is None else out & got
        return out


def build_filter(grams: dict[str, np.ndarray], n: int, bits_per_gram: int = 16) -> Filter:
    """A table whose rows number ``bits_per_gram`` times the largest language's n-grams, rounded up to a power of two."""
    languages = tuple(sorted(grams))
    most = max([len(g) for g in grams.values()], default=1)
    size = 1 << max(6, int(np.ceil(np.log2(max(1, most) * bits_per_gram))))
    bits = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    for k, lang in enumerate(languages):
        for seed in _SEEDS:
            at = ((grams[lang] * seed) >> np.uint64(24)) & np.uint64(size - 1)
            bits[at.astype(np.int64), k // 64] |= np.uint64(1 << (k % 64))
    full = np.array([((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filter(languages, bits, full ** N_HASHES, n)


def train(docs: DataFrame, n: int = NGRAM, min_share: float = MIN_SHARE, max_train_docs: int = MAX_TRAIN_DOCS) -> Filter:
    """Learn from documents that have a language and whose id's crc32 modulo 4 isn't 2."""
    spark = docs.sparkSession
    python_ready(spark)
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (id_crc(docs["doc_id"]) % 4 != 2)).select(
        docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"), docs["doc_id"].alias("doc_id"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return build_filter({}, n)
    picked = [(F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1, max_train_docs / k) * (1 << 30)))
              for lang, k in sorted(counts.items())]
    any_of = picked[0]
    for p in picked[1:]:
        any_of = any_of | p

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's counts, given out whenever they get many."""
        total: dict[str, list] = defaultdict(list)
        held = 0

        def drain():
            for lang, found in total.items():
                h, k = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "k": k})
            total.clear()

        for part in parts:
            for lang, own in part.groupby("lang"):
                h, _, _ = ngram_hashes(own["text"].tolist(), n)
                total[lang].append(h)
                held += len(h)
            if held > 4 << 20:
                yield from drain()
                held = 0
        yield from drain()

    grams = (labelled.where(any_of).select("lang", "text").mapInPandas(count, "lang string, gram long, k long")
             .groupBy("lang", "gram").agg(F.sum("k").alias("k")))
    grams = grams.join(F.broadcast(grams.groupBy("lang").agg(F.sum("k").alias("all"))), "lang").where(F.col("k") >= min_share * F.col("all"))
    found = grams.select("lang", "gram").toPandas()  # at most 1 / min_share rows per language
    return build_filter({lang: own["gram"].to_numpy(np.int64).view(np.uint64) for lang, own in found.groupby("lang")}, n)


def predict(texts: list[str | None], model: Filter) -> pd.DataFrame:
    hashes, text, has = ngram_hashes(texts, model.n)
    k, total = len(model.languages), np.bincount(text, minlength=len(texts)).astype(float)
    if not k or not len(texts):
        return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
    rows = model.rows(hashes)
    true = np.zeros((len(texts), k))
    for j in range(k):
        hit = (rows[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
        hits = np.bincount(text, weights=hit, minlength=len(texts))
        true[:, j] = (hits - total * model.false_share[j]) / (1 - model.false_share[j])
    best = true.argmax(axis=1)
    score = np.clip(true.max(axis=1) / np.maximum(total, 1), 0, 1)
    return pd.DataFrame({"lang_pred": np.where(has, np.array(model.languages, dtype=object)[best], UNKNOWN),
                         "score": np.where(has, score, 0.0)})


#: Characters that are hashed together.
CHUNK_CHARS = 1 << 20


def predictor(model: Filter):
    """A function of a text column that gives ``lang_pred`` and ``score``. The filter goes along; its size is bounded
    by ``min_share``, ``bits_per_gram`` and the number of languages."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, done, chars, got = part.tolist(), 0, 0, []
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= CHUNK_CHARS or i == len(texts) - 1:
                    got.append(predict(texts[done:i + 1], model))
                    done, chars = i + 1, 0
            yield pd.concat(got, ignore_index=True) if got else predict([], model)

    return predicted


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row."""
    python_ready(docs.sparkSession)
    name = free_name(docs, "found")
    return docs.select("doc_id", predictor(model)(docs["text"].cast("string")).alias(name)).select("doc_id", f"{name}.*")


def keep_known(docs: DataFrame, model: Filter, min_score: float = 0.15) -> DataFrame:
    """The documents that are in one of the learned languages, by at least ``min_score``; all columns stay."""
    python_ready(docs.sparkSession)
    name = free_name(docs, "found")
    got = docs.withColumn(name, predictor(model)(docs["text"].cast("string")))
    return got.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= min_score)).drop(name)
