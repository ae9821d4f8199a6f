"""Line-first cleaning.

Each line is judged on its own by punctuation, navigation and boilerplate rules; failing lines are removed. A document
is then rejected if too much of its text went with them. ``base_failed`` covers what lines can't show: fewer words
than ``min_words``, or too many words inside repeated eight-word windows.

Defined cases: a null text has no lines, no words, and fails; an empty line is kept and counts for nothing; a document
all of whose words are in failing lines is rejected. Whole texts are read, of any length; ties don't arise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, python_ready

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Separators that menus put between their entries.
MENU = re.compile(r"[|»›•·]|::|>>|\s>\s|\s/\s")
SHOUT = re.compile(r"[!?]{2,}")
#: Marks that divide sentences and their parts.
PAUSE = re.compile(r"[.!?…:;,。！？、，]")
#: Fixed phrases of page furniture, in lower case.
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "uses cookies", "use of cookies", "enable javascript",
    "javascript is disabled", "terms of use", "terms of service", "terms and conditions", "privacy policy",
    "sign in to", "log in to", "subscribe to our newsletter", "click here", "read more", "share this",
    "skip to content", "back to top", "lorem ipsum", "licensed under the", "copyright (c)", "copyright ©")
BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)))
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_share: float = 0.1
    max_menu_share: float = 0.15
    max_shout_share: float = 0.25
    max_upper_share: float = 0.6
    min_upper_words: int = 5
    unpaused_words: int = 40
    max_lost: float = 0.3


def line_fails(line: str, n_words: int, n_chars: int, rules: Rules) -> bool:
    """The verdict on one line that has words; ``n_chars`` are its characters within words."""
    if len(SYMBOL.findall(line)) > rules.max_symbol_share * n_chars:
        return True
    if len(MENU.findall(line)) > rules.max_menu_share * n_words:
        return True
    if len(SHOUT.findall(line)) > rules.max_shout_share * n_words:
        return True
    if n_words >= rules.min_upper_words:
        upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
        if upper > rules.max_upper_share * (upper + lower):
            return True
    if n_words >= rules.unpaused_words and not PAUSE.search(line):
        return True
    return BOILERPLATE.search(line.lower()) is not None


def codes(values) -> tuple[np.ndarray, int]:
    got, uniques = pd.factorize(values)
    return got.astype(np.int64), len(uniques)


def repeated_words(words: list[str], ends: np.ndarray) -> np.ndarray:
    """Per document, the words that lie in an eight-word window found at least twice in it.

    ``words`` are those of all documents in turn, ``ends`` the running numbers of words. Windows get exact codes by
    doubling: pairs of words, pairs of pairs, pairs of those.
    """
    out, n = np.zeros(len(ends), np.int64), len(words)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    code, k = codes(np.array(words, dtype=object))
    step = 1
    while step < WINDOW:
        code, k = codes(code[:-step] * k + code[step:])
        step *= 2
    at = np.flatnonzero(doc[:n - WINDOW + 1] == doc[WINDOW - 1:])
    if not len(at):
        return out
    own, _ = codes(code[at] * len(ends) + doc[at])
    at = at[np.bincount(own)[own] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return np.bincount(doc, weights=np.cumsum(edge)[:n] > 0, minlength=len(ends)).astype(np.int64)


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "lost_chars long, kept boolean, clean_text string")


def judge(texts: list[str | None], rules: Rules, with_text: bool) -> pd.DataFrame:
    """Counts, verdict and cleaned text of each document."""
    words: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    rows = []
    for i, text in enumerate(texts):
        n_words = word_chars = lost = n_lines = 0
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            own = WORDS.findall(line)
            if not own:
                kept.append(line)
                continue
            n_lines += 1
            seen.add(line)
            chars = sum(map(len, own))
            n_words += len(own)
            word_chars += chars
            words += own
            if line_fails(line, len(own), chars, rules):
                lost += chars
            elif with_text:
                kept.append(line)
        ends[i] = len(words)
        n_symbols = sum(map((text or "").count, SYMBOLS))
        rows.append((n_words, word_chars, n_symbols, n_lines - len(seen), lost, "\n".join(kept) if with_text else None))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "lost_chars", "clean_text"])
    out["n_repeat_words"] = repeated_words(words, ends)
    out["base_failed"] = (out.n_words < rules.min_words) | (100 * out.n_repeat_words > rules.max_repeat_percent * out.n_words)
    out["kept"] = ~out.base_failed & (out.lost_chars <= rules.max_lost * out.word_chars)
    return out[[f.split()[0] for f in FIELDS.split(", ")]]


#: Characters that are judged together; their words are held at once.
CHUNK_CHARS = 2 << 20


def verdict(rules: Rules = Rules(), with_text: bool = True):
    """A function of a text column that gives a struct of :data:`FIELDS`."""

    @F.pandas_udf(FIELDS)
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, done, chars, got = part.tolist(), 0, 0, []
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= CHUNK_CHARS or i == len(texts) - 1:
                    got.append(judge(texts[done:i + 1], rules, with_text))
                    done, chars = i + 1, 0
            yield pd.concat(got, ignore_index=True) if got else judge([], rules, with_text)

    return judged


def score_documents(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """``doc_id`` and the fields of each row."""
    python_ready(docs.sparkSession)
    name = free_name(docs, "judged")
    return docs.select("doc_id", verdict(rules, with_text)(docs["text"].cast("string")).alias(name)).select("doc_id", f"{name}.*")


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their failing lines removed; other columns stay, ``n_chars`` follows the text."""
    python_ready(docs.sparkSession)
    name = free_name(docs, "judged")
    got = docs.withColumn(name, verdict(rules)(docs["text"].cast("string"))).where(F.col(name)["kept"])
    return got.select([_field(docs, c, name) for c in docs.columns])


def _field(docs: DataFrame, c: str, name: str) -> Column:
    text = F.col(name)["clean_text"]
    if c == "text":
        return text.alias(c)
    if c == "n_chars":
        return F.char_length(text).cast(docs.schema[c].dataType).alias(c)
    return F.col(f"`{c}`")
