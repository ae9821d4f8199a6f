"""Column expressions shared by every operator (scalar functions X1-X20).

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the semantics being reproduced).
# Python's ``str.split()`` with no argument splits on these code points
# (the characters for which ``str.isspace()`` is true).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regular-expression class (used by the SQL oracle).
PY_WHITESPACE_CLASS = "[" + "".join("\\x{%x}" % ord(c) for c in PY_WHITESPACE) + "]+"
# "Standard analyzer" approximation: lower-cased runs of letters and digits.
STD_TOKEN_PATTERN = r"[\p{L}\p{N}]+"
STD_GAP_PATTERN = r"[^\p{L}\p{N}]+"
# Unicode text segmentation (UAX 29): characters that join two letters, two digits, or either; WordBreak classes MidLetter,
# MidNum, and MidNumLet with the single quote.
MID_LETTER = ":\u00b7\u0387\u055f\u05f4\u2027\ufe13\ufe55\uff1a"
MID_NUMBER = ",;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b"
MID_EITHER = ".'\u2018\u2019\u2024\ufe52\uff07\uff0e"
# Strings that pandas' ``read_csv`` turns into NaN by default.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null")
# Few-shot label text.
LABEL_YES = "[[Yes]]"
LABEL_NO = "[[No]]"
# Answer-prompt template and the sentinel document of the consensus retriever.
PROMPT_QUERY = "Query: "
PROMPT_DOCUMENT = "\nDocument: "
PROMPT_ANSWER = "\nAnswer:"
SYSTEM_PROMPT = ("You are an expert assistant specialized in answering questions based on provided documents. Given a query and a set "
                 "of documents, provide the most relevant and concise answer based on the content of the documents.")
SENTINEL_DOCUMENT = "No Relevant Information Available"
DEFAULT_FAILED_ANSWER = "No answer generated due to an error or content filtering."
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_tokens(text) -> Column:
    """Whitespace tokens, case kept, no empty tokens (``str.split()``).

    Every whitespace code point is mapped to a space with ``translate`` and
    the text is split on that single character; no regular expression runs.
    """
    spaced = F.translate(_c(text), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text) -> Column:
    """Number of whitespace tokens; null text gives null (and so fails filters)."""
    return F.size(ws_tokens(text))


def more_words_than(text, n: int) -> Column:
    """``word_count(text) > n``, read no further than the word that decides it; null for a null text."""
    if n < 0:
        return word_count(text) > n
    word = f"[!-~{PY_WHITESPACE_CLASS[:-1].replace('[', '[^')}]++"  # ASCII first: no other character of the class is compared with one
    return _c(text).rlike(rf"^{PY_WHITESPACE_CLASS[:-1]}*+(?:{word}{PY_WHITESPACE_CLASS}+){{{n}}}{word}")


def std_tokens(text) -> Column:
    """Lower-cased letter/digit runs: what lies between the other characters, which is found in about half the time."""
    return F.array_remove(F.split(F.lower(_c(text)), STD_GAP_PATTERN), "")


# Joiners in a row within one token, and changes between letters, digits and underscores; what follows is the next token.
MAX_JOINS, MAX_CHANGES = 127, 64


def _boundary_pattern() -> str:
    """Runs of letters, of digits and of connecting punctuation, in any order; letters go on over a joiner between letters,
    digits over one between digits. Han and Hiragana characters stand alone, Katakana makes runs. Quantifiers are
    possessive and bounded, so that no text needs deep recursion or backtracking."""
    ext, alone, kana = r"\p{M}\p{Cf}", r"\p{IsHan}\p{IsHiragana}", r"\p{IsKatakana}\u30fc"
    letter = rf"\p{{L}}\p{{Nl}}{{}}&&[^{alone}{kana}]"
    letters = f"[{letter.replace('{}', '')}][{letter.replace('{}', ext)}]*+"
    digits = rf"\p{{Nd}}[\p{{Nd}}{ext}]*+"
    joined = [rf"{run}(?:[{mid}{MID_EITHER}][{ext}]*+{run}){{0,{MAX_JOINS}}}+" for run, mid in ((letters, MID_LETTER), (digits, MID_NUMBER))]
    return rf"(?:{joined[0]}|{joined[1]}|\p{{Pc}}[\p{{Pc}}{ext}]*+){{1,{MAX_CHANGES}}}+|[{kana}][{kana}{ext}]*+|[{alone}][{ext}]*+"


BOUNDARY_TOKEN_PATTERN = _boundary_pattern()


def boundary_tokens(text) -> Column:
    """Lower-cased words by Unicode word boundaries: "don't", "3.14" and "snake_case" are one token each.

    Not covered: quotes within Hebrew words, Katakana next to underscores, emoji (dropped). A null text gives null."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(BOUNDARY_TOKEN_PATTERN), 0)
    return F.filter(found, lambda t: t.rlike(r"[\p{L}\p{Nl}\p{Nd}]"))


def is_blank(text) -> Column:
    """Null, or nothing but whitespace."""
    c = _c(text)
    return c.isNull() | (F.size(ws_tokens(c)) == 0)


def safe_div(num, den) -> Column:
    """``num / den`` when ``den > 0`` else 0.0 (ANSI mode raises on /0)."""
    n, d = _c(num), _c(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def f1(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when((p + r) > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def reciprocal_rank(rank, rank_constant: int) -> Column:
    """``1 / (k + rank)``."""
    return F.lit(1.0) / (F.lit(float(rank_constant)) + _c(rank).cast("double"))


def bm25_okapi_idf(n_docs, df) -> Column:
    """Raw Okapi idf ``ln(N - df + 0.5) - ln(df + 0.5)`` (may be negative)."""
    n, d = _c(n_docs).cast("double"), _c(df).cast("double")
    return F.log(n - d + 0.5) - F.log(d + 0.5)


def bm25_plus_one_idf(n_docs, df) -> Column:
    """Non-negative idf ``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    n, d = _c(n_docs).cast("double"), _c(df).cast("double")
    return F.log(1.0 + (n - d + 0.5) / (d + 0.5))


def bm25_term(idf, tf, dl, avgdl, k1: float, b: float) -> Column:
    """``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))``."""
    tf_ = _c(tf).cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * _c(dl).cast("double") / _c(avgdl))
    return _c(idf) * tf_ * F.lit(k1 + 1.0) / (tf_ + norm)


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0),
                              lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives 0, not NaN."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def prompt(query, document) -> Column:
    """X11: ``Query: …\\nDocument: …\\nAnswer:``."""
    return F.concat(F.lit(PROMPT_QUERY), _c(query), F.lit(PROMPT_DOCUMENT), _c(document),
                    F.lit(PROMPT_ANSWER))


def normalise_null_text(c) -> Column:
    """Turn pandas' default NA strings into SQL NULL (exact match, as pandas does)."""
    c = _c(c)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_yes_no(c) -> Column:
    """``[[Yes]]`` -> 1, ``[[No]]`` -> 0, anything else null."""
    t = F.trim(_c(c))
    return (F.when(t == F.lit(LABEL_YES), F.lit(1))
            .when(t == F.lit(LABEL_NO), F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def label_to_int(c) -> Column:
    """Null-token filter then integer cast; numbers and yes/no labels accepted."""
    t = normalise_null_text(c)
    num = t.try_cast("double").try_cast("int")
    return F.coalesce(num, parse_yes_no(t))


def token_cap(query_tokens, doc_tokens, max_tokens: int) -> Column:
    """The first ``max_tokens`` tokens of query followed by document."""
    return F.slice(F.concat(_c(query_tokens), _c(doc_tokens)), 1, max_tokens)


def join_chunks(chunks) -> Column:
    """Join streamed chunks with a space and strip."""
    return F.trim(F.array_join(_c(chunks), " "))
