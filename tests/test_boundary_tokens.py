"""Words by Unicode word boundaries: cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rageval.functions.text import boundary_tokens

CASES = {
    "Don't stop at 3.14, e-mail me": ["don't", "stop", "at", "3.14", "e", "mail", "me"],
    "1,000.50€ or 1;5 but 12:30 and a.5": ["1,000.50", "or", "1;5", "but", "12", "30", "and", "a", "5"],
    "U.S.A. x:y can’t l'été 'quoted'": ["u.s.a", "x:y", "can’t", "l'été", "quoted"],
    "snake_case__x ___ _ _lead trail_ a1b2": ["snake_case__x", "_lead", "trail_", "a1b2"],
    "a..b 1..2 a,b": ["a", "b", "1", "2", "a", "b"],
    "日本語 カタカナー abcカタ ひら": ["日", "本", "語", "カタカナー", "abc", "カタ", "ひ", "ら"],
    "naïve co­op": ["naïve", "co­op"],
    "": [], " \n.,;'": [], None: None,
}


def test_by_hand(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "text string")
    got = {r["text"]: r["t"] for r in df.select("text", boundary_tokens("text").alias("t")).collect()}
    assert got == CASES


@pytest.mark.parametrize("unit", ["a.", "1,", "a1", "x", "_", "a'", "̈", "ä.", "カ", "日"])
def test_long_texts_without_spaces(spark, unit):
    df = spark.createDataFrame([(unit * 200_000,)], "text string")
    toks = df.select(boundary_tokens("text").alias("t")).select(F.size("t").alias("n"), F.array_join("t", "").alias("s")).first()
    letters = sum(c.isalnum() for c in unit) * 200_000
    assert sum(c.isalnum() for c in toks["s"]) == letters
    assert toks["n"] <= max(1, letters)
