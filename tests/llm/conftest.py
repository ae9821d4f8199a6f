import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node long, shard int, nd_node string"
VOCABULARY = {"en": "the of and shall water under story window river making because they".split(),
              "de": "der und nicht zwischen schule strasse haus wird gegen durch einen früh".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "er", "ung", "ing"]) for _ in range(n)) + "."


def odd_rows(n=60, seed=1):
    """Ordinary documents, and one of everything that may come: nulls, empty and very long texts, copies, near copies,
    repeated rows, white space, junk; with columns whose names operators use themselves."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        texts.append(("\n".join(sentence(rng, lang, rng.randint(8, 30)) for _ in range(rng.randint(2, 6))), lang))
    base = sentence(rng, "en", 120)
    words = base.split(" ")
    texts += [(base, "en"), (base, "en"), (" ".join(words[:60] + ["changed"] + words[61:]), "en"), (base.upper() + "  ", "en")]
    texts += [(None, "en"), ("", "en"), (" \n\t ", None), ("123 456", "en"), ("a", None), ("x  <|endoftext|>\n\n é 日本", None),
              ("### $$$ ||| ***", "de"), (" ".join(["again"] * 200), "en"), (sentence(rng, "de", 12_000), "de")]
    rows = [(i, t, lang, None if i % 11 == 5 else f"s{i % 4 if i % 2 else 0}", None if t is None else len(t), "x", i, 1, "y") for i, (t, lang) in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, None, None, None, None, None, None, None, None), (None, "no id but a text " * 8, None, None, 1, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
