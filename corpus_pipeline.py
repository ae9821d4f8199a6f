"""The corpus pipeline: language, quality, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``; each works on all rows that the one
before it kept. Its parts decide as follows: the language stage drops documents without letters or in none of the
learned languages; the quality stage removes failing lines and drops documents that fail or lose too much; of each
near-duplicate class the row with the smallest id stays; the mix repeats and leaves out documents until each source has
its target; packing gives one row per piece of a sequence.

Null texts go in the first stage, as empty ones do. Rows that repeat are one class in the third. Empty tables pass.
"""

from __future__ import annotations

import public_tokenizers

from rageval.llm import langid, mixing, neardup, packing, quality
from rageval.llm.common import staged, table

TOKENIZER = "word_bpe_49k.json"


def language(spark, docs, sf_dir):
    return langid.keep_known(docs, langid.train(docs))


def clean(spark, docs, sf_dir):
    return quality.clean_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    return neardup.keep_one(docs)


def mix(spark, docs, sf_dir):
    return mixing.mix_documents(docs)


def pack(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


STAGES = [("language", language), ("quality", clean), ("near-duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: Tokens and signatures can't be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
