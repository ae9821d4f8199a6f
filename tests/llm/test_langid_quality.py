import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from rageval.llm import langid, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_ngrams_of_each_text():
    h, text, has = langid.ngram_hashes(["Ab  c", None, "12", "ab c", "x"], 3)
    own = [h[text == i].tolist() for i in range(5)]
    assert own[0] == own[3] and len(own[0]) == 4  # " ab", "ab ", "b c", " c " without the runs' lengths
    assert own[1] == own[2] == [] and len(own[4]) == 1
    assert has.tolist() == [True, False, False, True, True]


def test_filter_has_no_false_negatives_and_counts_false_positives():
    rng = np.random.default_rng(0)
    grams = {f"l{k:03d}": rng.integers(0, 2 ** 63, 3000).astype(np.uint64) for k in range(70)}  # more than one word of bits
    model = langid.build_filter(grams, 4)
    other = rng.integers(0, 2 ** 63, 20_000).astype(np.uint64)
    for k in (0, 5, 63, 64, 69):
        bit = lambda h: (model.rows(h)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        assert bit(grams[f"l{k:03d}"]).all()
        assert abs(bit(other).mean() - model.false_share[k]) < 0.01


def test_held_out_accuracy_and_odd_rows(odd):
    got = langid.identify(odd, langid.train(odd)).collect()
    lang = {r["doc_id"]: r["lang"] for r in odd.collect() if r["doc_id"] is not None and r["doc_id"] < 60}
    found = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    held = [i for i in lang if crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([found[i]["lang_pred"] == lang[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for i, r in found.items():
        if i is not None and not any(c.isalpha() for c in texts[i] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif i is not None:
            assert r["lang_pred"] in ("en", "de")


def test_nothing_to_learn(odd, none):
    model = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.keep_known(none, model).count() == 0


def test_language_stage_keeps_rows_whole(odd):
    kept = langid.keep_known(odd, langid.train(odd))
    assert kept.columns == odd.columns
    rows = {tuple(r) for r in odd.collect()}
    got = kept.collect()
    assert got and all(tuple(r) in rows and r["text"] for r in got)


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_counts_like_brute_force(odd):
    got = quality.score_documents(odd).collect()
    want = Counter((r["doc_id"], *brute(r["text"])) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_line_rules():
    rules = quality.Rules()
    fails = lambda line: quality.line_fails(line, len(WORDS.findall(line)), sum(map(len, WORDS.findall(line))), rules)
    for line in ("Home | News | Sport | About", "All rights reserved.", "WHY NOT BUY THIS RIGHT NOW", "wow!! so!! cheap!!", "a### b$$$ c%%%", " ".join(["word"] * 50)):
        assert fails(line), line
    for line in ("The water under the window, they said, was cold.", "A short title", "Is it? Yes!", "NASA and the ESA met."):
        assert not fails(line), line


def test_cleaned_text_and_lost_share(spark):
    lines = ["The river runs under the old stone bridge, and they walk along it.", "Nobody had seen the boats since winter came.",
             "So the two of them went home again.", "In spring, all was as it had been before.", "Is that not how stories end?"]
    docs = spark.createDataFrame([(1, "\n".join([lines[0], "Home | News | About", *lines[1:]])), (2, "\n".join([lines[0], lines[1], *["Home | News | About | Sport | More"] * 9]))], "doc_id long, text string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("judged", F.lit("mine"))
    got = {r["doc_id"]: r for r in quality.clean_documents(docs).collect()}
    assert set(got) == {1} and got[1]["text"] == "\n".join(lines) and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["judged"] == "mine"


def test_empty(none):
    assert quality.score_documents(none).count() == 0 and quality.clean_documents(none).count() == 0
