"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import hnsw, langid, mixing, neardup, oracles, packing, paritysketch, pitman_yor, quality, rans, sharding, spelling, trie, warc
from .common import id_crc, table


def op1_hnsw_shards(spark, sf_dir):
    """The 10 nearest of every hundredth vector among all others."""
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_cutting_stock_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_bitmask_langid(spark, sf_dir):
    """The language of every document, by filters learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.train(docs))
    return got.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op4_splitting_tree_mix(spark, sf_dir):
    """What a mix of all sources by weight takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_rans_tokens(spark, sf_dir):
    """Token files of all documents, written, read back and decoded."""
    return rans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op6_line_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    got = quality.score_documents(table(spark, sf_dir, "documents"), with_text=False)
    return got.drop("clean_text")


def op7_dart_minhash(spark, sf_dir):
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark, sf_dir):
    """The log10 probability of every document, by a model of four fifths of them."""
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op9_warc_transactions(spark, sf_dir):
    """Archive all pages, read the archives back, one row per capture."""
    got = warc.archive_and_read(table(spark, sf_dir, "pages"), with_payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"),
                      "target_uri", F.size("requests").alias("n_requests"))


def op10_virtual_slots(spark, sf_dir):
    """Sixteen shards of near equal bytes through 4096 virtual slots."""
    got = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op11_parity_sketches(spark, sf_dir):
    """The component of every document under links of Jaccard 0.85 or more, over four-word shingles."""
    return paritysketch.similarity_components(table(spark, sf_dir, "documents"))


def op12_kd_spelling(spark, sf_dir):
    """Every frequent word of all documents with its near words, its form and its root."""
    words = spelling.count_words(table(spark, sf_dir, "documents"), error_every=spelling.ERROR_EVERY)
    return spelling.variants(words)


def op13_veb_trie(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt by hundreds."""
    return trie.prefix_trie(*trie.rebuilt(trie.turns_of(table(spark, sf_dir, "conversations"))))


def queries():
    return {f.__name__: f for f in (op1_hnsw_shards, op2_cutting_stock_packing, op3_bitmask_langid, op4_splitting_tree_mix, op5_rans_tokens, op6_line_rules, op7_dart_minhash, op8_pitman_yor, op9_warc_transactions, op10_virtual_slots,
                                    op11_parity_sketches, op12_kd_spelling, op13_veb_trie)}


WORDS_SQL = r"'[^\x20\x09-\x0D]+'"


def line_rules_sql() -> str:
    """The counts and the verdict, with the production rules."""
    rules = quality.Rules()
    phrases = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in quality.PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win)
        CROSS JOIN (SELECT unnest(range(8)) AS k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, line, len(lw) AS n, length(array_to_string(lw, '')) AS c FROM
  (SELECT doc_id, line, regexp_extract_all(line, {WORDS_SQL}) AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d))
  WHERE len(lw) > 0),
counted AS (SELECT *, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, len(regexp_extract_all(line, '[|»›•·]|::|>>|\s>\s|\s/\s')) AS menu,
  len(regexp_extract_all(line, '[!?]{{2,}}')) AS shout, length(regexp_replace(line, '\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(line, '\P{{Ll}}', '', 'g')) AS low
  FROM lines),
judged AS (SELECT *, symbols > {rules.max_symbol_share} * c OR menu > {rules.max_menu_share} * n OR shout > {rules.max_shout_share} * n
  OR (n >= {rules.min_upper_words} AND up > {rules.max_upper_share} * (up + low))
  OR (n >= {rules.unpaused_words} AND NOT regexp_matches(line, '[.!?…:;,。！？、，]')) OR regexp_matches(lower(line), '{phrases}') AS fails FROM counted),
per AS (SELECT doc_id, sum(CASE WHEN fails THEN c ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dup FROM judged GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(per.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(per.lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND lost_chars <= {rules.max_lost} * word_chars AS kept
FROM base"""


WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN h.head <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to, regexp_replace(p.url, '[\x00-\x20\x7F]', '%20', 'g') AS target_uri, 1 AS n_requests
FROM p LEFT JOIN h ON h.html = p.html"""


def oracle_sql():
    """The other operators depend on hashes, tokenizers, sampling or search that SQL can't express; tests compare them
    with brute force."""
    return {"op6_line_rules": line_rules_sql(), "op9_warc_transactions": WARC_SQL, "op11_parity_sketches": oracles.parity_sql(),
            "op12_kd_spelling": oracles.spelling_sql(), "op13_veb_trie": oracles.trie_sql()}
