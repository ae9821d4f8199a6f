"""DuckDB SQL for the pair, word and trie operators, written without their methods."""

from __future__ import annotations

from . import paritysketch, spelling

WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def crc_steps() -> list[int]:
    """What four shifts of the reflected CRC-32 register do to each value of its lowest four bits."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, over half bytes, the low one of each byte first."""
    halves = f"list_transform(range(2 * strlen({text})), lambda i: strpos('0123456789ABCDEF', substr(hex(encode({text})), CAST(xor(i, 1) + 1 AS BIGINT), 1)) - 1)"
    step = f"xor(c >> 4, {crc_steps()}[xor(c & 15, b) + 1])"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], CAST({halves} AS BIGINT[])), lambda c, b: {step}))"


def trie_sql() -> str:
    return f"""
WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id),
convs AS (SELECT conv_id, n, conv_id - conv_id % 100 AS head, {crc32('digits')} % 6 AS h FROM own),
cut AS (SELECT c.*, least(h, coalesce(o.n, 0)) AS kept FROM convs c LEFT JOIN own o ON o.conv_id = c.head),
rebuilt AS (SELECT c.conv_id, t.p, t.role, t.text FROM cut c JOIN turns t ON t.conv_id = c.head AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p - c.h + c.kept, t.role, t.text FROM cut c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
prefixes AS (SELECT conv_id, p AS depth, text, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
ends AS (SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id),
nodes AS (SELECT p.depth, p.k, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(p.text)) AS saved,
  sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (e.last = p.depth), '')) AS ends_sha256
  FROM prefixes p JOIN ends e USING (conv_id) GROUP BY p.depth, p.k),
children AS (SELECT depth - 1 AS depth, left(k, CAST(64 * (depth - 1) AS BIGINT)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
flat AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, k)),
below AS (SELECT p.depth, p.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM flat x JOIN prefixes p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.depth, p.k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM flat f JOIN below b USING (depth, k) LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.k = left(f.k, CAST(64 * (f.depth - 1) AS BIGINT))"""


def spelling_sql() -> str:
    """Near words by deleted letters: a word less a letter is another one, or two words less a letter at one place are equal."""
    return rf"""
WITH RECURSIVE runs AS (SELECT doc_id, {lower_ascii("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {crc32('named')} AS h FROM each),
spelled AS (SELECT CASE WHEN h % {spelling.ERROR_EVERY} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {spelling.LEAST_COUNT}),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT less.word, w.word AS other FROM less JOIN words w ON w.word = less.s
  UNION SELECT w.word, less.word FROM less JOIN words w ON w.word = less.s
  UNION SELECT a.word, b.word FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_max(near.other, (w.n, -rk)) AS other, max(w.n) AS other_n
  FROM near JOIN (SELECT *, row_number() OVER (ORDER BY word) AS rk FROM words) w ON w.word = near.other GROUP BY near.word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {spelling.RATIO} * w.n THEN b.other END AS form,
  CASE WHEN b.other_n >= {spelling.RATIO} * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.root FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)"""


def parity_sql() -> str:
    """Equal sets are one; sizes of intersections from a join on shingles; components by closure."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower_ascii("coalesce(text, '')")}, {WORDS}) AS w FROM documents),
each AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM each GROUP BY doc_id),
kinds AS (SELECT k, min(doc_id) AS id, any_value(n) AS n FROM sets GROUP BY k),
members AS (SELECT kinds.id, kinds.n, each.s FROM kinds JOIN each ON each.doc_id = kinds.id),
shared AS (SELECT a.id, b.id AS other, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS c FROM members a JOIN members b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT id, other FROM shared WHERE 100 * c >= {paritysketch.PERCENT} * (sizes - c)),
sides AS (SELECT id, other FROM links UNION ALL SELECT other, id FROM links),
reach AS (SELECT id, id AS node FROM kinds UNION SELECT reach.id, sides.other FROM reach JOIN sides ON sides.id = reach.node),
smallest AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN kinds USING (k) LEFT JOIN smallest l ON l.id = kinds.id"""
