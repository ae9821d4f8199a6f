"""Independent DuckDB SQL for every catalogue query (the correctness oracle).

These statements are written brute force on purpose -- e.g. BM25 scores
every (query, document) pair -- so they check the Spark operators by a
different route. They run on the driver's pre-registered views.
"""

from __future__ import annotations

from ..functions.text import DEFAULT_FAILED_ANSWER, MID_EITHER, MID_LETTER, MID_NUMBER, PY_WHITESPACE_CLASS, STD_TOKEN_PATTERN
from ..operators.example_judge import LEVELS, NEIGHBOURS, THRESHOLDS
from ..operators.generate import MAX_ATTEMPTS
from ..operators.lexical import MATCH_B, MATCH_K1, OKAPI_B, OKAPI_EPSILON, OKAPI_K1
from ..sources.tables import MIN_WORDS_EXCLUSIVE, QUERY_VECTOR_EVERY
from .fixtures import DEFAULT_K

K = DEFAULT_K


def WS(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{PY_WHITESPACE_CLASS}'), lambda t: t <> '')"


def STD(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{STD_TOKEN_PATTERN}')"


def BND(x: str) -> str:
    """Words by Unicode word boundaries: characters that stand alone and Katakana runs are set apart first."""
    either, ext = MID_EITHER.replace("'", "''"), r"\p{M}\p{Cf}"
    apart = rf"regexp_replace(regexp_replace(lower({x}), '([\p{{Han}}\p{{Hiragana}}][{ext}]*)', ' \1 ', 'g'), '([\p{{Katakana}}ー][\p{{Katakana}}ー{ext}]*)', ' \1 ', 'g')"
    letters, digits = rf"[\p{{L}}\p{{Nl}}][\p{{L}}\p{{Nl}}{ext}]*", rf"\p{{Nd}}[\p{{Nd}}{ext}]*"
    word = rf"(?:{letters}(?:[{MID_LETTER}{either}][{ext}]*{letters})*|{digits}(?:[{MID_NUMBER}{either}][{ext}]*{digits})*|\p{{Pc}}[\p{{Pc}}{ext}]*)+"
    return rf"list_filter(regexp_extract_all({apart}, '{word}'), lambda t: regexp_matches(t, '[\p{{L}}\p{{Nl}}\p{{Nd}}]'))"


def BLANK(x: str) -> str:
    return f"({x} IS NULL OR len({WS(x)}) = 0)"


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def sql(final: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + final


# --- base views ------------------------------------------------------------
cte("docs_ok", (), f"SELECT doc_id, text FROM documents WHERE len({WS('text')}) > {MIN_WORDS_EXCLUSIVE}")
cte("corpus", ("docs_ok",), "SELECT min(doc_id) AS doc_id, text FROM docs_ok GROUP BY text")
cte("qs", (), "SELECT item_id AS query_id, text FROM benchmark")
cte("qs_ok", ("qs",), f"SELECT query_id, text FROM qs WHERE NOT {BLANK('text')}")

# --- whitespace BM25 (Okapi) -----------------------------------------------
cte("c_ws", ("corpus",), f"SELECT doc_id, {WS('text')} AS toks FROM corpus")
cte("dl_ws", ("c_ws",), "SELECT doc_id, len(toks) AS dl FROM c_ws")
cte("post_ws", ("c_ws",), "SELECT doc_id, token, count(*) AS tf FROM "
    "(SELECT doc_id, unnest(toks) AS token FROM c_ws) GROUP BY doc_id, token")
cte("df_ws", ("post_ws",), "SELECT token, count(*) AS df FROM post_ws GROUP BY token")
cte("st_ws", ("dl_ws",), "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl_ws")
cte("rawidf_ws", ("df_ws", "st_ws"),
    "SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df_ws, st_ws")
cte("idf_ws", ("rawidf_ws",),
    f"SELECT token, CASE WHEN raw < 0 THEN {OKAPI_EPSILON} * m.mean ELSE raw END AS idf "
    "FROM rawidf_ws CROSS JOIN (SELECT avg(raw) AS mean FROM rawidf_ws) m")
cte("qtf_ws", ("qs_ok",), "SELECT query_id, token, count(*) AS qtf FROM "
    f"(SELECT query_id, unnest({WS('text')}) AS token FROM qs_ok) GROUP BY query_id, token")
cte("m_bm25", ("qtf_ws", "idf_ws", "post_ws", "dl_ws", "st_ws"),
    f"SELECT q.query_id, p.doc_id, sum((q.qtf * i.idf) * p.tf * {OKAPI_K1 + 1.0} / "
    f"(p.tf + {OKAPI_K1} * ({1.0 - OKAPI_B} + {OKAPI_B} * d.dl / s.avgdl))) AS score "
    "FROM qtf_ws q JOIN idf_ws i USING (token) JOIN post_ws p USING (token) "
    "JOIN dl_ws d ON d.doc_id = p.doc_id CROSS JOIN st_ws s GROUP BY q.query_id, p.doc_id")


def _bm25_ranked(k: int) -> str:
    return ("SELECT query_id, doc_id, rank, score FROM (SELECT q.query_id, c.doc_id, "
            "coalesce(m.score, 0.0) AS score, CAST(row_number() OVER (PARTITION BY q.query_id "
            "ORDER BY round(coalesce(m.score, 0.0), 10) DESC, c.doc_id ASC) AS INTEGER) AS rank "
            "FROM qs_ok q CROSS JOIN corpus c LEFT JOIN m_bm25 m ON m.query_id = q.query_id "
            f"AND m.doc_id = c.doc_id) WHERE rank <= {k}")


cte("bm25_k", ("qs_ok", "corpus", "m_bm25"), _bm25_ranked(K))

# --- standard-analyzer index: match (R4) and tf-idf (U1); the same match on word-boundary tokens ---
def _match_index(kind: str, toks, m: str, out: str) -> None:
    cte(f"c_{kind}", ("corpus",), f"SELECT doc_id, {toks('text')} AS toks FROM corpus")
    cte(f"dl_{kind}", (f"c_{kind}",), f"SELECT doc_id, len(toks) AS dl FROM c_{kind}")
    cte(f"post_{kind}", (f"c_{kind}",), "SELECT doc_id, token, count(*) AS tf FROM "
        f"(SELECT doc_id, unnest(toks) AS token FROM c_{kind}) GROUP BY doc_id, token")
    cte(f"df_{kind}", (f"post_{kind}",), f"SELECT token, count(*) AS df FROM post_{kind} GROUP BY token")
    cte(f"st_{kind}", (f"dl_{kind}",), f"SELECT count(*) AS n, avg(dl) AS avgdl FROM dl_{kind}")
    cte(f"qtf_{kind}", ("qs_ok",), "SELECT query_id, token, count(*) AS qtf FROM "
        f"(SELECT query_id, unnest({toks('text')}) AS token FROM qs_ok) GROUP BY query_id, token")
    cte(m, (f"qtf_{kind}", f"df_{kind}", f"post_{kind}", f"dl_{kind}", f"st_{kind}"),
        f"SELECT q.query_id, p.doc_id, sum((q.qtf * ln(1.0 + (s.n - f.df + 0.5) / (f.df + 0.5))) * p.tf * "
        f"{MATCH_K1 + 1.0} / (p.tf + {MATCH_K1} * ({1.0 - MATCH_B} + {MATCH_B} * d.dl / s.avgdl))) AS score "
        f"FROM qtf_{kind} q JOIN df_{kind} f USING (token) JOIN post_{kind} p USING (token) "
        f"JOIN dl_{kind} d ON d.doc_id = p.doc_id CROSS JOIN st_{kind} s GROUP BY q.query_id, p.doc_id")
    cte(out, (m,), _match_ranked(K, m))


def _match_ranked(k: int, m: str = "m_match") -> str:
    return ("SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, "
            "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id ASC) AS INTEGER) AS rank "
            f"FROM {m} WHERE score > 0) WHERE rank <= {k}")


_match_index("std", STD, "m_match", "match_k")
_match_index("bnd", BND, "m_boundary", "boundary_k")
cte("idf_t", ("df_std", "st_std"), "SELECT token, ln((1.0 + s.n) / (1.0 + f.df)) + 1.0 AS idf FROM df_std f, st_std s")
cte("dnorm", ("post_std", "idf_t"), "SELECT p.doc_id, sqrt(sum((p.tf * i.idf) * (p.tf * i.idf))) AS norm "
    "FROM post_std p JOIN idf_t i USING (token) GROUP BY p.doc_id")
cte("qv", ("qtf_std", "idf_t", "st_std"),
    "SELECT q.query_id, q.token, coalesce(i.idf, ln((1.0 + s.n) / 1.0) + 1.0) AS idf, "
    "q.qtf * coalesce(i.idf, ln((1.0 + s.n) / 1.0) + 1.0) AS wq FROM qtf_std q LEFT JOIN idf_t i USING (token) "
    "CROSS JOIN st_std s")
cte("qn", ("qv",), "SELECT query_id, sqrt(sum(wq * wq)) AS qnorm FROM qv GROUP BY query_id")
cte("dots", ("qv", "post_std"), "SELECT v.query_id, p.doc_id, sum(v.wq * (p.tf * v.idf)) AS dot "
    "FROM qv v JOIN post_std p USING (token) GROUP BY v.query_id, p.doc_id")
cte("cos_t", ("dots", "qn", "dnorm"), "SELECT d.query_id, d.doc_id, CASE WHEN qn.qnorm * n.norm > 0 "
    "THEN d.dot / (qn.qnorm * n.norm) ELSE 0.0 END AS score FROM dots d JOIN qn USING (query_id) "
    "JOIN dnorm n ON n.doc_id = d.doc_id")


def _tfidf_ranked(k: int) -> str:
    return ("SELECT query_id, doc_id, rank, score FROM (SELECT q.query_id, c.doc_id, coalesce(t.score, 0.0) AS score, "
            "CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(t.score, 0.0), 10) DESC, c.doc_id DESC) "
            "AS INTEGER) AS rank FROM qs_ok q CROSS JOIN corpus c LEFT JOIN cos_t t ON t.query_id = q.query_id "
            f"AND t.doc_id = c.doc_id) WHERE rank <= {k}")


cte("tfidf_k", ("qs_ok", "corpus", "cos_t"), _tfidf_ranked(K))

# --- hashed text encoders: token counts added to 64 or 128 components by the md5 of the token
def encoder_ctes(name: str, dims: int) -> None:
    cell = f"('0x' || substr(md5('{name}' || token), 1, 4))::INTEGER % {dims}"
    sign = f"CASE WHEN substr(md5('{name}' || token), 5, 1) < '8' THEN 1 ELSE -1 END"
    cte(f"{name}_d", ("post_std",), f"SELECT doc_id, {cell} AS cell, CAST(sum(tf * {sign}) AS DOUBLE) AS v FROM post_std GROUP BY doc_id, cell")
    cte(f"{name}_q", ("qtf_std",), f"SELECT query_id, {cell} AS cell, CAST(sum(qtf * {sign}) AS DOUBLE) AS v FROM qtf_std GROUP BY query_id, cell")
    cte(f"{name}_cos", (f"{name}_d", f"{name}_q"), f"""
SELECT x.query_id, x.doc_id, CASE WHEN a.n * b.n > 0 THEN x.dot / (a.n * b.n) ELSE 0.0 END AS score
FROM (SELECT q.query_id, d.doc_id, sum(q.v * d.v) AS dot FROM {name}_q q JOIN {name}_d d USING (cell) GROUP BY q.query_id, d.doc_id) x
JOIN (SELECT query_id, sqrt(sum(v * v)) AS n FROM {name}_q GROUP BY query_id) a ON a.query_id = x.query_id
JOIN (SELECT doc_id, sqrt(sum(v * v)) AS n FROM {name}_d GROUP BY doc_id) b ON b.doc_id = x.doc_id""")
    cte(f"{name}_k", ("qs_ok", "corpus", f"{name}_cos"), _dense_ranked(name, K))


def _dense_ranked(name: str, k: int) -> str:
    return ("SELECT query_id, doc_id, rank, score FROM (SELECT q.query_id, c.doc_id, coalesce(t.score, 0.0) AS score, "
            "CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(t.score, 0.0), 10) DESC, c.doc_id DESC) "
            f"AS INTEGER) AS rank FROM qs_ok q CROSS JOIN corpus c LEFT JOIN {name}_cos t ON t.query_id = q.query_id "
            f"AND t.doc_id = c.doc_id) WHERE rank <= {k}")


encoder_ctes("dense_a", 64)
encoder_ctes("dense_b", 128)

# --- judged pairs: the query's tokens in a row are positive; pooled, labelled documents negative ---
def LINE(x: str) -> str:
    return f"(' ' || array_to_string({WS(x)}, ' ') || ' ')"


cte("q_pos", ("qs_ok", "corpus"), f"SELECT q.query_id, c.doc_id FROM (SELECT query_id, {LINE('text')} AS l FROM qs_ok) q, "
    f"(SELECT doc_id, {LINE('text')} AS l FROM corpus) c WHERE contains(c.l, q.l)")
cte("pool", ("qs_ok", "corpus", "m_bm25", "cos_t", "m_match", "dense_a_cos", "dense_b_cos"), f"""
SELECT query_id, doc_id, min(rank) AS rank FROM ({_bm25_ranked(10)} UNION ALL {_tfidf_ranked(10)} UNION ALL {_match_ranked(10)}
  UNION ALL {_dense_ranked("dense_a", 10)} UNION ALL {_dense_ranked("dense_b", 10)})
GROUP BY query_id, doc_id""")
cte("qrels", ("q_pos", "pool"), """
SELECT query_id, doc_id, 1 AS label FROM q_pos
UNION ALL
SELECT DISTINCT p.query_id, p.doc_id, 0 AS label FROM pool p
WHERE p.doc_id IN (SELECT doc_id FROM labels)
  AND NOT EXISTS (SELECT 1 FROM q_pos x WHERE x.query_id = p.query_id AND x.doc_id = p.doc_id)""")

# --- hybrid (R5), fusion (R6) --------------------------------------------------
cte("cand", ("bm25_k", "match_k"), """
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fs) AS INTEGER) AS cand_pos
FROM (SELECT query_id, doc_id, min(src * 1000000 + rank) AS fs FROM (
  SELECT 0 AS src, query_id, doc_id, rank FROM bm25_k UNION ALL
  SELECT 1 AS src, query_id, doc_id, rank FROM match_k) GROUP BY query_id, doc_id)""")
cte("cand_sim", ("cand", "qv", "qn", "post_std", "dnorm"), """
SELECT c.query_id, c.doc_id, c.cand_pos, coalesce(x.sim, 0.0) AS sim FROM cand c LEFT JOIN (
  SELECT d.query_id, d.doc_id, CASE WHEN qn.qnorm * n.norm > 0 THEN d.dot / (qn.qnorm * n.norm) END AS sim
  FROM (SELECT c2.query_id, c2.doc_id, sum(v.wq * (p.tf * v.idf)) AS dot FROM cand c2
        JOIN post_std p ON p.doc_id = c2.doc_id JOIN qv v ON v.query_id = c2.query_id AND v.token = p.token
        GROUP BY c2.query_id, c2.doc_id) d
  JOIN qn USING (query_id) JOIN dnorm n ON n.doc_id = d.doc_id) x
ON x.query_id = c.query_id AND x.doc_id = c.doc_id""")
cte("hyb_k", ("cand_sim",), "SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, sim AS score, "
    "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 10) DESC, cand_pos ASC) AS INTEGER) AS rank "
    f"FROM cand_sim) WHERE rank <= {K}")
cte("base_runs", ("bm25_k", "tfidf_k", "dense_a_k", "dense_b_k", "match_k", "hyb_k"), """
SELECT 'bm25' AS retriever, 0 AS retriever_idx, query_id, doc_id, rank, score FROM bm25_k UNION ALL
SELECT 'tfidf', 1, query_id, doc_id, rank, score FROM tfidf_k UNION ALL
SELECT 'dense_a', 2, query_id, doc_id, rank, score FROM dense_a_k UNION ALL
SELECT 'dense_b', 3, query_id, doc_id, rank, score FROM dense_b_k UNION ALL
SELECT 'match', 4, query_id, doc_id, rank, score FROM match_k UNION ALL
SELECT 'hybrid', 5, query_id, doc_id, rank, score FROM hyb_k""")
cte("rrf_k", ("base_runs",), f"""
SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, fs ASC) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, sum(1.0 / (60.0 + rank)) AS score, min(retriever_idx * 1000000 + rank) AS fs
        FROM base_runs WHERE rank <= {K} GROUP BY query_id, doc_id)) WHERE rank <= {K}""")
cte("fused_runs", ("base_runs", "rrf_k"), "SELECT * FROM base_runs UNION ALL "
    "SELECT 'rrf', 6, query_id, doc_id, rank, score FROM rrf_k")

# --- judge (U3), votes (A4), consensus (R7) -------------------------------------
cte("jp", ("fused_runs", "corpus", "qs"), f"""
SELECT query_id, doc_id, CASE WHEN (CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / len(qt) ELSE 0.0 END)
  >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT p.query_id, p.doc_id, list_distinct({STD('q.text')}) AS qt, {STD('c.text')} AS dt
      FROM (SELECT DISTINCT query_id, doc_id FROM fused_runs) p JOIN corpus c ON c.doc_id = p.doc_id
      JOIN qs q ON q.query_id = p.query_id)""")
cte("judged", ("fused_runs", "jp"), "SELECT r.*, j.prediction FROM fused_runs r LEFT JOIN jp j "
    "ON j.query_id = r.query_id AND j.doc_id = r.doc_id")
cte("votes", ("judged",), "SELECT query_id, doc_id, count(*) AS votes, min(rank) AS best_rank FROM judged "
    "WHERE retriever <> 'rrf' AND prediction = 1 GROUP BY query_id, doc_id")
cte("universe", ("judged",), "SELECT DISTINCT query_id FROM judged WHERE retriever <> 'rrf'")


def consensus_ctes(tag: str, order: str) -> str:
    cte(f"chosen{tag}", ("votes", "corpus"), f"""
SELECT query_id, doc_id, rank, 'consensus' AS source FROM (SELECT v.query_id, v.doc_id,
  CAST(row_number() OVER (PARTITION BY v.query_id ORDER BY {order}) AS INTEGER) AS rank
  FROM votes v JOIN corpus c ON c.doc_id = v.doc_id) WHERE rank <= {K}""")
    cte(f"without{tag}", ("universe", f"chosen{tag}"),
        f"SELECT query_id FROM universe WHERE query_id NOT IN (SELECT query_id FROM chosen{tag})")
    cte(f"picked{tag}", (f"without{tag}", "rrf_k", "qs", "universe"), f"""
SELECT query_id FROM (SELECT w.query_id, row_number() OVER (ORDER BY q.text ASC NULLS FIRST, w.query_id) AS o
  FROM without{tag} w LEFT JOIN qs q ON q.query_id = w.query_id
  WHERE w.query_id IN (SELECT query_id FROM rrf_k))
WHERE o <= (SELECT floor(count(*) * 0.1) FROM universe)""")
    cte(f"cons{tag}", (f"chosen{tag}", f"without{tag}", f"picked{tag}", "rrf_k"), f"""
SELECT query_id, doc_id, rank, source FROM chosen{tag} UNION ALL
SELECT query_id, doc_id, rank, 'fallback' FROM rrf_k WHERE query_id IN (SELECT query_id FROM picked{tag})
  AND rank <= {K} UNION ALL
SELECT query_id, CAST(NULL AS BIGINT), 1, 'sentinel' FROM without{tag}
  WHERE query_id NOT IN (SELECT query_id FROM picked{tag})""")
    return f"cons{tag}"


consensus_ctes("", "v.votes DESC, c.text ASC, v.doc_id ASC")
consensus_ctes("_br", "v.votes DESC, v.best_rank ASC, c.text ASC, v.doc_id ASC")
cte("jq", ("qrels",), "SELECT query_id, doc_id, any_value(label) AS label FROM qrels GROUP BY query_id, doc_id")
cte("all_runs", ("fused_runs", "cons"), "SELECT retriever, retriever_idx, query_id, doc_id, rank FROM fused_runs UNION ALL "
    "SELECT 'consensus', 7, query_id, doc_id, rank FROM cons")


# --- best retriever, answers, routing --------------------------------------------
NL = "chr(10)"


def COVER(q: str, d: str) -> str:
    """Share of distinct standard tokens of q found in d."""
    return (f"(CASE WHEN len(list_distinct({STD(q)})) > 0 THEN len(list_intersect(list_distinct({STD(q)}), "
            f"{STD(d)})) / len(list_distinct({STD(q)})) ELSE 0.0 END)")


# --- judge by labelled examples: cells of shares, nearest cells, fitted threshold ---
def CELL(rows: str) -> str:
    """The rows of a query with (q, t), and their cell."""
    def six(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN CAST(floor(CAST({a} AS DOUBLE) / {b} * {LEVELS} + 0.5) AS INTEGER) ELSE 0 END"

    def two(x: str) -> str:
        return f"list_distinct(list_transform(range(1, greatest(len({x}), 1)), lambda i: {x}[i] || ' ' || {x}[i + 1]))"

    def chars(x: str) -> str:
        return f"coalesce(list_sum(list_transform({x}, lambda w: length(w))), 0)"

    return f"""SELECT *, (s1 * {LEVELS + 1} + s2) * {LEVELS + 1} + CASE WHEN len(q2) > 0 THEN s3 ELSE s1 END AS cell FROM (
  SELECT *, {six('len(hit)', 'len(own)')} AS s1, {six(chars('hit'), chars('own'))} AS s2, {six('len(list_intersect(q2, t2))', 'len(q2)')} AS s3
  FROM (SELECT *, list_intersect(own, ta) AS hit FROM (SELECT *, list_distinct(qa) AS own, {two('qa')} AS q2, {two('ta')} AS t2
    FROM (SELECT *, {STD("coalesce(q, '')")} AS qa, {STD("coalesce(t, '')")} AS ta FROM ({rows})))))"""


def COSINE(x: str, y: str) -> str:
    base = LEVELS + 1

    def dot(u: str, v: str) -> str:
        cut = ["{0} // %d" % (base * base), "({0} // %d) %% %d" % (base, base), "{0} %% %d" % base]
        return "(" + " + ".join(f"({c.format(u)}) * ({c.format(v)}) + ({LEVELS} - ({c.format(u)})) * ({LEVELS} - ({c.format(v)}))" for c in cut) + ")"
    return f"round({dot(x, y)} / sqrt(CAST({dot(x, x)} * {dot(y, y)} AS DOUBLE)), 10)"


def VOTES(askers: str) -> str:
    """(cell, gone, score) of the askers (cell, gone)."""
    return f"""SELECT cell, gone, round(sum(cos * pos) / nullif(sum(cos * n), 0), 9) AS score FROM (
  SELECT *, sum(n) OVER (PARTITION BY cell, gone ORDER BY cos DESC, other ROWS UNBOUNDED PRECEDING) - n AS before FROM (
    SELECT a.cell, a.gone, c.cell AS other, {COSINE('a.cell', 'c.cell')} AS cos,
      c.n - CASE WHEN a.gone >= 0 AND a.cell = c.cell THEN 1 ELSE 0 END AS n,
      c.pos - CASE WHEN a.gone = 1 AND a.cell = c.cell THEN 1 ELSE 0 END AS pos
    FROM ({askers}) a CROSS JOIN ex_cells c)) WHERE before < {NEIGHBOURS} GROUP BY cell, gone"""


cte("examples", (), f"""SELECT u.text AS q, a.text AS t, CASE WHEN {COVER('u.text', 'a.text')} >= 0.5 THEN 1 ELSE 0 END AS label
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
cte("ex_cells", ("examples",), f"SELECT cell, count(*) AS n, sum(label) AS pos FROM ({CELL('SELECT * FROM examples')}) GROUP BY cell")
cte("ex_fit", ("ex_cells",), f"""
SELECT threshold, sum(times) AS n_examples, sum(CASE WHEN (CASE WHEN score >= threshold THEN 1 ELSE 0 END) = gone THEN times ELSE 0 END) AS n_right
FROM (SELECT s.*, a.times FROM ({VOTES("SELECT cell, 1 AS gone FROM ex_cells UNION ALL SELECT cell, 0 FROM ex_cells")}) s JOIN (
  SELECT cell, 1 AS gone, pos AS times FROM ex_cells UNION ALL SELECT cell, 0, n - pos FROM ex_cells) a
  ON a.cell = s.cell AND a.gone = s.gone WHERE a.times > 0)
CROSS JOIN (SELECT unnest([{', '.join(f'CAST({t!r} AS DOUBLE)' for t in THRESHOLDS)}]) AS threshold) GROUP BY threshold""")
cte("ex_pairs", ("fused_runs", "corpus", "qs"), CELL("""SELECT p.query_id, p.doc_id, q.text AS q, c.text AS t
FROM (SELECT DISTINCT query_id, doc_id FROM fused_runs) p JOIN corpus c ON c.doc_id = p.doc_id JOIN qs q ON q.query_id = p.query_id"""))
cte("ex_judged", ("fused_runs", "ex_pairs", "ex_cells", "ex_fit"), f"""
SELECT r.retriever, r.query_id, r.doc_id, r.rank, v.score AS example_score,
  CASE WHEN v.score >= (SELECT threshold FROM ex_fit ORDER BY n_right DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS prediction
FROM fused_runs r JOIN ex_pairs p ON p.query_id = r.query_id AND p.doc_id = r.doc_id
JOIN ({VOTES("SELECT DISTINCT cell, -1 AS gone FROM ex_pairs")}) v ON v.cell = p.cell""")


LLMS = (("coverage", "c"), ("density", "d"), ("length", "l"))


def best_lines(pairs: str, llms=LLMS) -> str:
    """(llm, llm_idx, query_id, doc_id, line): of each pair of a CTE the line with the highest score, for each model."""
    scored = f"""SELECT query_id, doc_id, pos, line, len(hit) AS c, len(hit) / (len(own) + 1) AS d,
  coalesce(list_sum(list_transform(hit, lambda t: length(t))), 0) AS l
FROM (SELECT *, list_intersect(list_distinct({STD('qtext')}), own) AS hit
      FROM (SELECT *, list_distinct({STD('line')}) AS own
            FROM (SELECT p.query_id, p.doc_id, q.text AS qtext, unnest(string_split(c.text, {NL})) AS line,
                         generate_subscripts(string_split(c.text, {NL}), 1) AS pos
                  FROM (SELECT DISTINCT query_id, doc_id FROM {pairs}) p JOIN corpus c ON c.doc_id = p.doc_id
                  JOIN qs q ON q.query_id = p.query_id)))"""
    return " UNION ALL ".join(f"""SELECT '{llm}' AS llm, {i} AS llm_idx, query_id, doc_id, line FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {by} DESC, pos) AS rn FROM ({scored})) WHERE rn = 1"""
                              for i, (llm, by) in enumerate(llms))


cte("board", ("all_runs", "qrels"), "SELECT * FROM (" + "{MACRO}" + ")")
cte("best_pairs", ("all_runs", "board"), """
SELECT retriever, query_id, doc_id, rank FROM all_runs WHERE doc_id IS NOT NULL AND retriever = (
  SELECT b.retriever FROM board b JOIN
    (VALUES ('bm25', 0), ('tfidf', 1), ('dense_a', 2), ('dense_b', 3), ('match', 4), ('hybrid', 5), ('rrf', 6), ('consensus', 7)) d(retriever, idx)
    ON d.retriever = b.retriever ORDER BY b.f1_score DESC, d.idx LIMIT 1)""")
cte("best_line", ("best_pairs", "corpus", "qs"), best_lines("best_pairs"))
cte("answers", ("best_line",), "SELECT llm, llm_idx, query_id, doc_id, trim(line) AS answer FROM best_line")
cte("janswers", ("answers", "qs"), f"""
SELECT *, CASE WHEN grade >= 0.5 THEN 1 WHEN grade < 0.5 THEN 0 END AS prediction FROM (
  SELECT a.*, CASE WHEN a.answer IS NOT NULL THEN {COVER('q.text', 'a.answer')} END AS grade
  FROM answers a JOIN qs q ON q.query_id = a.query_id)""")
cte("trows", ("janswers",), """
SELECT query_id, doc_id, best_llm, label FROM (SELECT query_id, doc_id, llm AS best_llm, llm_idx AS label,
  row_number() OVER (PARTITION BY query_id, doc_id ORDER BY grade DESC, llm_idx ASC) AS rn
  FROM janswers WHERE grade IS NOT NULL) WHERE rn = 1""")
cte("bm25_1", ("qs_ok", "corpus", "m_bm25"), _bm25_ranked(1))
cte("base_ans", ("bm25_1", "corpus", "qs"), f"""
SELECT b.query_id, b.doc_id, trim(b.line) AS answer, CASE WHEN {COVER('q.text', 'trim(b.line)')} >= 0.5 THEN 1 ELSE 0 END AS answer_pred
FROM ({best_lines("bm25_1", LLMS[:1])}) b JOIN qs q ON q.query_id = b.query_id""")
# naive Bayes router: token counts of query and document by best model, on the train split
cte("split_", ("trows",), """
SELECT *, CASE WHEN (('0x' || substr(md5('42|' || CAST(query_id AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), 1, 4))::INTEGER) % 100 < 20
  THEN 'validation' ELSE 'train' END AS split FROM trows""")
cte("ptok", ("best_pairs", "corpus", "qs"), f"""
SELECT query_id, doc_id, token, count(*) AS tf FROM (SELECT p.query_id, p.doc_id, unnest({STD("q.text || ' ' || c.text")}) AS token
  FROM (SELECT DISTINCT query_id, doc_id FROM best_pairs) p JOIN qs q ON q.query_id = p.query_id JOIN corpus c ON c.doc_id = p.doc_id)
GROUP BY query_id, doc_id, token""")
cte("nb_class", ("split_",), "SELECT label, count(*) AS n FROM split_ WHERE split = 'train' GROUP BY label")
cte("nb_tok", ("split_", "ptok"), "SELECT s.label, t.token, sum(t.tf) AS c FROM split_ s JOIN ptok t USING (query_id, doc_id) "
    "WHERE s.split = 'train' GROUP BY s.label, t.token")
cte("nb_vocab", ("nb_tok",), "SELECT DISTINCT token FROM nb_tok")
cte("nb_score", ("ptok", "nb_class", "nb_tok", "nb_vocab", "best_pairs"), """
SELECT a.alpha, p.query_id, p.doc_id, k.label, round(ln(k.n / (SELECT sum(n) FROM nb_class)) + coalesce(sum(t.tf * ln(coalesce(c.c, 0) + a.alpha)), 0)
  - coalesce(sum(t.tf), 0) * ln((SELECT sum(x.c) FROM nb_tok x WHERE x.label = k.label) + a.alpha * (SELECT count(*) FROM nb_vocab)), 9) AS score
FROM (SELECT DISTINCT query_id, doc_id FROM best_pairs) p CROSS JOIN nb_class k CROSS JOIN (VALUES (1.0::DOUBLE), (0.1::DOUBLE)) a(alpha)
LEFT JOIN (SELECT * FROM ptok WHERE token IN (SELECT token FROM nb_vocab)) t ON t.query_id = p.query_id AND t.doc_id = p.doc_id
LEFT JOIN nb_tok c ON c.token = t.token AND c.label = k.label
GROUP BY a.alpha, p.query_id, p.doc_id, k.label, k.n""")
cte("nb_eval", ("nb_score", "split_"), """
SELECT alpha AS smoothing, count(*) AS n_rows, round(avg(-greatest(coalesce(s_y - lse, ln(1e-15)), ln(1e-15))), 6) AS log_loss,
  round(avg(CASE WHEN pred = label THEN 1 ELSE 0 END), 6) AS accuracy
FROM (SELECT v.query_id, v.doc_id, v.label, s.alpha, max(CASE WHEN s.label = v.label THEN s.score END) AS s_y, max(s.score) + ln(sum(exp(s.score - m.top))) AS lse,
             min(CASE WHEN s.score = m.top THEN s.label END) AS pred
      FROM split_ v JOIN nb_score s USING (query_id, doc_id)
      JOIN (SELECT alpha, query_id, doc_id, max(score) AS top FROM nb_score GROUP BY alpha, query_id, doc_id) m
        ON m.alpha = s.alpha AND m.query_id = v.query_id AND m.doc_id = v.doc_id
      WHERE v.split = 'validation' GROUP BY v.query_id, v.doc_id, v.label, s.alpha)
GROUP BY alpha""")
cte("nb_pick", ("nb_score", "nb_eval"), """
SELECT query_id, doc_id, label FROM (SELECT query_id, doc_id, label, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, label) AS rn
  FROM nb_score WHERE alpha = (SELECT smoothing FROM nb_eval ORDER BY log_loss, smoothing DESC LIMIT 1)) WHERE rn = 1""")
cte("dyn", ("nb_pick", "answers"), "SELECT a.query_id, a.doc_id, a.answer, a.llm AS best_llm FROM nb_pick p JOIN answers a "
    "ON a.query_id = p.query_id AND a.doc_id = p.doc_id AND a.llm_idx = p.label")
cte("routed", ("janswers", "trows", "base_ans", "dyn", "corpus", "qs", "qrels"), f"""
SELECT r.routing, {COVER('q.text', 'c.text')} AS ctx, {COVER('q.text', 'r.answer')} AS ans, g.label AS gold,
  CASE WHEN g.label IS NOT NULL THEN CASE WHEN contains({LINE('r.answer')}, {LINE('q.text')}) THEN 1 ELSE 0 END END AS said
FROM (SELECT 'upper_bound' AS routing, j.query_id, j.doc_id, j.answer FROM janswers j
      JOIN trows t ON t.query_id = j.query_id AND t.doc_id = j.doc_id WHERE j.llm_idx = t.label
      UNION ALL SELECT 'baseline', query_id, doc_id, answer FROM base_ans
      UNION ALL SELECT 'dynamic', query_id, doc_id, answer FROM dyn) r
JOIN qs q ON q.query_id = r.query_id JOIN corpus c ON c.doc_id = r.doc_id
LEFT JOIN qrels g ON g.query_id = r.query_id AND g.doc_id = r.doc_id""")
cte("rows_", ("routed",), """
SELECT routing, 'Context_Relevance_Label' AS label_kind, CASE WHEN ctx >= 0.5 THEN 1 ELSE 0 END AS f, gold AS y FROM routed
UNION ALL SELECT routing, 'Answer_Relevance_Label', CASE WHEN ans >= 0.5 THEN 1 ELSE 0 END, said FROM routed""")


def macro_sql(runs_cte: str) -> str:
    """Macro precision/recall/F1 + error classes over a CTE (retriever, query_id, doc_id)."""
    return f"""
SELECT retriever, n_queries, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_score,
       wrong_docs_count, no_docs_count FROM (
  SELECT retriever, count(*) AS n_queries, avg(pq) AS p, avg(rq) AS r,
         CAST(sum(CASE WHEN tp = 0 AND has_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_docs_count,
         CAST(sum(CASE WHEN tp = 0 AND has_s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS no_docs_count
  FROM (
    SELECT r.retriever, r.query_id, r.tp, r.has_s,
           CASE WHEN r.n_ret > 0 THEN r.tp / r.n_ret ELSE 0.0 END AS pq,
           CASE WHEN coalesce(nr.n_rel, 0) > 0 THEN r.tp / nr.n_rel ELSE 0.0 END AS rq
    FROM (
      SELECT s.retriever, s.query_id, count(*) AS n_ret,
             sum(CASE WHEN p.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS tp,
             max(CASE WHEN s.doc_id IS NULL THEN 1 ELSE 0 END) AS has_s
      FROM (SELECT DISTINCT retriever, query_id, doc_id FROM {runs_cte}) s
      LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM qrels WHERE label = 1) p
        ON p.query_id = s.query_id AND p.doc_id = s.doc_id
      GROUP BY s.retriever, s.query_id) r
    LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM (SELECT DISTINCT query_id, doc_id FROM qrels
               WHERE label = 1) GROUP BY query_id) nr ON nr.query_id = r.query_id)
  GROUP BY retriever)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["bm25_topk"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm25_k", "bm25_k")
    q["ground_truth"] = sql("SELECT query_id, doc_id, label FROM qrels", "qrels")
    cte("runs_bm25", ("bm25_k",), "SELECT 'bm25' AS retriever, query_id, doc_id, rank FROM bm25_k")
    q["macro_metrics"] = sql(macro_sql("runs_bm25"), "runs_bm25", "qrels")
    q["corpus_stats"] = sql("""
SELECT (SELECT n FROM st_ws) AS n_docs, round((SELECT sum(dl) FROM dl_ws) / (SELECT n FROM st_ws), 6) AS avgdl,
       count(*) AS n_terms, round(avg(raw), 6) AS mean_idf,
       CAST(sum(CASE WHEN raw < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative_idf FROM rawidf_ws""",
                            "st_ws", "dl_ws", "rawidf_ws")
    q["term_idf"] = sql("SELECT f.token, f.df, round(i.idf, 6) AS idf FROM df_ws f JOIN idf_ws i USING (token)",
                        "df_ws", "idf_ws")
    q["boundary_tokens"] = (f"SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_filter(toks, lambda t: regexp_matches(t, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Cf}}]'))) AS INTEGER) AS n_joined, "
                            f"md5(array_to_string(toks, ' ')) AS tokens_md5 FROM (SELECT doc_id, coalesce({BND('text')}, []) AS toks FROM documents)")
    q["match_boundary_topk"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM boundary_k", "boundary_k")
    q["bm25_std_topk"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM match_k", "match_k")
    q["tfidf_topk"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM tfidf_k", "tfidf_k")
    whole = "CAST(embedding AS DOUBLE[])"
    fold = f"list_transform(generate_series(1, (len(embedding) + 1) // 2), lambda i: ({whole})[i] + ({whole})[len(embedding) + 1 - i])"
    for key, v in (("dense_topk", whole), ("dense_topk_b", fold)):
        q[key] = f"""
WITH e AS (SELECT vec_id, {v} AS v FROM embeddings),
eq AS (SELECT vec_id AS query_id, v, sqrt(list_dot_product(v, v)) AS nv FROM e WHERE vec_id % {QUERY_VECTOR_EVERY} = 0),
ed AS (SELECT vec_id AS doc_id, v, sqrt(list_dot_product(v, v)) AS nv FROM e),
s AS (SELECT eq.query_id, ed.doc_id, CASE WHEN eq.nv > 0 AND ed.nv > 0
        THEN list_dot_product(eq.v, ed.v) / (eq.nv * ed.nv) ELSE 0.0 END AS score FROM eq JOIN ed ON eq.query_id <> ed.doc_id)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT query_id, doc_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id DESC) AS INTEGER) AS rank FROM s)
WHERE rank <= {K}"""
    for key, name in (("dense_text_topk", "dense_a_k"), ("dense_text_topk_b", "dense_b_k")):
        q[key] = sql(f"SELECT query_id, doc_id, rank, round(score, 6) AS score FROM {name}", name)
    q["candidate_union"] = sql("SELECT query_id, doc_id, cand_pos FROM cand", "cand")
    q["hybrid_rerank"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM hyb_k", "hyb_k")
    q["rrf_topk"] = sql("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM rrf_k", "rrf_k")
    q["judge_pairs"] = sql("SELECT retriever, query_id, doc_id, rank, prediction FROM judged", "judged")
    q["relevance_votes"] = sql("SELECT query_id, doc_id, votes, best_rank FROM votes", "votes")
    q["consensus"] = sql("SELECT query_id, doc_id, rank, source FROM cons", "cons")
    q["consensus_best_rank"] = sql("SELECT query_id, doc_id, rank, source FROM cons_br", "cons_br")
    q["consensus_summary"] = sql("""
SELECT count(*) AS total_queries, CAST(sum(n) AS BIGINT) AS total_rows,
       CAST(sum(s) AS BIGINT) AS queries_without_documents, CAST(sum(f) AS BIGINT) AS fallbacks_used
FROM (SELECT query_id, count(*) AS n, max(CASE WHEN source = 'sentinel' THEN 1 ELSE 0 END) AS s,
             max(CASE WHEN source = 'fallback' THEN 1 ELSE 0 END) AS f FROM cons GROUP BY query_id)""", "cons")
    q["coverage_summary"] = sql("""
SELECT count(*) AS total_queries, CAST(sum(CASE WHEN n_rel > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_relevant,
       CAST(coalesce(sum(n_rel), 0) AS BIGINT) AS relevant_rows,
       CAST(sum(CASE WHEN n_rel = 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_without_relevant
FROM (SELECT query_id, sum(prediction) AS n_rel FROM judged WHERE retriever <> 'rrf' GROUP BY query_id)""", "judged")
    q["run_cardinality"] = sql("SELECT retriever, count(DISTINCT query_id) AS n_queries, "
                               "count(DISTINCT doc_id) AS n_documents, count(*) AS n_rows FROM all_runs "
                               "GROUP BY retriever", "all_runs")
    q["leaderboard"] = sql(macro_sql("all_runs"), "all_runs", "qrels")
    q["error_classes"] = sql(f"SELECT retriever, wrong_docs_count, no_docs_count FROM ({macro_sql('all_runs')})",
                             "all_runs", "qrels")
    inacc = """
SELECT s.retriever, s.query_id, s.n_retrieved, coalesce(nr.n_rel, 0) AS n_relevant,
       CASE WHEN s.has_s = 1 THEN 'no_docs' ELSE 'wrong_docs' END AS error_class FROM (
  SELECT r.retriever, r.query_id, count(*) AS n_retrieved,
         sum(CASE WHEN p.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS tp,
         max(CASE WHEN r.doc_id IS NULL THEN 1 ELSE 0 END) AS has_s
  FROM (SELECT DISTINCT retriever, query_id, doc_id FROM all_runs) r
  LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM qrels WHERE label = 1) p
    ON p.query_id = r.query_id AND p.doc_id = r.doc_id GROUP BY r.retriever, r.query_id) s
LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM (SELECT DISTINCT query_id, doc_id FROM qrels WHERE label = 1)
           GROUP BY query_id) nr ON nr.query_id = s.query_id
WHERE s.tp = 0"""
    q["inaccurate_queries"] = sql(inacc, "all_runs", "qrels")
    q["sample_failures"] = sql(f"""
SELECT retriever, query_id, n_retrieved, n_relevant, error_class, sample_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY retriever ORDER BY
    md5(concat_ws('|', '0', retriever, CAST(query_id AS VARCHAR)))) AS INTEGER) AS sample_rank FROM ({inacc}))
WHERE sample_rank <= 5""", "all_runs", "qrels")
    q["micro_metrics"] = sql(f"""
SELECT retriever, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_score,
       round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 6) AS accuracy
FROM (SELECT retriever, tp, fp, fn, tn,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
      FROM (SELECT d.retriever, CAST(coalesce(h.tp, 0) AS BIGINT) AS tp, CAST(coalesce(h.fp, 0) AS BIGINT) AS fp,
                   CAST((SELECT count(*) FROM jq WHERE label = 1) - coalesce(h.tp, 0) AS BIGINT) AS fn,
                   CAST((SELECT count(*) FROM jq WHERE label = 0) - coalesce(h.fp, 0) AS BIGINT) AS tn
            FROM (SELECT * FROM (VALUES ('bm25'), ('tfidf'), ('dense_a'), ('dense_b'), ('match'), ('hybrid'), ('rrf'), ('consensus')) t(retriever)) d
            LEFT JOIN (SELECT c.retriever, sum(CASE WHEN j.label = 1 THEN 1 ELSE 0 END) AS tp,
                              sum(CASE WHEN j.label = 0 THEN 1 ELSE 0 END) AS fp
                       FROM (SELECT DISTINCT retriever, query_id, doc_id FROM all_runs WHERE rank <= {K}) c
                       JOIN jq j ON j.query_id = c.query_id AND j.doc_id = c.doc_id GROUP BY c.retriever) h
            ON h.retriever = d.retriever))""", "all_runs", "jq")
    q["best_retriever_docs"] = sql(f"""
SELECT retriever, query_id, doc_id, rank FROM all_runs WHERE doc_id IS NOT NULL AND retriever = (
  SELECT b.retriever FROM ({macro_sql('all_runs')}) b JOIN
    (VALUES ('bm25', 0), ('tfidf', 1), ('dense_a', 2), ('dense_b', 3), ('match', 4), ('hybrid', 5), ('rrf', 6), ('consensus', 7)) d(retriever, idx)
    ON d.retriever = b.retriever ORDER BY b.f1_score DESC, d.idx LIMIT 1)""", "all_runs", "qrels")
    q["ppi_estimate"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN len({WS('text')}) > {MIN_WORDS_EXCLUSIVE} THEN 1 ELSE 0 END AS f FROM documents),
u AS (SELECT 'all' AS scope, count(*) AS n_unlabelled, avg(f) AS mean_f, var_pop(f) AS var_f
      FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
l AS (SELECT 'all' AS scope, count(*) AS n_labelled, avg(y - f) AS mean_rect, var_pop(y - f) AS var_rect,
             avg(y) AS gold_mean FROM (SELECT d.f, CAST(lb.quality AS DOUBLE) AS y FROM d JOIN labels lb USING (doc_id)))
SELECT scope, n_unlabelled, n_labelled, round(mean_f, 6) AS judge_mean, round(gold_mean, 6) AS gold_mean,
       round(mean_f + mean_rect, 6) AS estimate,
       round(mean_f + mean_rect - 1.96 * sqrt(var_f / n_unlabelled + var_rect / n_labelled), 6) AS ci_low,
       round(mean_f + mean_rect + 1.96 * sqrt(var_f / n_unlabelled + var_rect / n_labelled), 6) AS ci_high
FROM u FULL JOIN l USING (scope)"""
    CTES["board"] = (CTES["board"][0], macro_sql("all_runs"))
    raw = """
SELECT p.query_id, p.doc_id, q.text AS Query, c.text AS Document,
  CASE WHEN r.label = 1 THEN '[[Yes]]' WHEN r.label = 0 THEN '[[No]]'
       WHEN p.doc_id IN (SELECT doc_id FROM labels) THEN 'N/A' ELSE 'None' END AS Context_Relevance_Label
FROM (SELECT DISTINCT query_id, doc_id FROM pool) p LEFT JOIN qrels r ON r.query_id = p.query_id
  AND r.doc_id = p.doc_id JOIN qs q ON q.query_id = p.query_id JOIN corpus c ON c.doc_id = p.doc_id"""
    q["scan_tsv"] = sql(raw, "pool", "qrels", "qs", "corpus")
    q["clean_pairs"] = sql(f"""SELECT query_id, doc_id, CASE WHEN Context_Relevance_Label = '[[Yes]]' THEN 1 ELSE 0 END
  AS label FROM ({raw}) WHERE Context_Relevance_Label IN ('[[Yes]]', '[[No]]')""", "pool", "qrels", "qs", "corpus")
    q["parse_labels"] = f"""
SELECT u.conv_id, u.turn, CASE WHEN {COVER('u.text', 'a.text')} >= 0.5 THEN 1 ELSE 0 END AS answer_relevance
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""
    q["min_words"] = (f"SELECT doc_id, CAST(len({WS('text')}) AS INTEGER) AS n_words FROM documents "
                      f"WHERE len({WS('text')}) > {MIN_WORDS_EXCLUSIVE}")
    q["distinct_docs"] = sql("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM docs_ok GROUP BY text", "docs_ok")
    q["distinct_queries"] = "SELECT min(item_id) AS query_id, text FROM benchmark GROUP BY text"
    q["first_n_queries"] = ("SELECT query_id, text FROM (SELECT min(item_id) AS query_id, text FROM benchmark "
                            "GROUP BY text) ORDER BY query_id LIMIT 10")
    q["semi_queries"] = sql("SELECT query_id, doc_id, rank FROM pool WHERE query_id IN "
                            "(SELECT query_id FROM qrels WHERE label = 1)", "pool", "qrels")
    q["blank_query_guard"] = sql(f"""
SELECT b.item_id AS query_id, CAST(CASE WHEN {BLANK('b.text')} THEN 1 ELSE 0 END AS INTEGER) AS is_blank,
  coalesce(r.doc_ids, '') AS doc_ids, coalesce(r.n, 0) AS n_results
FROM benchmark b LEFT JOIN (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids,
  count(*) AS n FROM bm25_k GROUP BY query_id) r ON r.query_id = b.item_id""", "bm25_k")
    q["runs_as_lists"] = sql("SELECT retriever, query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) "
                             "AS doc_ids FROM fused_runs GROUP BY retriever, query_id", "fused_runs")
    q["explode_runs"] = sql("SELECT retriever, query_id, doc_id, rank FROM fused_runs", "fused_runs")
    q["scalar_text"] = f"""
SELECT item_id AS query_id, CAST(len({WS('text')}) AS INTEGER) AS n_ws_tokens,
  CAST(len({STD('text')}) AS INTEGER) AS n_std_tokens,
  CAST(CASE WHEN {BLANK('text')} THEN 1 ELSE 0 END AS INTEGER) AS is_blank,
  CAST(length('Query: ' || text || {NL} || 'Document: ' || {NL} || 'Answer:') AS INTEGER) AS prompt_chars,
  CAST(least(512, len({WS('text')}) + len({STD('text')})) AS INTEGER) AS capped_tokens FROM benchmark"""
    names = [*(f"'{n}'" for n in ("bm25", "tfidf", "dense_a", "dense_b", "match", "hybrid", "rrf", "consensus")), *(f"'{n}_relevant'" for n in ("bm25", "tfidf", "dense_a", "dense_b", "match", "hybrid", "rrf"))]
    q["missing_queries"] = sql(f"""
SELECT d.retriever, b.item_id AS query_id FROM (SELECT unnest([{', '.join(names)}]) AS retriever) d CROSS JOIN benchmark b
WHERE (d.retriever, b.item_id) NOT IN (SELECT retriever, query_id FROM all_runs UNION ALL
  SELECT retriever || '_relevant', query_id FROM judged WHERE prediction = 1)""", "all_runs", "judged")
    q["missing_members"] = sql("""
SELECT e.member, e.kind, CASE WHEN e.member IN (SELECT retriever FROM all_runs UNION SELECT llm FROM answers)
  THEN 1 ELSE 0 END AS present
FROM (VALUES ('bm25', 'retriever'), ('tfidf', 'retriever'), ('dense_a', 'retriever'), ('dense_b', 'retriever'), ('match', 'retriever'), ('hybrid', 'retriever'),
             ('rrf', 'retriever'), ('consensus', 'retriever'), ('coverage', 'llm'), ('density', 'llm'),
             ('length', 'llm'), ('not_run', 'retriever'), ('not_asked', 'llm')) e(member, kind)""", "all_runs", "answers")
    q["scan_runs_dir"] = sql("SELECT retriever, query_id, doc_id, rank FROM fused_runs", "fused_runs")
    q["scan_judged_dir"] = sql("SELECT retriever, query_id, doc_id, rank, prediction FROM judged "
                               "WHERE retriever <> 'rrf'", "judged")
    q["incremental_backfill"] = sql("SELECT retriever, query_id, doc_id, rank FROM base_runs", "base_runs")
    q["generate_answers"] = sql("SELECT llm, query_id, doc_id, answer FROM answers", "answers")
    q["llm_scores"] = sql("SELECT llm, llm_idx, count(*) AS n_answers, count(prediction) AS n_scored, "
                          "round(avg(prediction), 6) AS score FROM janswers GROUP BY llm, llm_idx", "janswers")
    q["best_llm"] = sql("SELECT llm, score FROM (SELECT llm, llm_idx, round(avg(prediction), 6) AS score FROM janswers "
                        "GROUP BY llm, llm_idx) WHERE score IS NOT NULL ORDER BY score DESC, llm_idx LIMIT 1", "janswers")
    q["router_training_rows"] = sql("SELECT query_id, doc_id, best_llm, label FROM trows", "trows")
    q["hash_split"] = sql("""
SELECT query_id, doc_id, CASE WHEN (('0x' || substr(md5('42|' || CAST(query_id AS VARCHAR) || '|' ||
  CAST(doc_id AS VARCHAR)), 1, 4))::INTEGER) % 100 < 20 THEN 'validation' ELSE 'train' END AS split
FROM trows""", "trows")
    q["baseline_routing"] = sql("SELECT query_id, doc_id, answer FROM base_ans", "base_ans")
    q["routing_eval"] = sql("""
SELECT coalesce(u.routing, l.routing) AS routing, coalesce(u.label_kind, l.label_kind) AS label_kind,
  n_unlabelled, n_labelled, round(mean_f, 6) AS judge_mean, round(gold_mean, 6) AS gold_mean,
  round(mean_f + mean_rect, 6) AS estimate,
  round(mean_f + mean_rect - 1.96 * sqrt(var_f / n_unlabelled + var_rect / n_labelled), 6) AS ci_low,
  round(mean_f + mean_rect + 1.96 * sqrt(var_f / n_unlabelled + var_rect / n_labelled), 6) AS ci_high
FROM (SELECT routing, label_kind, count(*) AS n_unlabelled, avg(f) AS mean_f, var_pop(f) AS var_f FROM rows_
      WHERE y IS NULL GROUP BY routing, label_kind) u
FULL JOIN (SELECT routing, label_kind, count(*) AS n_labelled, avg(y - f) AS mean_rect, var_pop(y - f) AS var_rect, avg(y) AS gold_mean
           FROM rows_ WHERE y IS NOT NULL GROUP BY routing, label_kind) l
ON u.routing = l.routing AND u.label_kind = l.label_kind""", "rows_")
    q["router_eval"] = sql("SELECT smoothing, n_rows, log_loss, accuracy FROM nb_eval", "nb_eval")
    q["dynamic_routing"] = sql("SELECT query_id, doc_id, answer, best_llm FROM dyn", "dyn")
    nofuse = """SELECT query_id, doc_id, rank, source, 'fusion.tsv' AS fusion_file FROM cons UNION ALL
SELECT query_id, doc_id, rank, source, 'absent.tsv' FROM chosen UNION ALL SELECT query_id, NULL, 1, 'sentinel', 'absent.tsv' FROM without"""
    q["consensus_from_files"] = sql(nofuse, "cons", "chosen", "without")
    q["answer_external"] = sql("SELECT llm, query_id, doc_id, answer FROM answers", "answers")
    prompt = f"'Query: ' || q.text || {NL} || 'Document: ' || c.text || {NL} || 'Answer:'"
    q["error_isolation"] = sql(f"""
SELECT a.llm, a.query_id, a.doc_id, CASE WHEN f.failed = 0 THEN a.answer END AS answer, f.failed FROM answers a JOIN (
  SELECT p.query_id, p.doc_id, CASE WHEN substr(md5({prompt}), 1, 1) < '4' THEN 1 ELSE 0 END AS failed
  FROM (SELECT DISTINCT query_id, doc_id FROM best_pairs) p JOIN corpus c ON c.doc_id = p.doc_id
  JOIN qs q ON q.query_id = p.query_id) f ON f.query_id = a.query_id AND f.doc_id = a.doc_id""", "answers", "best_pairs", "corpus", "qs")
    q["best_retriever_docs"] = sql("SELECT retriever, query_id, doc_id, rank FROM best_pairs", "best_pairs")
    q["answer_ledger"] = sql(f"""
SELECT a.llm, a.query_id, a.doc_id, CASE WHEN f.h < '4' THEN '{DEFAULT_FAILED_ANSWER}' ELSE a.answer END AS answer,
  CASE WHEN f.h >= '2' AND f.h < '4' THEN {MAX_ATTEMPTS} ELSE 1 END AS attempts,
  CASE WHEN f.h < '2' THEN 'permanent' WHEN f.h < '4' THEN 'transient' END AS error_class
FROM answers a JOIN (SELECT p.query_id, p.doc_id, substr(md5({prompt}), 1, 1) AS h
  FROM (SELECT DISTINCT query_id, doc_id FROM best_pairs) p JOIN corpus c ON c.doc_id = p.doc_id
  JOIN qs q ON q.query_id = p.query_id) f ON f.query_id = a.query_id AND f.doc_id = a.doc_id""", "answers", "best_pairs", "corpus", "qs")
    q["saved_routing"] = q["routing_from_files"] = q["dynamic_routing"]
    q["example_judge_fit"] = sql("SELECT threshold, n_examples, n_right FROM ex_fit", "ex_fit")
    q["judge_by_examples"] = sql("SELECT retriever, query_id, doc_id, rank, example_score, prediction FROM ex_judged", "ex_judged")
    return q
