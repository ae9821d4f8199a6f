"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per operator key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import std_tokens
from ..operators import consensus as consensus_ops
from ..operators import fusion, lexical, metrics
from ..operators import example_judge, ledger, model_table
from .externals import answer, answer_or_fail, answer_or_refuse
from .fixtures import ALL_RETRIEVERS, fixtures

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _round(df: DataFrame, col: str = "score", digits: int = 6) -> DataFrame:
    return df.withColumn(col, F.round(col, digits))


@register("bm25_topk")
def bm25_topk(spark, sf_dir):
    """Okapi BM25 top-3 per benchmark query over the cleaned corpus."""
    return _round(fixtures(spark, sf_dir).bm25())


@register("ground_truth")
def ground_truth(spark, sf_dir):
    """Judged pairs: containment positives + pooled, labelled negatives."""
    return fixtures(spark, sf_dir).qrels


@register("macro_metrics")
def macro_metrics(spark, sf_dir):
    """Macro precision, recall, F1 and error classes of BM25 top-3."""
    fx = fixtures(spark, sf_dir)
    return metrics.macro_metrics(fx.with_retriever(fx.bm25(), "bm25"), fx.qrels)


@register("corpus_stats")
def corpus_stats(spark, sf_dir):
    """A1: documents, average length, vocabulary size and mean Okapi idf of the whitespace index."""
    ix = fixtures(spark, sf_dir).ws_index
    n_docs = ix.corpus.agg(F.count(F.lit(1))).scalar()
    raw = lexical.bm25_okapi_idf(n_docs, F.col("df"))
    terms = ix.term_df.agg(F.count(F.lit(1)).alias("n_terms"), F.avg(raw).alias("mean_idf"),
                           F.sum(F.when(raw < 0, 1).otherwise(0)).cast("long").alias("n_negative_idf"))
    total = ix.postings.agg(F.sum("tf")).scalar()
    return terms.select(n_docs.alias("n_docs"), F.round(total / n_docs, 6).alias("avgdl"),
                        "n_terms", F.round("mean_idf", 6).alias("mean_idf"), "n_negative_idf")


@register("term_idf")
def term_idf(spark, sf_dir):
    """A1: document frequency and effective Okapi idf (negative idf floored) of every term."""
    ix = fixtures(spark, sf_dir).ws_index
    idf = lexical.okapi_idf_column(ix, lexical.OKAPI_EPSILON)
    return ix.term_df.select("token", "df", F.round(idf, 6).alias("idf"))


@register("bm25_std_topk")
def bm25_std_topk(spark, sf_dir):
    """Full-text match on standard-analyzer tokens; only matching documents."""
    return _round(fixtures(spark, sf_dir).match())


@register("boundary_tokens")
def boundary_tokens(spark, sf_dir):
    """Words by Unicode word boundaries, of every document: their number, how many hold a joiner, and their md5."""
    toks = F.coalesce(T.boundary_tokens("text"), F.array().cast("array<string>"))
    joined = F.size(F.filter("toks", lambda t: t.rlike(r"[^\p{L}\p{N}\p{M}\p{Cf}]")))
    return (fixtures(spark, sf_dir).table("documents").select("doc_id", toks.alias("toks"))
            .select("doc_id", F.size("toks").alias("n_tokens"), joined.alias("n_joined"), F.md5(F.array_join("toks", " ")).alias("tokens_md5")))


@register("match_boundary_topk")
def match_boundary_topk(spark, sf_dir):
    """Full-text match on words by Unicode word boundaries."""
    return _round(fixtures(spark, sf_dir).boundary_match())


@register("tfidf_topk")
def tfidf_topk(spark, sf_dir):
    """U1/R2 stand-in: tf-idf cosine top-3 over the whole corpus."""
    return _round(fixtures(spark, sf_dir).tfidf_run())


@register("dense_topk")
def dense_topk(spark, sf_dir):
    """Exact cosine top-3 over the 64-dim embeddings."""
    return _round(fixtures(spark, sf_dir).dense())


@register("dense_topk_b")
def dense_topk_b(spark, sf_dir):
    """The same operator on a second encoder (the vectors folded in the middle)."""
    return _round(fixtures(spark, sf_dir).dense("b"))


@register("dense_text_topk")
def dense_text_topk(spark, sf_dir):
    """Cosine top-3 of the first hashed text encoder over the corpus."""
    return _round(fixtures(spark, sf_dir).dense_text("dense_a"))


@register("dense_text_topk_b")
def dense_text_topk_b(spark, sf_dir):
    """The same with the second text encoder."""
    return _round(fixtures(spark, sf_dir).dense_text("dense_b"))


@register("dense_learned_topk")
def dense_learned_topk(spark, sf_dir):
    """Cosine top-3 of the encoder learned from the corpus; no SQL, tests compare with a dense decomposition."""
    return _round(fixtures(spark, sf_dir).dense_learned())


@register("encoder_board")
def encoder_board(spark, sf_dir):
    """Macro precision, recall and F1 of the hashed and the learned encoders' runs."""
    return fixtures(spark, sf_dir).encoder_board()


@register("candidate_union")
def candidate_union(spark, sf_dir):
    """D3: ordered union of BM25 and match lists, first occurrence wins."""
    fx = fixtures(spark, sf_dir)
    return fusion.candidate_union(fx.bm25(), fx.match())


@register("hybrid_rerank")
def hybrid_rerank(spark, sf_dir):
    """Candidates reranked by tf-idf cosine, stable, cut to 3."""
    return _round(fixtures(spark, sf_dir).hybrid())


@register("rrf_topk")
def rrf_topk(spark, sf_dir):
    """Reciprocal rank fusion of the stored runs."""
    return _round(fixtures(spark, sf_dir).rrf)


@register("judge_pairs")
def judge_pairs(spark, sf_dir):
    """0/1 context-relevance prediction for every retrieved pair (fusion included)."""
    j = fixtures(spark, sf_dir).judged
    return j.select("retriever", "query_id", "doc_id", "rank", "prediction")


@register("relevance_votes")
def relevance_votes(spark, sf_dir):
    """A4: relevant votes per (query, document) over the non-fusion retrievers."""
    return consensus_ops.relevance_votes(fixtures(spark, sf_dir).judged)


@register("consensus")
def consensus(spark, sf_dir):
    """Judged consensus, capped fusion fallback, sentinel."""
    return fixtures(spark, sf_dir).consensus()


@register("consensus_best_rank")
def consensus_best_rank(spark, sf_dir):
    """Consensus with equal votes ordered by best original rank."""
    return fixtures(spark, sf_dir).consensus(tie_break="best_rank")


@register("consensus_summary")
def consensus_summary(spark, sf_dir):
    """Queries processed, rows saved, queries without documents, fallbacks used."""
    return consensus_ops.consensus_summary(fixtures(spark, sf_dir).consensus())


@register("coverage_summary")
def coverage_summary(spark, sf_dir):
    """Coverage of the judged (non-fusion) results."""
    j = fixtures(spark, sf_dir).judged
    return metrics.coverage_summary(j.where(F.col("retriever") != "rrf"))


@register("run_cardinality")
def run_cardinality(spark, sf_dir):
    """Distinct queries and documents per retriever."""
    return metrics.run_cardinality(fixtures(spark, sf_dir).all_runs)


@register("error_classes")
def error_classes(spark, sf_dir):
    """A10: no-hit queries per retriever split into no_docs / wrong_docs."""
    fx = fixtures(spark, sf_dir)
    return metrics.macro_metrics(fx.all_runs, fx.qrels).select("retriever", "wrong_docs_count", "no_docs_count")


@register("inaccurate_queries")
def inaccurate_queries(spark, sf_dir):
    """A10 rows: each failing (retriever, query) with its set sizes and class."""
    fx = fixtures(spark, sf_dir)
    return metrics.inaccurate_queries(fx.all_runs, fx.qrels)


@register("sample_failures")
def sample_failures(spark, sf_dir):
    """A repeatable sample of up to 5 failing queries per retriever."""
    fx = fixtures(spark, sf_dir)
    return metrics.sample_failures(metrics.inaccurate_queries(fx.all_runs, fx.qrels), 5, seed=0)


@register("leaderboard")
def leaderboard(spark, sf_dir):
    """Macro metrics of every retriever, fusion and consensus included."""
    fx = fixtures(spark, sf_dir)
    return metrics.macro_metrics(fx.all_runs, fx.qrels)


@register("micro_metrics")
def micro_metrics(spark, sf_dir):
    """Micro confusion counts and ratios per retriever over judged pairs."""
    fx = fixtures(spark, sf_dir)
    return metrics.micro_metrics(fx.all_runs, fx.qrels, fx.retriever_dim(), fx.k)


@register("best_retriever_docs")
def best_retriever_docs(spark, sf_dir):
    """The pairs of the retriever with the best macro F1 (ties: retriever order)."""
    return fixtures(spark, sf_dir).best_pairs


@register("ppi_estimate")
def ppi_estimate(spark, sf_dir):
    """Prediction-powered estimate of document quality.

    Judge f: the document is kept by the cleaning rule (> 50 words); gold y:
    ``labels.quality``. Unlabelled = documents without a label.
    """
    fx = fixtures(spark, sf_dir)
    from ..functions.text import word_count
    docs = fx.table("documents").select("doc_id", (word_count("text") > 50).cast("int").alias("f"))
    labels = fx.table("labels").select("doc_id", F.col("quality").alias("y"))
    return metrics.ppi_estimate(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id"))


# --- cleaning, sets, scalar functions ---------------------------------------------

from ..functions import text as T  # noqa: E402
from ..operators import generate, gradient_router, router  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import tables, tsv  # noqa: E402

RAW_PAIRS_SCHEMA = ("query_id long, doc_id long, Query string, Document string, "
                    "Context_Relevance_Label string")


def raw_judged_pairs(fx) -> DataFrame:
    """The judged-pairs file as the original pipeline reads it: the pool
    with texts and a text label ([[Yes]] / [[No]] when judged, 'N/A' for an
    unjudged labelled document, 'None' otherwise)."""
    labelled = fx.table("labels").select("doc_id").distinct().withColumn("has_label", F.lit(1))
    lab = F.when(F.col("label") == 1, F.lit(T.LABEL_YES)).when(F.col("label") == 0, F.lit(T.LABEL_NO)) \
        .when(F.col("has_label") == 1, F.lit("N/A")).otherwise(F.lit("None"))
    return (fx.pool.select("query_id", "doc_id")
            .join(fx.qrels, ["query_id", "doc_id"], "left")
            .join(labelled, "doc_id", "left")
            .join(fx.queries.select("query_id", F.col("text").alias("Query")), "query_id")
            .join(fx.corpus.select("doc_id", F.col("text").alias("Document")), "doc_id")
            .select("query_id", "doc_id", "Query", "Document", lab.alias("Context_Relevance_Label")))


@register("scan_tsv")
def scan_tsv(spark, sf_dir):
    """Judged pairs written as TSV (quoted, multi-line) and read back with a schema."""
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "judged_pairs.tsv")
    tsv.write_tsv(raw_judged_pairs(fx), path)
    return tsv.read_tsv(spark, path, RAW_PAIRS_SCHEMA)


@register("clean_pairs")
def clean_pairs(spark, sf_dir):
    """Drop NA-like labels, parse the rest to 0/1."""
    raw = scan_tsv(spark, sf_dir)
    lab = T.label_to_int("Context_Relevance_Label")
    return raw.select("query_id", "doc_id", lab.alias("label")).dropna(subset=["label"])


@register("parse_labels")
def parse_labels(spark, sf_dir):
    """Few-shot examples (user turn, next assistant turn, [[Yes]]/[[No]]) round-tripped
    through TSV and parsed; the label says whether the answer covers half the question's terms."""
    return labelled_examples(spark, sf_dir).select("conv_id", "turn", F.col("label").alias("answer_relevance"))


def labelled_examples(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, Query, Answer, label) as read from the TSV of few-shot examples."""
    from ..operators.consensus import coverage
    conv = fixtures(spark, sf_dir).table("conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("Query"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Answer"))
    ex = u.join(a, ["conv_id", "turn"]).withColumn(
        "Answer_Relevance_Label",
        F.when(coverage("Query", "Answer") >= 0.5, F.lit(T.LABEL_YES)).otherwise(F.lit(T.LABEL_NO)))
    path = scratch_path(spark, "few_shot.tsv")
    tsv.write_tsv(ex, path)
    back = tsv.read_tsv(spark, path, "conv_id long, turn long, Query string, Answer string, "
                                     "Answer_Relevance_Label string")
    tsv.require_columns(back, ["Query", "Answer", "Answer_Relevance_Label"])
    return back.select("conv_id", "turn", "Query", "Answer", T.parse_yes_no("Answer_Relevance_Label").alias("label"))


def _example_judge(spark, sf_dir) -> example_judge.ExampleJudge:
    return example_judge.fit(labelled_examples(spark, sf_dir), fixtures(spark, sf_dir).cut)


@register("example_judge_fit")
def example_judge_fit(spark, sf_dir):
    """Per threshold, the few-shot examples that the others judge rightly."""
    return _example_judge(spark, sf_dir).fit


@register("judge_by_examples")
def judge_by_examples(spark, sf_dir):
    """Retrieved pairs judged by the nearest few-shot examples, with the threshold fitted on them."""
    fx = fixtures(spark, sf_dir)
    j = example_judge.judge_pairs(fx.runs, fx.corpus, fx.queries, _example_judge(spark, sf_dir), fx.cut, small=fx.small)
    return j.select("retriever", "query_id", "doc_id", "rank", "example_score", "prediction")


@register("min_words")
def min_words(spark, sf_dir):
    """Documents with strictly more than 50 whitespace words."""
    docs = fixtures(spark, sf_dir).table("documents")
    return tables.min_words(docs).select("doc_id", T.word_count("text").alias("n_words"))


@register("distinct_docs")
def distinct_docs(spark, sf_dir):
    """One id per distinct kept text (the smallest) and how many rows carried it."""
    docs = tables.min_words(fixtures(spark, sf_dir).table("documents"))
    return (docs.groupBy(F.sha2("text", 256).alias("h"))
            .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
            .select("doc_id", "n_copies"))


@register("distinct_queries")
def distinct_queries(spark, sf_dir):
    """Distinct query texts (smallest id kept)."""
    q = fixtures(spark, sf_dir).queries
    return q.groupBy("text").agg(F.min("query_id").alias("query_id")).select("query_id", "text")


@register("first_n_queries")
def first_n_queries(spark, sf_dir):
    """The first 10 distinct queries in order of appearance (the cap, 1000 by default, is the feature)."""
    return tables.first_queries(distinct_queries(spark, sf_dir), 10)


@register("semi_queries")
def semi_queries(spark, sf_dir):
    """Pooled results kept only for queries that have a relevant document."""
    fx = fixtures(spark, sf_dir)
    pos = fx.qrels.where(F.col("label") == 1).select("query_id")
    return fx.pool.join(pos, "query_id", "left_semi").select("query_id", "doc_id", "rank")


def _as_list(col="doc_id") -> "F.Column":
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", col))),
                                    lambda s: s[col].cast("string")), ",")


@register("blank_query_guard")
def blank_query_guard(spark, sf_dir):
    """Every query listed; blank ones get an empty result, never an error."""
    fx = fixtures(spark, sf_dir)
    res = fx.bm25().groupBy("query_id").agg(_as_list().alias("doc_ids"), F.count(F.lit(1)).alias("n_results"))
    return (fx.queries.select("query_id", T.is_blank("text").cast("int").alias("is_blank"))
            .join(res, "query_id", "left")
            .select("query_id", "is_blank", F.coalesce("doc_ids", F.lit("")).alias("doc_ids"),
                    F.coalesce("n_results", F.lit(0)).alias("n_results")))


@register("runs_as_lists")
def runs_as_lists(spark, sf_dir):
    """A5: documents per (retriever, query) as an ordered list (joined as text)."""
    r = fixtures(spark, sf_dir).runs
    return r.groupBy("retriever", "query_id").agg(_as_list().alias("doc_ids"))


@register("explode_runs")
def explode_runs(spark, sf_dir):
    """nested lists back to one row per (query, document) with the position as rank."""
    r = fixtures(spark, sf_dir).runs
    lists = r.groupBy("retriever", "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"])
        .alias("docs"))
    return lists.select("retriever", "query_id", F.posexplode("docs").alias("pos", "doc_id")) \
        .select("retriever", "query_id", "doc_id", (F.col("pos") + 1).cast("int").alias("rank"))


@register("scalar_text")
def scalar_text(spark, sf_dir, cap=512):
    """Token counts, blank test, prompt length, tokens within the cap."""
    q = fixtures(spark, sf_dir).queries
    return q.select("query_id",
                    F.size(T.ws_tokens("text")).alias("n_ws_tokens"),
                    F.size(T.std_tokens("text")).alias("n_std_tokens"),
                    T.is_blank("text").cast("int").alias("is_blank"),
                    F.length(T.prompt("text", F.lit(""))).alias("prompt_chars"),
                    F.size(T.token_cap(T.ws_tokens("text"), T.std_tokens("text"), cap)).alias("capped_tokens"))


@register("missing_queries")
def missing_queries(spark, sf_dir):
    """Per retriever, the queries it returned nothing for; besides the runs, the judged-relevant ones of each."""
    from .fixtures import BASE_RETRIEVERS
    fx = fixtures(spark, sf_dir)
    relevant = fx.judged.where("prediction = 1").select(F.concat("retriever", F.lit("_relevant")).alias("retriever"), "query_id")
    runs = fx.all_runs.select("retriever", "query_id").unionByName(relevant).distinct()
    names = [*ALL_RETRIEVERS, *(f"{n}_relevant" for n in (*BASE_RETRIEVERS, "rrf"))]
    expected = fx.queries.select(F.explode(F.array(*map(F.lit, names))).alias("retriever"), "query_id")
    return expected.join(runs, ["retriever", "query_id"], "left_anti")


@register("missing_members")
def missing_members(spark, sf_dir):
    """Expected retrievers and models against what the stored results contain."""
    fx = fixtures(spark, sf_dir)
    expected = spark.createDataFrame(
        [(n, "retriever") for n in (*ALL_RETRIEVERS, "not_run")] + [(n, "llm") for n in (*generate.PROVIDERS, "not_asked")],
        "member string, kind string")
    present = (fx.all_runs.select(F.col("retriever").alias("member")).distinct()
               .unionByName(fx.answers.select(F.col("llm").alias("member")).distinct())
               .withColumn("present", F.lit(1)))
    return (expected.join(present, "member", "left")
            .select("member", "kind", F.coalesce("present", F.lit(0)).alias("present")))


RUN_SCHEMA = "query_id long, doc_id long, rank int"


@register("scan_runs_dir")
def scan_runs_dir(spark, sf_dir):
    """One TSV folder per retriever, read back with one glob; name from the path."""
    fx = fixtures(spark, sf_dir)
    d = scratch_path(spark, "runs")
    for name in ALL_RETRIEVERS[:-1]:
        tsv.write_tsv(fx.runs.where(F.col("retriever") == name).select("query_id", "doc_id", "rank"),
                      f"{d}/{name}_results.tsv")
    return tsv.read_suffix_dir(spark, d, "_results.tsv", RUN_SCHEMA) \
        .select("retriever", "query_id", "doc_id", "rank")


@register("scan_judged_dir")
def scan_judged_dir(spark, sf_dir):
    """S3: judged files by suffix, the fusion file excluded, required columns checked."""
    fx = fixtures(spark, sf_dir)
    d = scratch_path(spark, "judged")
    for name in ALL_RETRIEVERS[:-1]:
        tsv.write_tsv(fx.judged.where(F.col("retriever") == name)
                      .select("query_id", "doc_id", "rank", "prediction"), f"{d}/{name}_judged.tsv")
    df = tsv.read_suffix_dir(spark, d, "_judged.tsv",
                             "query_id long, doc_id long, rank int, prediction int", exclude=("rrf",))
    tsv.require_columns(df, ["query_id", "doc_id", "prediction"])
    return df.select("retriever", "query_id", "doc_id", "rank", "prediction")


@register("consensus_from_files")
def consensus_from_files(spark, sf_dir):
    """The consensus of judged files, with the fusion file and, without one, no fallback."""
    from .fixtures import BASE_RETRIEVERS
    fx = fixtures(spark, sf_dir)
    d = scratch_path(spark, "consensus-files")
    for name in (*BASE_RETRIEVERS, "rrf"):
        tsv.write_tsv(fx.judged.where(F.col("retriever") == name).select("prediction", "rank", "doc_id", "query_id"), f"{d}/{name}_judged.tsv")
    tsv.write_tsv(fx.rrf.select("query_id", "doc_id", "rank"), f"{d}/fusion.tsv")
    tsv.require_members(spark, d, "_judged.tsv", BASE_RETRIEVERS)
    judged = tsv.read_suffix_dir(spark, d, "_judged.tsv", "query_id long, doc_id long, rank int, prediction int", exclude=("rrf",))
    out = None
    for fusion_file in ("fusion.tsv", "absent.tsv"):
        fused = tsv.read_optional(spark, f"{d}/{fusion_file}", RUN_SCHEMA)
        own = consensus_ops.consensus(judged, fused, fx.corpus, fx.queries, fx.k, small=fx.small).withColumn("fusion_file", F.lit(fusion_file))
        out = own if out is None else out.unionByName(own)
    return out


@register("incremental_backfill")
def incremental_backfill(spark, sf_dir):
    """Stage outputs are written only if absent; a second pass computes only the
    retrievers the folder lacks (anti-join of the expected set with what is stored)."""
    from .fixtures import BASE_RETRIEVERS
    fx = fixtures(spark, sf_dir)
    d = scratch_path(spark, "backfill")
    for name in ("bm25", "match"):                       # first pass
        tsv.write_tsv(fx.runs.where(F.col("retriever") == name).select("query_id", "doc_id", "rank"),
                      f"{d}/{name}_results.tsv", mode="ignore")
    stored = tsv.read_suffix_dir(spark, d, "_results.tsv", RUN_SCHEMA)
    expected = spark.createDataFrame([(n,) for n in BASE_RETRIEVERS], "retriever string")
    todo = [r["retriever"] for r in tsv.missing_work(expected, stored, ["retriever"]).collect()]
    for name in todo:                                    # second pass: only what is missing
        tsv.write_tsv(fx.runs.where(F.col("retriever") == name).select("query_id", "doc_id", "rank"),
                      f"{d}/{name}_results.tsv", mode="ignore")
    return tsv.read_suffix_dir(spark, d, "_results.tsv", RUN_SCHEMA) \
        .select("retriever", "query_id", "doc_id", "rank")


# --- generation and routing ------------------------------------------------------


@register("generate_answers")
def generate_answers(spark, sf_dir):
    """Every model answers every pair of the best retriever."""
    return fixtures(spark, sf_dir).answers.select("llm", "query_id", "doc_id", "answer")


@register("llm_scores")
def llm_scores(spark, sf_dir):
    """Mean judged answer relevance per model."""
    return generate.llm_scores(fixtures(spark, sf_dir).judged_answers)


@register("best_llm")
def best_llm(spark, sf_dir):
    """The best model overall (ties to the earlier model)."""
    return generate.best_llm(generate.llm_scores(fixtures(spark, sf_dir).judged_answers))


@register("router_training_rows")
def router_training_rows(spark, sf_dir):
    """Best model per (query, document) and its label index."""
    return fixtures(spark, sf_dir).training_rows


@register("hash_split")
def hash_split(spark, sf_dir):
    """U4: stable 80/20 train/validation split by the md5 of the pair key."""
    return router.hash_split(fixtures(spark, sf_dir).training_rows).select("query_id", "doc_id", "split")


@register("baseline_routing")
def baseline_routing(spark, sf_dir):
    """BM25 top-1 per query answered by one fixed model."""
    fx = fixtures(spark, sf_dir)
    return fx.baseline_answers.select("query_id", "doc_id", "answer")


@register("routing_eval")
def routing_eval(spark, sf_dir):
    """Fixed, learned and best possible routing, each judged for context and answer relevance,
    scored by prediction-powered inference against the gold of that label."""
    return fixtures(spark, sf_dir).routing_eval()


def _external_rows(fx) -> DataFrame:
    """A prompt for each pair and model; the models come one after another within a batch."""
    return generate.with_models(generate.prompts(fx.best_pairs, fx.corpus, fx.queries))


@register("answer_external")
def answer_external(spark, sf_dir):
    """Three external models answer from the prompt alone."""
    out = generate.answer_with_fn(_external_rows(fixtures(spark, sf_dir)), answer)
    return out.select("llm", "query_id", "doc_id", generate.default_answer(F.col("answer")).alias("answer"))


@register("error_isolation")
def error_isolation(spark, sf_dir):
    """External models that fail on some prompts; failures are kept as rows."""
    out = generate.answer_with_fn(_external_rows(fixtures(spark, sf_dir)), answer_or_fail)
    return out.select("llm", "query_id", "doc_id", "answer", F.col("error").isNotNull().cast("int").alias("failed"))


@register("router_eval")
def router_eval(spark, sf_dir):
    """Validation log-loss and accuracy of the trained router per setting."""
    return fixtures(spark, sf_dir).router[1]


@register("dynamic_routing")
def dynamic_routing(spark, sf_dir):
    """P5/U8: route each best-retriever pair with the trained router, then answer."""
    return fixtures(spark, sf_dir).dynamic_answers


@register("answer_ledger")
def answer_ledger(spark, sf_dir):
    """Answering that stops after its first block and is taken up again from the ledger; refused requests are asked
    once, failing ones up to the last attempt."""
    rows = fixtures(spark, sf_dir).cut(_external_rows(fixtures(spark, sf_dir)))
    path, block = scratch_path(spark, "ledger"), max(1, rows.count() // 2)
    ledger.answer_with_ledger(rows, answer_or_refuse, path, commit_rows=block, max_blocks=1)
    out = ledger.answer_with_ledger(rows, answer_or_refuse, path)
    return out.select("llm", "query_id", "doc_id", generate.default_answer(F.col("answer")).alias("answer"), "attempts", "error_class")


@register("saved_routing")
def saved_routing(spark, sf_dir):
    """The trained router saved as a version, loaded again and used to route and answer."""
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "router")
    version = model_table.save(fx.router[0], path, generate.PROVIDERS)
    return fx.routed_answers(model_table.load(spark, path, generate.PROVIDERS, version))


@register("gradient_router_epochs")
def gradient_router_epochs(spark, sf_dir):
    """Losses of the router trained by gradient, epoch by epoch; no SQL, tests compare with a plain rerun."""
    return gradient_router.epoch_table(spark, fixtures(spark, sf_dir).gradient_router)


@register("gradient_routing")
def gradient_routing(spark, sf_dir):
    """P5/U8: route each best-retriever pair with the router trained by gradient, then answer."""
    fx = fixtures(spark, sf_dir)
    return fx.routed_answers(fx.gradient_router, gradient_router.route)


@register("routing_from_files")
def routing_from_files(spark, sf_dir):
    """The queries and the table of (query, document) pairs as text files, read back by column names, and the
    pairs of those queries routed and answered."""
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "routing-files")
    own = router.router_features(fx.best_pairs.select("query_id", "doc_id"), fx.corpus, fx.queries)
    tsv.write_tsv(fx.queries.select("query_id", F.col("text").alias("Query")), f"{path}/queries.tsv")
    tsv.write_tsv(own.select("doc_id", F.col("dtext").alias("Document"), "query_id"), f"{path}/best_retriever_docs.tsv")
    asked = tsv.read_tsv(spark, f"{path}/queries.tsv", "query_id long, Query string")
    pairs = tsv.read_tsv(spark, f"{path}/best_retriever_docs.tsv", "query_id long, doc_id long, Document string").join(asked, "query_id")
    feats = pairs.select("query_id", "doc_id", F.col("Query").alias("qtext"), F.col("Document").alias("dtext"))
    feats = fx.cut(feats.withColumn("router_text", F.concat_ws(" ", "qtext", "dtext")))
    return fx.routed_answers(fx.router[0], feats=feats)
