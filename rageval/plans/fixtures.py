"""Shared, lazily built stage outputs over one data directory.

Each stage (corpus, indexes, runs, judged pairs, consensus, ...) is built
once per session and cut from its lineage as Parquet files
in the shared folder named by ``spark.checkpoint.dir``: later stages read
it back instead of recomputing it, a lost executor costs a re-read rather
than a recomputation of everything upstream, and plans stay small. This is
the "index once, search many" shape of the original pipeline, whose stages
also hand over through files.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus as consensus_ops
from ..operators import dense, encoder, fusion, generate, gradient_router, ground_truth, lexical, metrics, pruned, router
from ..operators.common import DEFAULT_BROADCAST_ROWS
from ..session import buckets_for, checkpoint_root, drop_tables, folder_bytes, ship_package, write_bucketed, written
from ..sources import tables

DEFAULT_K = 3           # fixed value: retrieval top_k default
POOL_DEPTH = 10         # default depth of the judging pool, an argument of ``Fixtures``
POOLED = ("bm25", "tfidf", "dense_a", "dense_b", "match")  # every first-stage run; the hybrid one reorders theirs
ENCODERS = {"dense_a": 64, "dense_b": 128}  # hashed text encoders: name, which is the salt, and dimensions
# Retriever dimension, in fusion order: whitespace BM25, tf-idf cosine, two
# dense text encoders, standard-analyzer match, hybrid rerank; then the fused
# and the consensus runs.
BASE_RETRIEVERS = ("bm25", "tfidf", "dense_a", "dense_b", "match", "hybrid")
ALL_RETRIEVERS = BASE_RETRIEVERS + ("rrf", "consensus")
ROUTING_TOP_K = 1       # fixed value: routing retrieves the top 1 document

TABLES_READ = ("documents", "embeddings", "benchmark", "labels", "conversations")

_CACHE: dict = {}


def fixtures(spark: SparkSession, sf_dir: str) -> "Fixtures":
    """The stages over a folder, built anew when its files change."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), listing(spark, sf_dir))
    fx = _CACHE.get(key)
    if fx is None:
        fx = Fixtures(spark, sf_dir.rstrip("/"))
        for old in _CACHE.values():
            old.close()
        _CACHE.clear()
        _CACHE[key] = fx
    return fx


def listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of each file of the tables."""
    sc = spark.sparkContext
    out = []
    for name in TABLES_READ:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        for f in fs.listStatus(path) if fs.exists(path) else []:
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str, k: int = DEFAULT_K, pool_depth: int = POOL_DEPTH):
        self.spark = spark
        self.sf_dir = sf_dir
        self.k = k
        self.pool_depth = pool_depth
        checkpoint_root(spark)
        ship_package(spark)
        self._consensus: dict[str, DataFrame] = {}
        self._runs: dict[tuple, DataFrame] = {}
        self._tables: list[str] = []

    def close(self) -> None:
        """Drop the bucketed tables from the catalogue."""
        if self.spark.sparkContext._jsc and not self.spark.sparkContext._jsc.sc().isStopped():
            drop_tables(self.spark, self._tables)
        self._tables.clear()

    def _run(self, name: str, k: int, make) -> DataFrame:
        """A first-stage run is searched once, to the largest depth that anything asks for, and cut by rank. The hybrid
        one is computed per k, as its inputs depend on it."""
        depth = max(k, self.k, self.pool_depth) if name in POOLED else k
        key = (name, depth)
        if key not in self._runs:
            self._runs[key] = self.cut(make(depth))
        return self._runs[key].where(F.col("rank") <= k)

    @staticmethod
    def cut(df: DataFrame) -> DataFrame:
        """Materialise a stage output as Parquet in the checkpoint folder and drop its lineage."""
        return written(df)

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def n_buckets(self) -> int:
        """Of all document-keyed tables, so that they are joined in place. Postings have about four times the bytes
        of the compressed documents."""
        return buckets_for(4 * folder_bytes(self.spark, f"{self.sf_dir}/documents.parquet"))

    def bucket(self, df: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
        """Materialise a stage as a table bucketed by ``doc_id`` or another key. Rows of a bucket aren't sorted: no search
        filters by a literal, so no row group could be skipped."""
        table = f"rageval_{name}_{uuid.uuid4().hex[:10]}"
        self._tables.append(table)
        return write_bucketed(df, table, key, self.n_buckets)

    @cached_property
    def corpus(self) -> DataFrame:
        return self.bucket(tables.corpus(self.spark, self.sf_dir), "corpus")

    @cached_property
    def small(self) -> bool:
        """One size check for every query-derived join side. The largest such side
        is the query token rows; every token has at least one character, so twice
        the total query length bounds it (whitespace plus standard tokens)."""
        n = self.queries.agg(F.sum(F.length("text"))).first()[0] or 0
        return 2 * int(n) <= DEFAULT_BROADCAST_ROWS

    @cached_property
    def queries(self) -> DataFrame:
        return tables.queries(self.spark, self.sf_dir)

    @cached_property
    def ws_index(self) -> lexical.LexicalIndex:
        return self._searchable(lexical.build_index(self.corpus, lexical.WS, materialize=self._index_table("ws")), "ws")

    @cached_property
    def std_index(self) -> lexical.LexicalIndex:
        return self._searchable(lexical.build_index(self.corpus, lexical.STD, materialize=self._index_table("std")), "std")

    @cached_property
    def boundary_index(self) -> lexical.LexicalIndex:
        return self._searchable(lexical.build_index(self.corpus, lexical.BOUNDARY, materialize=self._index_table("boundary")), "boundary")

    def _searchable(self, index: lexical.LexicalIndex, kind: str) -> lexical.LexicalIndex:
        """With postings and bounds by block, for pruned search; what only reads the statistics doesn't build them. Blocks
        hold the postings of the queries' tokens, if those are few enough to be broadcast."""
        asked, postings = None, index.postings
        if self.small:
            asked = lexical.query_terms(self.queries, index.kind).select("token").distinct()
            postings = postings.join(F.broadcast(asked), "token", "left_semi").select(*postings.columns)
        index.impacts = pruned.LazyImpacts(lambda: pruned.build_impacts(
            postings, index.n_docs, lambda df, name: self.bucket(df, f"{name}_{kind}_blocks", key="block"),
            index.postings.select("doc_id", "dl")), asked)
        index.cut = self.cut
        return index

    @cached_property
    def tfidf(self) -> lexical.TfidfModel:
        return lexical.build_tfidf(self.std_index, materialize=lambda df: self.bucket(df, "doc_norm"))

    def _index_table(self, kind: str):
        """Postings are bucketed by doc_id; the vocabulary table is checkpointed."""
        def materialize(df: DataFrame) -> DataFrame:
            if "doc_id" in df.columns:
                return self.bucket(df, f"postings_{kind}")
            return self.cut(df)
        return materialize

    def bm25(self, k: int | None = None) -> DataFrame:
        return self._run("bm25", k or self.k,
                         lambda kk: lexical.bm25_search(self.ws_index, self.queries, kk, small=self.small))

    @cached_property
    def pool(self) -> DataFrame:
        """(query_id, doc_id, rank): what any first-stage run returns to ``pool_depth``, with its best rank."""
        runs = self.first_stage
        every = None
        for name in POOLED:
            own = runs[name](self.pool_depth).select("query_id", "doc_id", "rank")
            every = own if every is None else every.unionByName(own)
        return self.cut(every.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")))

    @cached_property
    def qrels(self) -> DataFrame:
        q = ground_truth.qrels(self.ws_index, self.corpus, self.queries, self.table("labels"), self.pool, small=self.small, cut=self.cut)
        return self.cut(q)

    def with_retriever(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("retriever"), *df.columns)

    def match(self, k: int | None = None) -> DataFrame:
        return self._run("match", k or self.k,
                         lambda kk: lexical.match_search(self.std_index, self.queries, kk, small=self.small))

    def boundary_match(self, k: int | None = None) -> DataFrame:
        """Full-text match on word-boundary tokens."""
        return self._run("boundary_match", k or self.k,
                         lambda kk: lexical.match_search(self.boundary_index, self.queries, kk, small=self.small))

    def tfidf_run(self, k: int | None = None) -> DataFrame:
        return self._run("tfidf", k or self.k,
                         lambda kk: lexical.tfidf_search(self.tfidf, self.queries, kk, small=self.small))

    @cached_property
    def text_vectors(self) -> DataFrame:
        """(doc_id, a hashed vector per encoder) of the corpus texts; texts of one id are added up."""
        toks = self.corpus.select("doc_id", lexical.tokenize(lexical.STD, "text").alias("toks"))
        if lexical.has_repeated_ids(self.corpus):
            added = toks.groupBy("doc_id").agg(F.flatten(F.collect_list("toks")).alias("toks"))
            toks = self.corpus.select("doc_id").join(added, "doc_id")
        return self.cut(dense.hashed_texts(toks, "doc_id", ENCODERS))

    def dense_text(self, encoder: str, k: int | None = None) -> DataFrame:
        """Cosine over hashed vectors of the corpus texts."""
        def search(kk):
            dims = ENCODERS[encoder]
            asked = dense.hashed_cells(lexical.query_terms(self.queries, lexical.STD).withColumnRenamed("qtf", "tf"), "query_id", dims, encoder)
            return dense.dense_search(dense.with_zero_vectors(tables.nonblank(self.queries), asked, "query_id", dims),
                                      self.text_vectors.select("doc_id", F.col(encoder).alias("vec")), kk, cut=self.cut)
        return self._run(encoder, k or self.k, search)

    @cached_property
    def term_rows(self) -> DataFrame:
        """(doc_id, idx, tf): the hashed tokens of the corpus texts, of which the encoder and the texts' vectors are made."""
        return self.cut(encoder.term_rows(self.corpus.select("doc_id", "text")))

    @cached_property
    def encoder(self) -> encoder.Encoder:
        """The text encoder learned from the corpus."""
        return encoder.fit_rows(self.term_rows)

    def dense_learned(self, k: int | None = None) -> DataFrame:
        """Cosine over the learned vectors of the corpus texts."""
        def search(kk):
            asked = encoder.encode(tables.nonblank(self.queries).select("query_id", "text"), self.encoder)
            return dense.dense_search(asked, self.cut(encoder.encode_rows(self.term_rows, self.encoder)), kk, cut=self.cut)
        return self._run("dense_learned", k or self.k, search)

    def encoder_board(self) -> DataFrame:
        """Macro metrics of the hashed encoders' and the learned encoder's runs."""
        runs = None
        for name, make in (*((e, self.first_stage[e]) for e in ENCODERS), ("dense_learned", self.dense_learned)):
            own = self.with_retriever(make().select("query_id", "doc_id", "rank"), name)
            runs = own if runs is None else runs.unionByName(own)
        return metrics.macro_metrics(self.cut(runs), self.qrels)

    @property
    def first_stage(self) -> dict:
        return {"bm25": self.bm25, "tfidf": self.tfidf_run, "match": self.match,
                "dense_a": lambda k=None: self.dense_text("dense_a", k), "dense_b": lambda k=None: self.dense_text("dense_b", k)}

    def hybrid(self, k: int | None = None) -> DataFrame:
        return self._run("hybrid", k or self.k,
                         lambda kk: fusion.hybrid_rerank(self.tfidf, self.queries, self.bm25(kk), self.match(kk),
                                                         kk, small=self.small))

    @cached_property
    def base_runs(self) -> DataFrame:
        """(retriever, retriever_idx, query_id, doc_id, rank, score) of the base retrievers."""
        makers = {**self.first_stage, "hybrid": self.hybrid}
        out = None
        for i, name in enumerate(BASE_RETRIEVERS):
            r = makers[name]().select(F.lit(name).alias("retriever"), F.lit(i).alias("retriever_idx"),
                                      "query_id", "doc_id", "rank", "score")
            out = r if out is None else out.unionByName(r)
        return self.cut(out)

    @cached_property
    def rrf(self) -> DataFrame:
        return self.cut(fusion.rrf(self.base_runs, self.k))

    @cached_property
    def runs(self) -> DataFrame:
        """Base runs plus the fused run."""
        r = self.rrf.select(F.lit("rrf").alias("retriever"), F.lit(len(BASE_RETRIEVERS)).alias("retriever_idx"),
                            "query_id", "doc_id", "rank", "score")
        return self.cut(self.base_runs.unionByName(r))

    @cached_property
    def judged(self) -> DataFrame:
        j = consensus_ops.judge_pairs(self.runs, self.corpus, self.queries, small=self.small)
        return self.cut(j)

    def consensus(self, tie_break: str = "text") -> DataFrame:
        if tie_break not in self._consensus:
            self._consensus[tie_break] = self.cut(consensus_ops.consensus(
                self.judged, self.rrf, self.corpus, self.queries, self.k, tie_break=tie_break,
                small=self.small))
        return self._consensus[tie_break]

    @cached_property
    def all_runs(self) -> DataFrame:
        """Every retriever including the consensus, in the long form metrics read."""
        c = self.consensus().select(F.lit("consensus").alias("retriever"),
                                    F.lit(len(BASE_RETRIEVERS) + 1).alias("retriever_idx"),
                                    "query_id", "doc_id", "rank", F.lit(None).cast("double").alias("score"))
        return self.cut(self.runs.unionByName(c))

    def retriever_dim(self) -> DataFrame:
        return self.spark.createDataFrame([(n, i) for i, n in enumerate(ALL_RETRIEVERS)],
                                          "retriever string, retriever_idx int")

    def dense(self, encoder: str = "a", k: int | None = None) -> DataFrame:
        emb_q, emb_d = tables.embedding_roles(self.spark, self.sf_dir, encoder)
        return dense.dense_search(emb_q, emb_d, k or self.k, cut=self.cut, skip_self=True)

    # --- best retriever, answers and routing ------------------------------------------

    @cached_property
    def best_pairs(self) -> DataFrame:
        """(query_id, doc_id, rank) of the retriever with the best macro F1."""
        board = metrics.macro_metrics(self.all_runs, self.qrels).join(self.retriever_dim(), "retriever")
        best = board.orderBy(F.col("f1_score").desc(), "retriever_idx").limit(1).select("retriever")
        pairs = (self.all_runs.join(best, "retriever", "left_semi").where(F.col("doc_id").isNotNull())
                 .select("retriever", "query_id", "doc_id", "rank"))
        return self.cut(pairs)

    @cached_property
    def answers(self) -> DataFrame:
        return self.cut(generate.generate_answers(self.best_pairs, self.corpus, self.queries))

    @cached_property
    def judged_answers(self) -> DataFrame:
        return self.cut(generate.judge_answers(self.answers, self.queries))

    @cached_property
    def training_rows(self) -> DataFrame:
        return self.cut(generate.best_per_pair(self.judged_answers))

    @cached_property
    def baseline_answers(self) -> DataFrame:
        """BM25 top-1 answered by the first model."""
        top1 = self.bm25(ROUTING_TOP_K)
        ans = generate.generate_answers(top1, self.corpus, self.queries, names=generate.PROVIDERS[:1])
        return self.cut(ans)

    def routing_eval(self) -> DataFrame:
        """Fixed, learned and best possible routing, each judged for context and answer relevance and corrected by
        the gold of that label: the judged pairs, and whether the answer itself has the query's tokens in a row."""
        from ..operators.consensus import coverage
        from ..operators.ground_truth import token_line
        upper = (self.judged_answers.join(self.training_rows.select("query_id", "doc_id", F.col("label").alias("llm_idx")),
                                          ["query_id", "doc_id", "llm_idx"]).select(F.lit("upper_bound").alias("routing"), "query_id", "doc_id", "answer"))
        both = (self.baseline_answers.select(F.lit("baseline").alias("routing"), "query_id", "doc_id", "answer")
                .unionByName(self.dynamic_answers.select(F.lit("dynamic").alias("routing"), "query_id", "doc_id", "answer")).unionByName(upper))
        texts = (both.join(self.queries.select("query_id", F.col("text").alias("qtext")), "query_id")
                 .join(self.corpus.select("doc_id", F.col("text").alias("dtext")), "doc_id")
                 .join(self.qrels.select("query_id", "doc_id", F.col("label").alias("gold")), ["query_id", "doc_id"], "left"))

        def row(kind, text, gold):
            return F.struct(F.lit(kind).alias("label_kind"), (coverage("qtext", text) >= 0.5).cast("int").alias("f"), gold.cast("int").alias("y"))

        said = F.when(F.col("gold").isNotNull(), F.contains(token_line("answer"), token_line("qtext")).cast("int"))
        rows = texts.select("routing", F.inline(F.array(row("Context_Relevance_Label", "dtext", F.col("gold")), row("Answer_Relevance_Label", "answer", said))))
        return metrics.ppi_estimate(rows.where("y is null").drop("y"), rows.where("y is not null"), ["routing", "label_kind"])

    @cached_property
    def router(self):
        """The router fitted on the train split; (model, validation table)."""
        feats = self.split_features
        return router.train_naive_bayes(feats.where("split = 'train'"), feats.where("split = 'validation'"), len(generate.PROVIDERS), self.cut)

    @cached_property
    def split_features(self) -> DataFrame:
        """(query_id, doc_id, label, split, router_text) of the training rows."""
        feats = router.router_features(router.hash_split(self.training_rows), self.corpus, self.queries)
        return self.cut(feats.select("query_id", "doc_id", "label", "split", "router_text"))

    @cached_property
    def gradient_router(self) -> gradient_router.GradientRouter:
        """The router trained by gradient on the train split, stopped by the validation split."""
        return gradient_router.train(self.split_features, len(generate.PROVIDERS))

    @cached_property
    def dynamic_answers(self) -> DataFrame:
        """P5/U8: route the best-retriever pairs, answer with the chosen model."""
        return self.cut(self.routed_answers(self.router[0]))

    def routed_answers(self, model, route=None, feats: DataFrame | None = None) -> DataFrame:
        """The best-retriever pairs, or those of ``feats``, answered by the models that ``route`` picks; the naive Bayes
        router by default."""
        if feats is None:
            feats = router.router_features(self.best_pairs.select("query_id", "doc_id"), self.corpus, self.queries)
        routed = (route or router.route_naive_bayes)(model, feats, generate.llm_dim(self.spark))
        texts = feats.select("query_id", "doc_id", "qtext", "dtext").dropDuplicates(["query_id", "doc_id"])
        return routed.join(texts, ["query_id", "doc_id"]).select("query_id", "doc_id", F.trim(generate.chosen_answer()).alias("answer"), F.col("llm").alias("best_llm"))
