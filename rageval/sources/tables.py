"""Driver tables and the views derived from them (corpus, queries, embeddings roles).

Every view reads the given parquet tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, more_words_than

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The reference keeps documents with strictly more than 50
# whitespace tokens, and caps the query list at 1000 by default.
MIN_WORDS_EXCLUSIVE = 50
DEFAULT_QUERY_CAP = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def min_words(df: DataFrame, text_col: str = "text", min_exclusive: int = MIN_WORDS_EXCLUSIVE) -> DataFrame:
    """keep rows whose text has strictly more than ``min_exclusive`` words."""
    return df.where(more_words_than(text_col, min_exclusive))


def dedupe_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text, keeping the smallest id.

    Grouped by the SHA-256 of the text with ``min(id)``: a hash aggregate over
    narrow rows that runs partially in every map task first, so a text repeated
    in a third of all rows sends one row per task. The texts of the kept ids
    are then looked up with a semi-join.
    """
    first = df.groupBy(F.sha2(F.col(text_col), 256).alias("h")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.select(id_col, text_col).join(first, id_col, "left_semi")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus(doc_id, text)``: documents with > 50 words, deduplicated by text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_texts(min_words(docs))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(query_id, text)`` from ``benchmark``."""
    return (read_table(spark, sf_dir, "benchmark")
            .select(F.col("item_id").alias("query_id"), F.col("text")))


def first_queries(qs: DataFrame, n: int = DEFAULT_QUERY_CAP) -> DataFrame:
    """The first ``n`` queries by id."""
    return qs.orderBy("query_id").limit(n)


def nonblank(qs: DataFrame) -> DataFrame:
    """queries that can be scored (not null, not only whitespace)."""
    return qs.where(~is_blank("text"))


# Embeddings rows whose vec_id is a multiple of 10 are the queries; every row is a
# document, and a query doesn't find itself.
QUERY_VECTOR_EVERY = 10


def folded(vec) -> Column:
    """The second encoder: components added up from both ends, half as many; all of the vector counts."""
    v = vec.cast("array<double>")
    both = F.zip_with(v, F.reverse(v), lambda a, b: a + b)
    return F.slice(both, F.lit(1), F.ceil(F.size(v) / 2).cast("int"))


def embedding_roles(spark: SparkSession, sf_dir: str, encoder: str = "a"):
    """``(emb_q, emb_d)`` = (query_id, vec) and (doc_id, vec) views of ``embeddings``, as they are or ``folded``."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vec = F.col("embedding") if encoder == "a" else folded(F.col("embedding"))
    is_q = (F.col("vec_id") % QUERY_VECTOR_EVERY) == 0
    emb_q = e.where(is_q).select(F.col("vec_id").alias("query_id"), vec.alias("vec"))
    emb_d = e.select(F.col("vec_id").alias("doc_id"), vec.alias("vec"))
    return emb_q, emb_d
