"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: A word: a run of characters that are neither the space nor one of the six ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that go to a Python worker at once; whole texts travel, so batches are kept short.
BATCH_ROWS = 512

#: Rows of a few numbers that are broadcast at most; more are joined.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Make this package importable by the Python workers and keep their Arrow batches short."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage: after a lost executor the files are read again, nothing is computed anew.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """As ``staged``; the shuffle files of what was written go. Spark removes them when the driver's garbage is collected,
    which may be after all is done, and until then they take as much disk as the tables."""
    out = staged(df, name, codec)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def fits(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has few rows, else left to a plain join; ``df`` is written already."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    return stem if stem not in df.columns else f"{stem}_{uuid.uuid4().hex[:8]}"


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal digits; a null id counts as an empty string."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def text_of(df: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))
