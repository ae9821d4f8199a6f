"""Versioned model tables (U7): the naive Bayes router as Parquet with a manifest.

Every save adds a version. The token table is written first, under a name of its own, and the manifest row last: a version
without a finished manifest does not exist, so a save that was cut short is never loaded. The manifest holds the
tokeniser, the label order, the smoothing, the counts by label and a digest of the token table; ``load`` refuses a version
whose tokeniser or labels differ from the caller's, or whose token table is not the one that was saved.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STD_TOKEN_PATTERN
from .router import NaiveBayes

KIND = "naive_bayes"
MANIFEST = ("kind string, tokeniser string, labels array<string>, smoothing double, label_rows array<long>, "
            "label_totals array<long>, n_tokens long, tokens string, digest string")


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions in ``path``, ascending."""
    fs, hpath = _fs(spark, f"{path}/versions")
    if not fs.exists(hpath):
        return []
    folders = [s.getPath() for s in fs.listStatus(hpath)]
    exists = [f for f in folders if fs.exists(_fs(spark, f"{f.toString()}/_SUCCESS")[1])]
    return sorted(int(f.getName().removeprefix("v")) for f in exists)


def digest(tokens: DataFrame) -> str:
    """Of the rows, whatever their order: their number and the sum of their hashes."""
    n, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("token", "counts").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}:{int(total)}"


def save(model: NaiveBayes, path: str, labels: Sequence[str], tokeniser: str = STD_TOKEN_PATTERN) -> int:
    """Add a version and return its number. Two writers of one number: the second one fails."""
    if len(labels) != len(model.rows):
        raise ValueError(f"{len(labels)} labels for a model of {len(model.rows)}")
    spark = model.tokens.sparkSession
    version = max(versions(spark, path), default=0) + 1
    name = f"tokens-{uuid.uuid4().hex[:12]}"
    tokens = model.tokens.select("token", F.col("counts").cast("array<long>").alias("counts"))
    tokens.write.parquet(f"{path}/{name}")
    stored = spark.read.schema(tokens.schema).parquet(f"{path}/{name}")
    row = (KIND, tokeniser, list(labels), float(model.smoothing), [int(x) for x in model.rows], [int(x) for x in model.totals],
           int(model.n_tokens), name, digest(stored))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/v{version:06d}")
    return version


def load(spark: SparkSession, path: str, labels: Sequence[str], version: int | None = None,
         tokeniser: str = STD_TOKEN_PATTERN) -> NaiveBayes:
    """The given version, or the newest. Raises ``ValueError`` on anything that would make the model say other things."""
    known = versions(spark, path)
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"no finished version {version} in {path}")
    m = spark.read.schema(MANIFEST).parquet(f"{path}/versions/v{version:06d}").first()
    for name, saved, wanted in (("kind", m["kind"], KIND), ("tokeniser", m["tokeniser"], tokeniser),
                                ("labels", list(m["labels"]), list(labels))):
        if saved != wanted:
            raise ValueError(f"version {version} has {name} {saved}, not {wanted}")
    tokens = spark.read.schema("token string, counts array<long>").parquet(f"{path}/{m['tokens']}")
    if digest(tokens) != m["digest"]:
        raise ValueError(f"the token table of version {version} is not the one that was saved")
    return NaiveBayes(tokens, tuple(m["label_rows"]), tuple(m["label_totals"]), m["n_tokens"], m["smoothing"])
