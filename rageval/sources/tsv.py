"""Tab-separated files at the edges.

Stage outputs are directories of part files written by Spark, named
``{name}{suffix}`` (e.g. ``bm25_results.tsv``) so a whole folder of them is
read with one glob and the member name comes from the file path -- the
file name is the key, as in the original layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TSV_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def require_columns(df: DataFrame, cols) -> None:
    """Fail fast when a source lacks required columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + tab separated; ``mode="ignore"`` is write-if-absent."""
    w = (df.write.mode(mode).option("ignoreLeadingWhiteSpace", "false")
         .option("ignoreTrailingWhiteSpace", "false"))
    for k, v in TSV_OPTIONS.items():
        if k != "multiLine":
            w = w.option(k, v)
    w.csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The columns of ``schema``, found by their names in the header whatever their order, and cast; a missing one
    raises, others are left out. Values that can't be cast are null. Quoted multi-line fields are allowed. Without a
    schema all columns come as strings."""
    r = spark.read
    for k, v in TSV_OPTIONS.items():
        r = r.option(k, v)
    raw = r.csv(path)
    if schema is None:
        return raw
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not raw.columns:  # part files without a header: nothing was written
        return spark.createDataFrame([], wanted)
    require_columns(raw, wanted.names)
    return raw.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def members(spark: SparkSession, directory: str, suffix: str) -> dict[str, str]:
    """The paths of ``*{suffix}`` by member name; a folder has one entry per retriever or model."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/*{suffix}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    paths = [str(f.getPath().toString()) for f in found]
    return {p.rstrip("/").rsplit("/", 1)[1].removesuffix(suffix): p for p in sorted(paths)}


def read_suffix_dir(spark: SparkSession, directory: str, suffix: str, schema,
                    name_col: str = "retriever", exclude=()) -> DataFrame:
    """Every ``*{suffix}`` entry of a folder, member name = path minus suffix. Members are read each by its own
    header; those in ``exclude`` aren't read."""
    out = None
    for name, path in members(spark, directory, suffix).items():
        if name not in exclude:
            own = read_tsv(spark, path, schema).withColumn(name_col, F.lit(name))
            out = own if out is None else out.unionByName(own)
    if out is None:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], wanted).withColumn(name_col, F.lit(None).cast("string"))
    return out


def require_members(spark: SparkSession, directory: str, suffix: str, expected) -> None:
    """Fail fast when a member's file is missing."""
    missing = sorted(set(expected) - set(members(spark, directory, suffix)))
    if missing:
        raise ValueError(f"no *{suffix} file of {missing}")


def missing_work(expected: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """The keys of ``expected`` that have no stored row -- only these need computing."""
    return expected.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A named result that may not exist -- missing means an empty table of the
    schema (the feature using it is simply off), not an error."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], schema)
    return read_tsv(spark, path, schema)
