"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "rageval") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster pass ``master=None`` and let ``spark-submit`` decide; the
    shuffle partition count should then be sized to the data (AQE coalesces
    small partitions at run time, so erring high is cheap).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.driver.memory", os.environ.get("RAGEVAL_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_single_machine(master: str) -> bool:
    """``local``, ``local[n]`` or ``local[n, f]``: driver and tasks share one file system."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. When it is unset, a ``local`` master
    gets a temporary folder (tests); any other master raises, because a
    machine-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not is_single_machine(sc.master):
                raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
            current = tempfile.mkdtemp(prefix="rageval-ckpt-")
            spark.conf.set("spark.checkpoint.dir", current)
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the checkpoint root for an intermediate table."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str = "stage"):
    """``df`` as Parquet in the checkpoint folder, read back: the lineage is cut, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder in any file system that Spark reads."""
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return int(hpath.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(hpath).getLength())


# A bucket, the work of one task, should have about so many bytes.
BUCKET_BYTES = 32 << 20
# Where data are small, as many tasks as a small machine has cores.
LEAST_BUCKETS = 8


def buckets_for(n_bytes: int) -> int:
    return max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES))


def write_bucketed(df, table: str, key: str, n_buckets: int, sort_by: str | None = None):
    """Write ``df`` as a parquet table bucketed by ``key`` under the checkpoint root.

    Rows are dealt out by the key first, so each task writes one bucket as one
    file; ``sort_by`` orders the rows of a bucket, so that filters on that
    column skip row groups.

    Reading it back, Spark knows the rows are hash-partitioned by ``key``, so
    joins and aggregations keyed by it (and by supersets of it) run without a
    shuffle; the write also cuts the lineage like a checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, table)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(auto, "true")
    spark.conf.set(auto, "false")  # what comes from another bucketed table stays in its buckets, one to a task
    writer = df.repartition(n_buckets, key).write.format("parquet").bucketBy(n_buckets, key)
    if sort_by:
        writer = writer.sortBy(sort_by)
    try:
        writer.option("path", path).mode("overwrite").saveAsTable(table)
    finally:
        spark.conf.set(auto, before)
    return spark.table(table)


def drop_tables(spark: SparkSession, names) -> None:
    """Take tables of ``write_bucketed`` out of the catalogue; their files go with the checkpoint folder."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rageval`` importable by Python workers (the programmatic ``--py-files``).

    Functions run in ``mapInPandas`` / pandas UDFs refer to this package; the
    zip is written once per application into the checkpoint folder and added
    with ``addPyFile``.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    # Written through the Hadoop FileSystem API into the shared checkpoint
    # folder, so it works for local paths and cluster file systems alike.
    zpath = f"{checkpoint_root(spark)}/rageval-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(zpath)
    out = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
