"""Shared pieces of the text operators: shared folder, staging, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of an Arrow batch handed to a Python worker, in rows and bytes. Documents run
# to megabytes and joins repeat them, so the bound that matters is that in bytes;
# workers further cut each batch (``textops.slices``).
ARROW_ROWS = 2048
ARROW_BYTES = 4_000_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers once per application (they need not have it installed)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="llm-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: UTC, small Arrow batches, adaptive execution.

    Results are read lazily, after an operator has returned, so the settings stay: they change the
    caller's session for good.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none, and only under a ``local[...]`` master
    (tests, where driver and executors are one process), a temporary folder of
    this process takes its place; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    path = path or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
        # the folder that Spark made below it for this application's checkpoints
        _drop_at_exit(spark, sc.getCheckpointDir())
    return path


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder (survives lost executors).

    A checkpoint runs its plan once to materialise it and once more to write it;
    the disk copy kept meanwhile saves the second run.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return few(held.checkpoint(eager=True))
    finally:
        held.unpersist()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A store of intermediate tables as Parquet in the shared folder; they go when the block ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    count = iter(range(1_000_000))

    def store(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield store
    finally:
        drop(spark, folder)


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, for results that are read after their operator has returned.

    The folder goes when the session's file system is closed, that is when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _drop_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def bit_map(values: DataFrame, column: str, bits: int) -> bytes:
    """The values of a long column as a map of ``bits`` bits (value modulo ``bits``).

    Built on the executors; whatever the input, the driver gets ``bits / 32768`` rows of 4 kB at most.
    """
    bit = F.pmod(column, F.lit(bits)) + 1
    found = values.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    full = bytearray(bits // 8)
    for r in found.toLocalIterator():
        at = (r["b"] - 1) * len(r["m"])
        full[at : at + len(r["m"])] = r["m"]
    return bytes(full)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def few(df: DataFrame) -> DataFrame:
    """At most as many partitions as cores. For tables that are small next to the input: each partition
    writes shuffle files of its own, so a thousand near-empty ones cost more than their rows."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links -> ``(node, component)``: the smallest node reachable, for every linked node.

    Alternating large-star / small-star rounds: each round is two aggregates
    and two joins on the node; a hub with a third of the links is combined on
    the map side (``min``) and its join partition is one that the adaptive skew
    rule can split. Links and labels stay distributed; the driver sees one
    checksum a round.
    """
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = staged(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("m")
        )
        # large star: larger neighbours of a node move to its smallest neighbour
        large = both.where("v > u").join(least, F.col("u") == F.col("node")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        # small star: the node and its smaller neighbours move to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        moved = large.join(small_least, F.col("u") == F.col("node")).select("u", "v", "m")
        edges = staged(
            moved.selectExpr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))").where("u <> v").distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
