"""Intermediate tables that several jobs read: written once to the session's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="eventscope-stage-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share, or None.

    Only where the session names none, and only under a ``local[...]`` master (driver and
    executors are one process), a folder of this process takes its place.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and (sc.master == "local" or sc.master.startswith("local[")):
        folder = _own_folder()
    return folder.rstrip("/") if folder else None


def staged(df: DataFrame) -> DataFrame:
    """``df`` read back from Parquet in the shared folder, so that its lineage runs once and survives lost executors.

    The files go when the application ends. Without a shared folder ``df`` itself
    comes back: each job then computes it anew. Where a second computation could differ,
    as with made-up numbers, ask for the folder first.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df
    path = f"{folder}/eventscope-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
