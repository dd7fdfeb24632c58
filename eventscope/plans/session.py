"""Session settings the operators are designed around.

* ``spark.sql.session.timeZone=UTC`` -- day/week/month truncation of
  zone-aware timestamps must not depend on the machine's zone.
* AQE on, with partition coalescing and skew-join splitting. The funnel joins
  step events to per-session tables and then aggregates by session again;
  ``forceOptimizeSkewedJoin`` lets AQE split a hot session's partition even
  though the split adds an exchange before that (partial, hence small)
  aggregate.
* Intermediate tables go to ``spark.checkpoint.dir`` (or a folder passed in); an
  unset folder is an error, never a machine-local fallback.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings above to an existing session."""
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)
    return spark


COST_CONF = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"}


@contextmanager
def cost_based(spark: SparkSession) -> Iterator[SparkSession]:
    """Plans made inside the block use the tables' statistics (see ``write_dated_table``); the session's settings come back after it."""
    before = {k: spark.conf.get(k) for k in COST_CONF}
    for k, v in COST_CONF.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def build_session(master: str | None = None, app_name: str = "eventscope",
                  shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session builder; on a cluster use the cluster's session and :func:`configure`."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return configure(spark)


def work_folder(spark: SparkSession, work_dir: str | None = None) -> str:
    """The shared folder for intermediate tables: ``work_dir``, else ``spark.checkpoint.dir``; unset is an error."""
    path = work_dir or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder on shared storage, or pass work_dir")
    return path.rstrip("/")
