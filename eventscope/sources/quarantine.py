"""Load that keeps the rows it rejects.

One pass over the staging text writes two tables: clean events, and a quarantine with
one row per defect (the line, the column, the reason and the value). A row with any
defect is rejected as a whole. The counts are observed on the same pass.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .events import CORRUPT_COLUMN, EVENT_COLUMNS, EVENT_SCHEMA, TEXT_LIMITS, _corrupt, _typed

QUARANTINE_COLUMNS = ("line", "column_name", "reason", "value")
WIDTH = "wrong number of fields"


class Loaded(NamedTuple):
    """What a pass read and did with it."""

    rows_read: int
    rows_clean: int
    rows_rejected: int
    defects: int


def defects(raw: DataFrame) -> Column:
    """Array of ``struct<column_name, reason, value>`` of a raw row, empty for a clean one."""
    wrong_width = F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(WIDTH).alias("reason"), F.lit(None).cast("string").alias("value"))
    found = []
    for c, (value, _, bad) in _typed(raw).items():
        reason = F.when(F.length(value) > TEXT_LIMITS[c], "too long").otherwise("malformed") if c in TEXT_LIMITS else F.lit("malformed")
        found.append(F.when(bad, F.struct(F.lit(c).alias("column_name"), reason.alias("reason"), value.alias("value"))))
    return F.when(_corrupt(raw), F.array(wrong_width)).otherwise(F.array_compact(F.array(*found)))


def _line(raw: DataFrame) -> Column:
    """The row as a line: as read where its width is wrong, else its fields put together again."""
    fields = F.to_csv(F.struct(*[F.col(c) for c in EVENT_COLUMNS]), {"quote": '"', "escape": '"', "nullValue": ""})
    return F.coalesce(F.col(CORRUPT_COLUMN), fields) if CORRUPT_COLUMN in raw.columns else fields


def quarantined(raw: DataFrame) -> DataFrame:
    """``line, column_name, reason, value``: one row per defect (lazy, nothing is written)."""
    marked = raw.select(_line(raw).alias("line"), F.explode(defects(raw)).alias("d"))
    return marked.select("line", "d.*")


def load_with_quarantine(raw: DataFrame, path: str, *, mode: str = "overwrite") -> Loaded:
    """Write ``raw`` below ``path`` in one pass: clean events and quarantine; the counts of the pass."""
    typed = {c: typed for c, (_, typed, _) in _typed(raw).items()}
    found = raw.select(*[typed[c].alias(c) for c in EVENT_COLUMNS], _line(raw).alias("line"), defects(raw).alias("_defects"))
    seen = Observation()
    found = found.observe(
        seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(F.size("_defects") == 0).alias("rows_clean"),
        F.count_if(F.size("_defects") > 0).alias("rows_rejected"), F.coalesce(F.sum(F.size("_defects")), F.lit(0)).alias("defects"),
    )
    clean = F.size("_defects") == 0
    out = found.select(
        F.when(clean, "clean").otherwise("rejected").alias("outcome"),
        *[F.when(clean, F.col(c)).alias(c) for c in EVENT_COLUMNS],
        F.when(~clean, F.col("line")).alias("line"), F.explode_outer("_defects").alias("_d"),
    ).select("outcome", *EVENT_COLUMNS, "line", "_d.*")
    out.write.mode(mode).partitionBy("outcome").parquet(path)
    return Loaded(**seen.get)


def _read(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields] + [f"{c} string" for c in QUARANTINE_COLUMNS] + ["outcome string"]
    )
    # the outcome is a partition: only its files are read
    return spark.read.schema(schema).parquet(path).where(F.col("outcome") == outcome)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "clean").select(*EVENT_COLUMNS)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "rejected").select(*QUARANTINE_COLUMNS)
