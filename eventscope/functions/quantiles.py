"""Exact ``PERCENTILE_CONT`` without gathering a column into one task.

Spark's exact ``percentile`` merges a map of every distinct value in a single
task for a global group, which does not survive billions of distinct values.
Here each wanted rank is enclosed by the quantiles of a mergeable summary and
the enclosure is counted exactly, again and again until little is left:

1. The values are staged once (one read of the input, see ``staging``) and counted.
2. A round looks at each open range that holds more than ``limit`` rows. A KLL sketch
   of the rows inside (fixed size, partial sketches merge) gives two cuts around
   the rank, ``margin`` to either side. One scan then counts the rows below, at,
   between and above the cuts, so the rank's new place is exact whatever the
   sketch's error was: at a cut the value is found, else the rank goes on in an
   open range without the cuts. A range shrinks to about ``2 * margin`` of its rows
   in a round, and a value that repeats often becomes a cut and is found or left out.
3. The rows of what is left, at most ``limit`` for each rank, are ranked one by one.

No task gathers more than ``limit`` rows of a rank, whatever the distribution. The
rounds run when the function is called (two small jobs each; the driver sees two
cuts and five counts a rank); step 3 is part of the returned plan.

The result is ``x[floor(p (n-1))]`` interpolated towards ``x[ceil(p (n-1))]`` as in SQL
``PERCENTILE_CONT``. NULL and NaN are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

Target = tuple[str, str, float]  # (output alias, input column, probability)

LIMIT = 100_000
SKETCH_SIZE = 4096


class Range(NamedTuple):
    """The values of column ``c`` strictly between ``lo`` and ``hi``: ``rows`` of them, and the rank among them."""

    c: int
    lo: float
    hi: float
    rows: int
    rank: int

    def inside(self) -> Column:
        x = F.col(f"x{self.c}")
        return (x > F.lit(self.lo) if self.lo > -math.inf else F.lit(True)) & (x < F.lit(self.hi) if self.hi < math.inf else F.lit(True))


def margin(sketch_size: int) -> float:
    """Four times the rank error that a KLL sketch of this size keeps with 99 % confidence, a tenth at most."""
    return min(0.1, 4 * 2.296 / sketch_size**0.9723)


def _rounds(rows: DataFrame, ranks: dict[int, Range], limit: int, sketch_size: int) -> tuple[dict[int, float], dict[int, Range], int]:
    """Values of the ranks found at a cut, the ranges of the others (at most ``limit`` rows each), and how many rounds it took."""
    found: dict[int, float] = {}
    rounds = 0
    reach = margin(sketch_size)
    while wide := {t: r for t, r in ranks.items() if r.rows > limit}:
        rounds += 1
        quantiles = []
        for t, r in wide.items():
            # the first and the last value have ranks 0 and rows - 1
            sketch = F.kll_sketch_agg_double(F.when(r.inside(), F.col(f"x{r.c}")), F.lit(sketch_size))
            share = r.rank / (r.rows - 1)
            quantiles += [F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, share + d)))) for d in (-reach, reach)]
        cuts = rows.agg(*[q.alias(f"q{i}") for i, q in enumerate(quantiles)]).first()
        counts = []
        for i, r in enumerate(wide.values()):
            x, a, b = F.col(f"x{r.c}"), F.lit(cuts[2 * i]), F.lit(cuts[2 * i + 1])
            counts += [F.count_if(r.inside() & c) for c in (x < a, x == a, (x > a) & (x < b), (x == b) & (b > a), x > b)]
        n = rows.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
        for i, (t, r) in enumerate(wide.items()):
            a, b = cuts[2 * i], cuts[2 * i + 1]
            rank = r.rank
            for size, lo, hi in zip(n[5 * i : 5 * i + 5], (r.lo, a, a, b, b), (a, a, b, b, r.hi), strict=True):
                if rank < size:
                    if lo == hi:
                        found[t] = lo
                        del ranks[t]
                    else:
                        ranks[t] = Range(r.c, lo, hi, size, rank)
                    break
                rank -= size
            else:
                raise RuntimeError("a rank left its range: the input changed between two reads")
    return found, ranks, rounds


def exact_percentiles(df: DataFrame, targets: Sequence[Target], *, limit: int = LIMIT, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """One row: a double column per target alias plus ``n_<column>`` counts.

    NULL inputs are ignored; a column with no values gives NULL percentiles and
    a zero count.
    """
    if not targets:
        raise ValueError("no percentile targets")
    for _, _, p in targets:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    spark = df.sparkSession
    columns = sorted({c for _, c, _ in targets})
    value = lambda c: F.col(f"`{c}`").cast("double")
    rows = staged(df.select(*[F.when(~F.isnan(value(c)), value(c)).alias(f"x{j}") for j, c in enumerate(columns)]))
    sizes = rows.agg(*[F.count(f"x{j}").alias(f"x{j}") for j in range(len(columns))]).first()
    # two ranks per target
    ranks = {}
    for i, (_, c, p) in enumerate(targets):
        j = columns.index(c)
        if sizes[j]:
            for k, whole in enumerate((math.floor, math.ceil)):
                ranks[2 * i + k] = Range(j, -math.inf, math.inf, sizes[j], whole(p * (sizes[j] - 1)))
    found, left, _ = _rounds(rows, ranks, limit, sketch_size)

    # the rows of what is left, one by one; ranks in the same range share them
    ranges = sorted({r[:3] for r in left.values()})
    wanted = [(t, ranges.index(r[:3]), r.rank, None) for t, r in left.items()] + [(t, None, None, x) for t, x in found.items()]
    asked = F.broadcast(spark.createDataFrame(wanted, "t int, i int, rank long, x double"))  # two rows a target at most
    values = rows.select(F.explode(F.array(
        *[F.struct(F.lit(i).alias("i"), F.when(Range(*r, 0, 0).inside(), F.col(f"x{r[0]}")).alias("v")) for i, r in enumerate(ranges)]
    )).alias("s")).select("s.*").where("v IS NOT NULL") if ranges else spark.createDataFrame([], "i int, v double")
    counted = values.groupBy(F.col("i").alias("ri"), "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(
        Window.partitionBy("ri").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ))
    placed = asked.where("i IS NOT NULL").join(counted, F.col("i") == F.col("ri")).where("upto > rank AND upto - n <= rank").select("t", F.col("v").alias("x"))
    both = placed.unionByName(asked.where("i IS NULL").select("t", "x"))
    row = both.groupBy().agg(*[F.max(F.when(F.col("t") == k, F.col("x"))).alias(f"_{k}") for k in range(2 * len(targets))])
    out = []
    for i, (alias, c, p) in enumerate(targets):
        n = sizes[columns.index(c)]
        if not n:
            out.append(F.lit(None).cast("double").alias(alias))
            continue
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        at = p * (n - 1)
        lost = F.raise_error(F.lit("a rank left its range: the input changed between two reads")).cast("double")
        out.append(F.when(low.isNull() | high.isNull(), lost).when(low == high, low).otherwise(low + F.lit(at - math.floor(at)) * (high - low)).alias(alias))
    return row.select(*out, *[F.lit(sizes[j]).cast("long").alias(f"n_{c}") for j, c in enumerate(columns)])
