"""Near-duplicate vectors by randomised-rotation binary codes with error bounds.

Vectors are scaled to unit length and turned by a random rotation. A vector's code
is the sign of each rotated coordinate, and its stored correction factor ``f`` is the
inner product of the code's unit vector with the rotated vector. For another
vector ``q`` (rotated, kept with 4 bits a coordinate and randomised rounding)
``<code, q> / f`` is an unbiased estimate of the cosine, and

    |error| <= SIGMAS * sqrt((1 - f^2) / (f^2 * (dim - 1)))   (+ the rounding of q)

holds but for a chance of about ``exp(-SIGMAS^2 / 2)``. A pair goes on to the exact
recomputation, in double precision, unless the bound of either direction rules
out the threshold.

Which pairs meet. ``bits`` further random hyperplanes form a bucket number in each
of ``tables`` tables; both follow from the number of vectors and the wanted recall
at the threshold (``MISS``), so a bucket holds ``BUCKET`` vectors on average at every
size and the work grows as N^1.22 at worst for a threshold of 0.9.

1. Equal vectors become one node with a multiplicity.
2. Codes only (about ``dim`` bytes) are shuffled to buckets; nodes that keep a partner
   in a bucket are noted.
3. Only these carry their full vector there; pairs that pass exactly are counted
   once, in the first table they share (table numbers are recomputed in place),
   and linked nodes are reduced to stars inside the task. No pair is written out.
4. A bucket of more than ``BLOCK`` rows is cut into blocks and every two blocks meet in
   a task of their own, so a large group of copies is spread; nothing is capped.

Defined results: NULL, zero, and vectors with NULL or non-finite components link
with nothing; vectors of different length never link; equal rows link with each
other; NULL ids are never the smallest of a component that has another id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, connected_components, scratch, staged

THRESHOLD = 0.9
MISS = 0.01
SIGMAS = 4.0
BUCKET = 64
BLOCK = 1024
SEED = 20240607


class Plan:
    """Rotation and tables for one dimension; the same numbers in every task."""

    def __init__(self, dim: int, bits: int, tables: int):
        rng = np.random.Generator(np.random.PCG64([SEED, dim]))
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float64)
        self.planes = rng.standard_normal((dim, bits * tables)).astype(np.float32)
        self.dim, self.bits, self.tables = dim, bits, tables
        self.weights = (1 << np.arange(bits, dtype=np.int64))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket number of each vector in each table."""
        # one vector at a time gives the same sums wherever it is computed
        side = np.einsum("ij,jk->ik", unit.astype(np.float32), self.planes) > 0
        return side.reshape(len(unit), self.tables, self.bits) @ self.weights

    def codes(self, unit: np.ndarray, node: np.ndarray):
        """Code bytes, correction factor, and the 4-bit copy of the rotated vector with its lowest value and step."""
        turned = unit @ self.rotation
        sign = turned > 0
        factor = np.abs(turned).sum(1) / math.sqrt(self.dim)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / 15, 1e-30)
        dither = np.random.Generator(np.random.PCG64(SEED)).random(self.dim)
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
        if self.dim % 2:
            level = np.pad(level, ((0, 0), (0, 1)))
        return np.packbits(sign, axis=1), factor, level[:, ::2] << 4 | level[:, 1::2], low, step


def tables_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per bucket number and number of tables."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / BUCKET)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


_PLANS: dict[tuple[int, int, int], Plan] = {}


def _plan(dim: int, bits: int, tables: int) -> Plan:
    key = (dim, bits, tables)
    if key not in _PLANS:
        _PLANS[key] = Plan(*key)
    return _PLANS[key]


def _by_dim(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, for each length of vector."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(1, keepdims=True)  # keeps squares finite
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


_CODE = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("bucket", T.LongType()),
    T.StructField("code", T.BinaryType()), T.StructField("levels", T.BinaryType()),
    T.StructField("factor", T.FloatType()), T.StructField("low", T.FloatType()), T.StructField("step", T.FloatType()),
])


def _coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row per node and table: its bucket, code, and 4-bit copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            for rows, unit in _by_dim(batch.column("vector")):
                plan = _plan(unit.shape[1], bits, tables)
                code, factor, levels, low, step = plan.codes(unit, ids[rows])
                n = len(rows)
                rep = np.repeat(np.arange(n), tables)
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary()).take(pa.array(rep))
                real = lambda v: pa.array(v[rep].astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows][rep]), pa.array(np.full(len(rep), unit.shape[1], np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                        pa.array(plan.buckets(unit).ravel()), binary(code), binary(levels), real(factor), real(low), real(step),
                    ],
                    _CODE.names,
                )

    return nodes.select("node", "vector").mapInArrow(run, _CODE)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of each bucket, as often as it has partner blocks: ``meet`` names the two blocks, ``side`` the row's own place.

    Buckets of up to ``BLOCK`` rows are one block. The larger ones are few (their
    number times ``BLOCK`` is at most the number of rows) and joined by bucket.
    """
    sizes = rows.groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(
        F.col("dim").alias("d"), F.col("t").alias("u"), F.col("bucket").alias("b"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    known = rows.join(sizes, (F.col("dim") == F.col("d")) & (F.col("t") == F.col("u")) & (F.col("bucket") == F.col("b")), "left").drop("d", "u", "b")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    return known.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumn("meet", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).drop("blocks", "other")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by ``keys``; a group never spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 4 * BLOCK:
            continue
        table = pa.Table.from_batches(held)
        change = _changes(table, keys)
        if len(change) > 1:
            yield table.slice(0, int(change[-1]))
            held = table.slice(int(change[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every group."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


_KEYS = ["dim", "t", "bucket", "meet"]


def _pairs_of(own: np.ndarray) -> np.ndarray:
    """Which pairs of a group's rows are its own: all of one block, or those across two blocks."""
    return own[:, None] != own[None, :] if own.min() != own.max() else ~np.eye(len(own), dtype=bool)


def _estimated(rows: DataFrame, threshold: float) -> DataFrame:
    """``node, dim, t, bucket`` of nodes that keep a possible partner in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEYS):
            starts = np.append(_changes(table, _KEYS), table.num_rows)
            dims = table.column("dim").to_numpy()
            col = {c: table.column(c).to_numpy() for c in ("own", "factor", "low", "step")}
            codes, levels = table.column("code").combine_chunks(), table.column("levels").combine_chunks()
            keep = np.zeros(table.num_rows, bool)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                dim = int(dims[a])
                raw = np.frombuffer(b"".join(codes.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                sign = np.unpackbits(raw, axis=1)[:, :dim].astype(np.float32) * 2 - 1
                packed = np.frombuffer(b"".join(levels.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                level = np.stack([packed >> 4, packed & 15], 2).reshape(b - a, -1)[:, :dim].astype(np.float32)
                low, step, factor = (col[c][a:b].astype(np.float32) for c in ("low", "step", "factor"))
                turned = level * step[:, None] + low[:, None]  # randomised rounding is unbiased
                estimate = (sign @ turned.T) / (math.sqrt(dim) * factor[:, None])
                bound = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(dim - 1, 1)))
                rounding = SIGMAS * step / (math.sqrt(12.0) * factor.min())
                possible = estimate + bound[:, None] + rounding[None, :] >= threshold
                possible &= possible.T
                possible &= _pairs_of(col["own"][a:b])
                keep[a:b] = possible.any(1)
            if keep.any():
                yield from table.select(["node", "dim", "t", "bucket"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return rows.mapInArrow(run, "node long, dim int, t int, bucket long")


def _least_in_group(linked: np.ndarray) -> np.ndarray:
    """Smallest row number reachable by links, for each row."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _exact(rows: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """``node, links, root``: links first met in this table, and a star over all links of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _KEYS):
            starts = np.append(_changes(table, _KEYS), table.num_rows)
            node, own, copies, tab = (table.column(c).to_numpy() for c in ("node", "own", "copies", "t"))
            vectors = table.column("vector").combine_chunks()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                unit = next(_by_dim(vectors.slice(a, b - a)))[1]
                linked = (unit @ unit.T >= threshold) & _pairs_of(own[a:b])
                if not linked.any():
                    continue
                t = int(tab[a])
                numbers = _plan(unit.shape[1], bits, tables).buckets(unit)[:, :t]
                i, j = np.nonzero(linked)
                fresh = np.ones(len(i), bool)
                for k in range(0, len(i), 200_000):
                    part = slice(k, k + 200_000)
                    fresh[part] = ~(numbers[i[part]] == numbers[j[part]]).any(1)
                links = np.bincount(i[fresh], weights=copies[a:b][j[fresh]], minlength=b - a).astype(np.int64)
                root = _least_in_group(linked)
                some = linked.any(1)
                out.append((node[a:b][some], links[some], node[a:b][root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def _met(rows: DataFrame) -> DataFrame:
    """Rows dealt by bucket and pair of blocks, groups together."""
    return rows.repartition(*[F.col(k) for k in _KEYS]).sortWithinPartitions(*_KEYS)


def components(
    embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row."""
    spark = configure(embeddings.sparkSession)
    v = F.col(vector).cast("array<double>")
    usable = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0), F.lit(False)
    )
    rows = embeddings.select(F.col(vec_id).alias("vec"), v.alias("vector"), usable.alias("usable"))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("vector"))).select("vec", "vector", "node")
    with scratch(spark) as store:
        clash = F.when(F.min("vector") != F.max("vector"), F.raise_error(F.lit("two vectors share a digest"))).otherwise(F.lit(True))
        nodes = store(
            rows.where("node IS NOT NULL").groupBy("node").agg(
                F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("least"), clash.cast("boolean").alias("sound")
            ).where("sound").drop("sound")
        )
        bits, tables = tables_for(nodes.count(), threshold, miss)
        codes = store(_coded(nodes, bits, tables))
        kept = store(_estimated(_met(_in_blocks(codes)), threshold).distinct())
        full = kept.join(nodes.select(F.col("node").alias("n"), "vector", "copies"), F.col("node") == F.col("n")).drop("n")
        found = store(_exact(_met(_in_blocks(full)), bits, tables, threshold))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        component = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        placed = (
            nodes.select("node", "copies", "least")
            .join(links.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").drop("n")
            .join(component.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").drop("n")
            .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
        )
        smallest = placed.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "k")
        of_node = placed.join(smallest, F.col("c") == F.col("k")).select(F.col("node").alias("n"), "n_links", "component_id")
        result = staged(
            rows.select("vec", "node").join(of_node, F.col("node") == F.col("n"), "left").select(
                F.col("vec").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec").alias("component_id")
            )
        )
    return result.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
