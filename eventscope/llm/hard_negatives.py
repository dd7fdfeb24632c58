"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, searched by a multi-sequence heap.

Rows hold an id, a label and a vector of whole numbers; a row's score for an anchor is
their inner product. An anchor's positives are the first ``positives`` other rows of its
label, by falling score, ties by id. For each positive, its negatives are the first
``negatives`` rows of other labels whose score lies in the window
``[low % , high %]`` of the positive's score.

1. Codebooks. Either half of the vectors has a codebook of ``CODES`` centroids, fitted by
   Lloyd rounds on at most ``SAMPLE`` rows (the least hashes of id); the sample only
   shapes the cells, every row is indexed. A row's two codes name its cell.
2. Shards. Neighbouring cells are put together to shards of about ``SHARD`` rows; a
   larger cell is dealt over several shards. The directory of cells (at most
   ``CODES ** 2`` for each vector length) and each code's radius in a shard, the longest residual, are
   all that the driver and the tasks hold of the whole.
3. Search. In each shard, an anchor's cells are visited in falling order of
   ``q1.c1 + |q1| r1 + q2.c2 + |q2| r2``, which no row of the cell can exceed: a heap walks
   the two sorted lists of half scores. Visiting stops once the next bound is strictly
   below the last wanted score, for each window that is not yet below its low end.
   So each shard's answer is certified exact, and so is the merged one.
4. Two passes: positives of all anchors, then the windows they set. In the second,
   an anchor is sent only to shards whose bound reaches its lowest window.

Anchors go to shards in blocks of at most about ``ANCHORS``; shuffled are the
vectors once for each block, the anchors once for each shard they may need.

Defined results: rows without id, label or vector, or with a NULL or non-finite
component take no part; rows that repeat an id count once (least label, then vector);
vectors of different length do not meet; an anchor without positives or with empty
windows gives no rows; an empty table gives no rows; other columns are ignored.
A hundred times an inner product must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, kept_table, scratch

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
CODES = 16
SAMPLE = 4096
ROUNDS = 8
SHARD = 8192
ANCHORS = 4096
# Rows scored at once: the first wave of an anchor, doubled with each further one.
WAVE = 128


def whole_numbers(embedding: str | Column, scale: int = 256) -> Column:
    """Components times ``scale``, rounded down; NULL if one is NULL or not finite."""
    col = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(col, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def fit(sample: np.ndarray, codes: int, rounds: int) -> np.ndarray:
    """Centroids by Lloyd rounds, begun at rows spread over the sample; fewer rows give fewer centroids."""
    start = np.unique(sample, axis=0)
    centers = start[np.linspace(0, len(start) - 1, min(codes, len(start))).astype(int)]
    for _ in range(rounds):
        of = nearest(sample, centers)
        n = np.bincount(of, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, of, sample)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


def _codebooks(rows: DataFrame, codes: int, sample: int, rounds: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> centroids of either half (a length that the sample misses has one centroid, the origin)."""
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect():
        found.setdefault(len(r.vec), []).append(r.vec)
    books = {}
    for dim, vectors in found.items():
        x, half = np.array(vectors, np.float64).reshape(len(vectors), dim), dim // 2
        books[dim] = fit(x[:, :half], codes, rounds), fit(x[:, half:], codes, rounds)
    return books


def halves(books: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))


def _indexed(rows: DataFrame, books: dict) -> DataFrame:
    """``rows`` plus ``c1, c2, r1, r2``: codes and residual lengths of both halves."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, half = _matrix(part.column("vec"), int(dim)), int(dim) // 2
                codes, residuals = [], []
                for side, centers in zip((x[:, :half], x[:, half:]), halves(shared.value, int(dim)), strict=True):
                    code = nearest(side, centers)
                    codes.append(pa.array(code.astype(np.int32)))
                    residuals.append(pa.array(np.sqrt(((side - centers[code]) ** 2).sum(1))))
                yield pa.RecordBatch.from_arrays([*part.columns, *codes, *residuals], [*part.schema.names, "c1", "c2", "r1", "r2"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, label int, vec array<long>, dim int, c1 int, c2 int, r1 double, r2 double")


class Cells:
    """The rows of a shard by cell, for the search of one anchor at a time."""

    def __init__(self, x: np.ndarray, c1: np.ndarray, c2: np.ndarray, r1: np.ndarray, r2: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        n1, n2 = len(books[0]), len(books[1])
        cell = c1 * n2 + c2
        self.order = np.argsort(cell, kind="stable")
        self.at = np.searchsorted(cell[self.order], np.arange(n1 * n2 + 1))
        self.books, self.n2 = books, n2
        self.radius = np.full(n1, -1.0), np.full(n2, -1.0)
        np.maximum.at(self.radius[0], c1, r1)
        np.maximum.at(self.radius[1], c2, r2)
        self.half = books[0].shape[1]
        # products of whole numbers are exact in doubles below 2 ** 53
        self.most = float(np.abs(x).max(initial=0))
        self.x, self.whole = x[self.order], None

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2**53:
            return (self.x[rows] @ q).astype(np.int64)
        if self.whole is None:
            self.whole = self.x.astype(np.int64)
        return self.whole[rows] @ q.astype(np.int64)

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Waves of rows, and a bound on the score of all rows that come after: cells by falling sum of half bounds."""
        sides = []
        for part, centers, radius in zip((q[: self.half], q[self.half :]), self.books, self.radius, strict=True):
            some = np.flatnonzero(radius >= 0)
            bound = centers[some] @ part + np.sqrt(part @ part) * radius[some]
            falling = np.argsort(-bound, kind="stable")
            sides.append((bound[falling], some[falling]))
        (s1, i1), (s2, i2) = sides
        if not len(s1):
            return
        heap, reached = [(-(s1[0] + s2[0]), 0, 0)], {(0, 0)}
        rows, size, wave = [], 0, WAVE
        while heap:
            _, i, j = heapq.heappop(heap)
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(s1) and b < len(s2) and (a, b) not in reached:
                    reached.add((a, b))
                    heapq.heappush(heap, (-(s1[a] + s2[b]), a, b))
            cell = i1[i] * self.n2 + i2[j]
            if n := self.at[cell + 1] - self.at[cell]:
                rows.append(np.arange(self.at[cell], self.at[cell + 1]))
                size += n
            if size >= wave or not heap and size:
                after = -heap[0][0] if heap else -np.inf
                # room for the rounding of the bounds
                yield after + 1e-6 * (1 + abs(after)) if heap else after, np.concatenate(rows)
                rows, size, wave = [], 0, 2 * wave


def nearest_rows(cells: Cells, q: np.ndarray, allowed: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` allowed rows and their scores, by falling score, then ``rank``."""
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bound, rows in cells.visit(q):
        rows = rows[allowed[rows]]
        best, scores = np.concatenate([best, rows]), np.concatenate([scores, cells.scores(rows, q)])
        top = np.lexsort((rank[best], -scores))[:k]
        best, scores = best[top], scores[top]
        if len(best) == k and bound < scores[-1]:
            break
    return best, scores


def window_rows(
    cells: Cells, q: np.ndarray, allowed: np.ndarray, rank: np.ndarray, windows: np.ndarray, k: int, low: int, high: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window score ``p``, the first ``k`` allowed rows whose score s has ``low p <= 100 s <= high p``."""
    open_ = {int(p): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in windows}
    done = {}
    for bound, rows in cells.visit(q):
        rows = rows[allowed[rows]]
        score = cells.scores(rows, q)
        for p, (best, scores) in list(open_.items()):
            inside = (low * p <= 100 * score) & (100 * score <= high * p)
            best, scores = np.concatenate([best, rows[inside]]), np.concatenate([scores, score[inside]])
            top = np.lexsort((rank[best], -scores))[:k]
            open_[p] = best[top], scores[top]
            if 100 * bound < low * p or len(top) == k and bound < scores[top[-1]]:
                done[p] = open_.pop(p)
        if not open_:
            break
    for p, (best, scores) in {**done, **open_}.items():
        yield p, best, scores


def _search(shards: DataFrame, anchors: DataFrame, books: dict, kind: str, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """``anchor, window, other, score`` of each shard: positives (``window`` NULL) for anchors without windows, else negatives."""
    shared = shards.sparkSession.sparkContext.broadcast(books)
    names = ["anchor", "window", "other", "score"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (right.schema.field("id").type, pa.int64(), left.schema.field("id").type, pa.int64()), strict=True)})
        left, dim = left.combine_chunks(), left.column("dim")[0].as_py()
        column = lambda c: left.column(c).to_numpy()
        one = lambda t: t.column("vec").combine_chunks()
        cells = Cells(_matrix(one(left), dim), column("c1"), column("c2"), column("r1"), column("r2"), halves(shared.value, dim))
        ids = left.column("id").combine_chunks().take(pa.array(cells.order))
        labels, place = column("label")[cells.order], pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        q = _matrix(one(right), dim)
        of, window, other, score = [], [], [], []
        spot = pa.compute.index_in(right.column("id").combine_chunks(), ids).to_pylist()
        windows = right.column("windows").to_pylist()
        label = right.column("label").to_numpy()
        for a in range(len(q)):
            if windows[a] is None:
                allowed = labels == label[a]
                if spot[a] is not None:
                    allowed[spot[a]] = False
                found = [(None, *nearest_rows(cells, q[a], allowed, place, positives))]
            else:
                found = window_rows(cells, q[a], labels != label[a], place, np.array(windows[a]), negatives, low, high)
            for p, rows, s in found:
                of += [a] * len(rows)
                window += [p] * len(rows)
                other.append(rows)
                score.append(s)
        flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
        return pa.table({
            "anchor": right.column("id").combine_chunks().take(pa.array(of, pa.int64())), "window": pa.array(window, pa.int64()),
            "other": ids.take(flat(other)), "score": flat(score),
        })

    by = ["dim", "shard", "block"]
    return shards.groupBy(*by).cogroup(anchors.groupBy(*by)).applyInArrow(run, f"anchor {kind}, window long, other {kind}, score long")


def _reached(anchors: DataFrame, books: dict, directory: dict[int, list]) -> DataFrame:
    """``anchors`` with ``shard``: once for each shard whose rows may reach the lowest window (all, without windows)."""
    shared = anchors.sparkSession.sparkContext.broadcast((books, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, directory = shared.value
        # per vector length: all cells of all shards in one row, and where each shard's begin
        flat = {}
        for dim, shards in directory.items():
            c1, c2 = (np.concatenate([x[k] for x in shards]) for k in (1, 2))
            sizes = np.array([len(x[1]) for x in shards])
            r1, r2 = (np.repeat([x[k] for x in shards], sizes) for k in (3, 4))
            flat[dim] = np.array([x[0] for x in shards]), np.cumsum(sizes) - sizes, c1, c2, r1, r2
        for batch in batches:
            dims, least = batch.column("dim").to_pylist(), batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = batch.column("vec").to_pylist()
            row, shard = [], []
            for i, dim in enumerate(dims):
                if dim not in flat:
                    continue
                number, begin, c1, c2, r1, r2 = flat[dim]
                b1, b2 = halves(books, dim)
                q = np.array(vectors[i], np.float64)
                x, y = q[: dim // 2], q[dim // 2 :]
                bound = np.maximum.reduceat((b1 @ x)[c1] + np.sqrt(x @ x) * r1 + (b2 @ y)[c2] + np.sqrt(y @ y) * r2, begin)
                near = number[~(bound + 1e-6 * (1 + np.abs(bound)) < least[i])]  # a missing least is no number
                row += [i] * len(near)
                shard += near.tolist()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns] + [pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{columns}, shard int")


def mine(
    vectors: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", vector: str = "vector", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    codes: int = CODES, shard_rows: int = SHARD, anchor_rows: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector`` is ``array<long>`` (``whole_numbers``), ``is_anchor`` a condition on ``vec_id``.
    """
    spark = configure(vectors.sparkSession)
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    ).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"), F.first("asks").alias("asks"))
    with scratch(spark) as store:
        plain = store(rows.select("id", "r.label", "r.vec", F.size("r.vec").alias("dim"), "asks"))
        books = _codebooks(plain, codes, SAMPLE, ROUNDS)
        index = store(_indexed(plain.select("id", "label", "vec", "dim"), books))
        n_anchors = plain.where("asks").count()
        blocks = max(1, -(-n_anchors // anchor_rows))
        # cells in order, put together to shards; a large cell takes several
        counted = index.groupBy("dim", "c1", "c2").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", "c1", "c2").collect()
        place, shard, filled, last = [], -1, shard_rows, None
        for r in counted:
            if r.dim != last or filled + r.n > shard_rows:
                shard, filled = shard + 1, 0
            parts = max(1, -(-r.n // shard_rows))
            place.append((r.dim, r.c1, r.c2, shard, parts))
            shard, filled, last = shard + parts - 1, filled + r.n // parts, r.dim
        cells = spark.createDataFrame(place, "k_dim int, k_c1 int, k_c2 int, first int, parts int")
        dealt = index.join(
            F.broadcast(cells), (F.col("dim") == F.col("k_dim")) & (F.col("c1") == F.col("k_c1")) & (F.col("c2") == F.col("k_c2"))
        ).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
        shards = store(dealt.select("id", "label", "vec", "dim", "c1", "c2", "r1", "r2", "shard"))
        directory: dict[int, list] = {}
        radii = shards.groupBy("dim", "shard").agg(F.collect_set(F.struct("c1", "c2")).alias("cells"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
        for r in radii.orderBy("dim", "shard").collect():
            c1, c2 = (np.array([getattr(c, name) for c in r.cells]) for name in ("c1", "c2"))
            directory.setdefault(r.dim, []).append((r.shard, c1, c2, r.r1, r.r2))
        asking = plain.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(blocks)).cast("int"))
        spread = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else shards.withColumn("block", F.lit(0))

        first = asking.select("id", "label", "vec", "dim", "block", F.lit(None).cast("array<long>").alias("windows"), F.lit(None).cast("double").alias("least"))
        best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "other")
        mates = store(
            _search(spread, _reached(first, books, directory), books, kind, positives, negatives, low, high)
            .withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        )
        wanted = mates.groupBy("anchor").agg(F.collect_set("positive_score").alias("windows"), (F.min("positive_score").cast("double") * low / 100).alias("least"))
        second = asking.join(wanted, F.col("id") == F.col("anchor")).select("id", "label", "vec", "dim", "block", "windows", F.col("least").cast("double").alias("least"))
        near = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "other")
        found = _search(spread, _reached(second, books, directory), books, kind, positives, negatives, low, high).withColumn(
            "rank", F.row_number().over(near)
        ).where(F.col("rank") <= negatives).select(F.col("anchor").alias("a"), "window", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
        return kept_table(
            mates.join(found, (F.col("anchor") == F.col("a")) & (F.col("positive_score") == F.col("window"))).select(
                F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
            )
        )
