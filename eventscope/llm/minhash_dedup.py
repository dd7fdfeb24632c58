"""Near-duplicate documents: MinHash with tensored banding, links verified on full sets.

A document's set holds its distinct shingles of ``ngram`` words (A-Z lowered, words
cut at ASCII white space); with fewer words the whole sequence is the one
shingle; without words the set is empty and links with nothing. Documents are
linked if ``100 * intersection >= percent * union``.

* Equal sets are one node (a 64-bit digest of the set; a second one guards it: a
  clash stops the job instead of merging documents).
* Two collections of ``SIDE`` sub-keys are computed, each sub-key from ``ROWS``
  MinHashes. A table key combines one sub-key of either collection, so ``SIDE ** 2``
  tables of ``2 * ROWS`` rows need only ``2 * SIDE * ROWS`` MinHashes. At a similarity
  of 0.8 a pair shares a table with probability 0.9985, at 0.85 0.9998.
* Keys met once are dropped. Each node is first compared with one other node of
  its tables, the smallest; verified links form components. Only in tables that
  still hold several components are more pairs looked at, one per node and round,
  against nodes of another component. Pairs inside a component cannot change it, so
  no link between components is lost, and a large group of copies costs one
  comparison per member instead of all its pairs.
* What ``ROUNDS`` such rounds leave open is compared in full. Of tables with at most
  ``SMALL`` open nodes the pairs across components are formed, as far as their sizes allow a
  link: at most ``SMALL / 2`` rows a node. Larger ones are mostly copies of one text with
  many edits, part of them too far from any hub. Their tables, as far as they share
  nodes, are one cluster; it is dealt into blocks of about ``BLOCK_NODES`` nodes or
  ``BLOCK_SHINGLES`` shingles, and each two blocks meet in a task that holds the full sets
  and returns only links that join components it has not yet seen joined. A node is
  sent once for each block of its cluster, so the rows are those of the cluster times
  its blocks; the comparisons inside tasks are quadratic in an open cluster.
* Verification compares full sets: of pairs by joining their two texts.

Texts needed for verification are read once, picked by a bit map of fixed size,
and kept compressed as Parquet in the shared folder while the operator runs. A
bit map of the shared table keys likewise spares most rows the second shuffle.

Defined results: NULL and empty texts are components of their own; equal rows fall
together; NULL ids are never the smallest of a component that has another id; an
empty table gives no rows; extra columns are ignored or kept (`components`'s
``keep``; ``n_shingles``, ``component_id`` and ``kept`` replace inputs of these names).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, configure, connected_components, few, scratch, staged
from .textops import lowered, mixed, ragged, run_hashes, slices, utf8, word_runs

NGRAM = 5
PERCENT = 80
SIDE = 10
ROWS = 3
ROUNDS = 1
SMALL = 8
BLOCK_NODES = 1024
BLOCK_SHINGLES = 500_000
BITS = 1 << 25

_rng = np.random.Generator(np.random.PCG64(77))
_SCALE = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's first one (n + 1)."""
    body = lowered(raw)
    starts, lengths, first = word_runs(body, offsets, dark=True)
    h = run_hashes(body, starts, lengths)
    count = np.diff(first)
    docs, found = [], []
    for size in range(1, ngram + 1):
        which = np.flatnonzero(count >= ngram if size == ngram else count == size)
        if not len(which):
            continue
        n = count[which] - size + 1
        at = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        s = np.full(len(at), size, np.uint64)
        for t in range(size):
            s = mixed(s + h[at + t], t)
        docs.append(np.repeat(which, n))
        found.append(s)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    doc, s = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _signatures(rows: DataFrame, ngram: int) -> DataFrame:
    """``row, n_shingles, node, guard, a, b`` (``node`` NULL for an empty set)."""
    out = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("body_key", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("guard", T.LongType()),
        T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                part = batch.slice(i, j - i)
                s, at = shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ngram)
                n = np.diff(at)
                full = np.flatnonzero(n)
                heads = at[full]
                if len(full):
                    digest = [np.add.reduceat(mixed(s, 101 + k), heads) + mixed(n[full].astype(np.uint64), 103 + k) for k in (0, 1)]
                    low = np.stack([np.minimum.reduceat(s * a + b, heads) for a, b in zip(_SCALE, _SHIFT, strict=True)])
                    keys = np.zeros((2 * SIDE, len(full)), np.uint64)
                    for k in range(2 * SIDE):
                        keys[k] = k
                        for r in range(ROWS):
                            keys[k] = mixed(keys[k] + low[k * ROWS + r], 200 + r)
                else:
                    digest, keys = [np.zeros(0, np.uint64)] * 2, np.zeros((2 * SIDE, 0), np.uint64)
                missing = n == 0
                wide = lambda v: pa.array(np.where(missing, 0, np.take(np.append(v.view(np.int64), 0), np.cumsum(~missing) - 1)), pa.int64(), mask=missing)
                lists = lambda block: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(missing, 0, SIDE))]).astype(np.int32)), pa.array(block.T.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("body_key"), pa.array(n.astype(np.int64)), wide(digest[0]), wide(digest[1]),
                     lists(np.ascontiguousarray(keys[:SIDE])), lists(np.ascontiguousarray(keys[SIDE:]))],
                    out.names,
                )

    return rows.mapInArrow(run, out)


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _table_keys(nodes: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """``node, n, key``: each node's key in every table, or only those that ``wanted`` lets through."""
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                a, b = (part.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SIDE) for c in "ab")
                keys = mixed(a[:, :, None] + mixed(b, 301)[:, None, :], 302).reshape(len(a), -1).view(np.int64)
                keep = np.ones(keys.shape, bool) if shared.value is None else _is_set(np.frombuffer(shared.value, np.uint8), keys)
                row, table = np.nonzero(keep)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("node").take(take), part.column("n").take(take), pa.array(keys[row, table])], ["node", "n", "key"])

    return nodes.select("node", "n", "a", "b").mapInArrow(run, "node long, n int, key long")


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``body_key, body`` (compressed) of rows whose text is wanted, and of a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(wanted, "body_key", BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            part = batch.filter(pa.array(_is_set(bits, batch.column("body_key").to_numpy(zero_copy_only=False))))
            packed = pa.array([zlib.compress(t.encode(), 6) for t in part.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("body_key"), packed], ["body_key", "body"])

    return rows.select("body_key", "body").mapInArrow(run, "body_key long, body binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Compressed texts as one byte array and their offsets."""
    texts = [zlib.decompress(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("node_a"), F.col("body").alias("text_a"))
    right = texts.select(F.col("node").alias("node_b"), F.col("body").alias("text_b"))
    half = pairs.join(left, F.col("a") == F.col("node_a")).select("a", "b", "text_a")
    both = half.join(right, F.col("b") == F.col("node_b")).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                j = min(i + 128, batch.num_rows)
                sets, of = [], []
                for side in ("text_a", "text_b"):
                    s, at = shingle_sets(*_unpacked(batch.column(side).slice(i, j - i)), ngram)
                    sets.append(s)
                    of.append(np.repeat(np.arange(j - i), np.diff(at)))
                s, pair = np.concatenate(sets), np.concatenate(of)
                order = np.lexsort((s, pair))
                s, pair = s[order], pair[order]
                shared = pair[1:][(s[1:] == s[:-1]) & (pair[1:] == pair[:-1])]
                common = np.bincount(shared, minlength=j - i)
                union = np.bincount(pair, minlength=j - i) - common
                yield batch.select(["a", "b"]).slice(i, j - i).filter(pa.array(100 * common >= percent * union))

    return both.mapInArrow(run, "a long, b long")


class _Forest:
    """Components that links of one task have joined."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def tops(self) -> np.ndarray:
        """The top of every component (paths are cut short on the way)."""
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return above
            self.up = above

    def join(self, x: int, y: int) -> bool:
        while self.up[x] != x:
            x = self.up[x]
        while self.up[y] != y:
            y = self.up[y]
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_between(
    s: np.ndarray, at: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> Iterator[tuple[int, int]]:
    """Links ``(row, row)`` of sets ``s[at[i] : at[i + 1]]`` across ``left`` and ``right`` rows, enough to join all components that links join.

    A row's set is marked in a table of all elements and counted over the rows of
    the other side; where most of them are in its component already, over the rest.
    """
    ids = np.unique(s, return_inverse=True)[1]
    sizes, same = np.diff(at), left is right
    _, group = np.unique(component, return_inverse=True)
    forest = _Forest(int(group.max(initial=-1)) + 1)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    top = forest.tops()

    def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows, ids[ragged(at[rows], sizes[rows])], np.cumsum(sizes[rows]) - sizes[rows]

    everything, rest = side(right), (-1, None)
    for i in left:
        mine = top[group[i]]
        # within one block, the component that comes first does the comparing
        apart = top[group[right]] > mine if same else top[group[right]] != mine
        if not apart.any():
            continue
        if 2 * np.count_nonzero(apart) < len(right):
            if rest[0] != mine:
                rest = mine, side(right[apart])
            rows, elements, begin = rest[1]
        else:
            rows, elements, begin = everything
        own = ids[at[i] : at[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[elements], begin)
        mark[own] = 0
        joined = False
        for j in rows[(100 * common >= percent * (sizes[i] + sizes[rows] - common)) & (top[group[rows]] != mine)]:
            if forest.join(group[i], group[j]):
                joined = True
                yield int(i), int(j)
        if joined:
            top, rest = forest.tops(), (-1, None)


def _within_clusters(still: DataFrame, texts: DataFrame, ngram: int, percent: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links ``(a, b)`` across components, of the tables in ``still`` (``key, node, n, c``) as clusters."""
    least = still.groupBy("key").agg(F.min("node").alias("least")).withColumnRenamed("key", "k")
    stars = still.join(least, F.col("key") == F.col("k")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    cluster = connected_components(stars).select(F.col("node").alias("m"), F.col("component").alias("cluster"))
    nodes = store(still.select("node", "n", "c").distinct().join(cluster, F.col("node") == F.col("m")).drop("m"))
    blocks = nodes.groupBy(F.col("cluster").alias("k")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    body = texts.select(F.col("node").alias("m"), "body")
    dealt = nodes.join(blocks, F.col("cluster") == F.col("k")).withColumn("own", own).join(body, F.col("node") == F.col("m")).select(
        "cluster", "node", "c", "own", "body", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "body")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        s, at = shingle_sets(*_unpacked(table.column("body")), ngram)
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        node, component = table.column("node").to_numpy(), table.column("c").to_numpy()
        # rows in order of component: those of one component share what they are compared with
        in_order = lambda rows: rows[np.argsort(component[rows], kind="stable")]
        left = in_order(np.flatnonzero(own == i))
        right = left if i[0] == j[0] else in_order(np.flatnonzero(own == j))
        found = list(links_between(s, at, component, left, right, percent))
        a, b = (node[np.array([x[k] for x in found], np.int64)] for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _components(members: DataFrame, texts: DataFrame, ngram: int, percent: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, component`` of nodes that have a verified link."""
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pairs = staged(members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub")).select(*ordered("node", "hub")))
    tested, component = pairs, connected_components(_verified(pairs, texts, ngram, percent))
    for turn in range(ROUNDS + 1):
        placed = few(members.join(component.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(
            "key", "node", "n", F.coalesce("component", "node").alias("c")
        ))
        # another node of the table, against which the other components are held
        rank = F.xxhash64("node", F.lit(turn))
        tables = placed.groupBy("key").agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("node", "c", "n"), rank).alias("hub"), F.count(F.lit(1)).alias("open")
        ).where("lo < hi").select(
            F.col("key").alias("k"), F.col("hub.node").alias("hub"), F.col("hub.c").alias("hub_c"), F.col("hub.n").alias("hub_n"), "open"
        )
        still = store(placed.join(few(tables), F.col("key") == F.col("k")).drop("k"))
        if still.isEmpty():
            break
        beside = None
        if turn < ROUNDS:
            found = still.where("c <> hub_c").where(fits("n", "hub_n")).select(*ordered("node", "hub"))
        else:
            large = still.where(F.col("open") > SMALL).select("key", "node", "n", "c")
            if not large.isEmpty():
                beside = staged(_within_clusters(large, texts, ngram, percent, store))
            small = still.where(F.col("open") <= SMALL)
            other = small.select(F.col("key").alias("k"), F.col("node").alias("o"), F.col("c").alias("o_c"), F.col("n").alias("o_n"))
            found = small.join(other, (F.col("key") == F.col("k")) & (F.col("c") < F.col("o_c")) & fits("n", "o_n")).select(*ordered("node", "o"))
        fresh = few(few(found).distinct()).join(tested, ["a", "b"], "left_anti")
        if turn < ROUNDS:
            # one pair per node and round
            fresh = few(fresh).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        pairs = staged(fresh)
        if pairs.isEmpty() and beside is None:
            continue
        tested = tested.unionByName(pairs)
        more = _verified(pairs, texts, ngram, percent)
        if beside is not None:
            more = more.unionByName(beside)
        # new links join components
        at = component.select(F.col("node").alias("m"), "component")
        lifted = few(more.join(at, F.col("a") == F.col("m"), "left").select("b", F.coalesce("component", "a").alias("a")))
        lifted = few(lifted.join(at, F.col("b") == F.col("m"), "left").select("a", F.coalesce("component", "b").alias("b")))
        joined = connected_components(lifted).select(F.col("node").alias("m"), F.col("component").alias("c"))
        grown = component.join(joined, F.col("component") == F.col("m"), "left").select("node", F.coalesce("c", "component").alias("component"))
        alone = joined.join(component.select("node"), F.col("m") == F.col("node"), "left_anti").select(F.col("m").alias("node"), F.col("c").alias("component"))
        component = staged(grown.unionByName(alone))
    return component


def components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, percent: int = PERCENT, keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default all) of ``docs`` plus ``n_shingles, component_id, kept``."""
    spark = configure(docs.sparkSession)
    own = ["n_shingles", "component_id", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(F.col(doc_id).alias("doc")).alias("row"), F.xxhash64(body).alias("body_key"), body.alias("body"))
    with scratch(spark) as store:
        signed = store(_signatures(rows, ngram).select(F.col("row.doc").alias("doc"), "body_key", "n_shingles", "node", "guard", "a", "b"))
        clash = F.when(F.min("guard") != F.max("guard"), F.raise_error(F.lit("two shingle sets share a digest"))).otherwise(F.lit(True))
        nodes = store(
            signed.where("node IS NOT NULL").groupBy("node").agg(
                F.min("doc").alias("doc"), F.min("body_key").alias("body_key"), F.first("n_shingles").cast("int").alias("n"),
                F.first("a").alias("a"), F.first("b").alias("b"), clash.cast("boolean").alias("sound"),
            ).where("sound").drop("sound")
        )
        shared = store(
            _table_keys(nodes).groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("met"))
            .where("met > 1").select(F.col("key").alias("k"), "hub")
        )
        # the second pass sends only keys that may be shared; the join decides
        again = _table_keys(nodes, bit_map(shared, "k", BITS))
        members = store(again.join(shared, F.col("key") == F.col("k")).select("key", "node", "n", "hub"))
        wanted = store(
            members.select(F.col("node").alias("m")).distinct().join(nodes, F.col("node") == F.col("m")).select("node", F.col("body_key").alias("k"))
        )
        texts = store(
            _picked(rows, wanted.withColumnRenamed("k", "body_key")).groupBy("body_key").agg(F.first("body").alias("body"))
            .join(wanted, F.col("body_key") == F.col("k")).select("node", "body")
        )
        component = _components(members, texts, ngram, percent, store).withColumnRenamed("node", "m")
        least = nodes.join(component, F.col("node") == F.col("m"), "left").select("node", "doc", F.coalesce("component", "node").alias("c"))
        smallest = least.groupBy("c").agg(F.min("doc").alias("component_id")).withColumnRenamed("c", "k")
        of_node = least.join(smallest, F.col("c") == F.col("k")).select(F.col("node").alias("m"), "component_id")
        placed = staged(
            signed.select("doc", "body_key", "n_shingles", "node").join(of_node, F.col("node") == F.col("m"), "left")
            .select("doc", "body_key", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
        )
    placed = placed.withColumn("kept", F.col("doc").eqNullSafe(F.col("component_id")))
    if keep == [doc_id]:
        return placed.select(F.col("doc").alias(doc_id), *own)
    judged = placed.dropDuplicates(["doc", "body_key"]).select(F.col("doc").alias("d"), F.col("body_key").alias("k"), *own)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(doc_id).alias("doc"), F.xxhash64(body).alias("body_key"))
    return base.join(judged, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body_key") == F.col("k"))).select(
        *[F.col("row")[c].alias(c) for c in keep], *own
    )
