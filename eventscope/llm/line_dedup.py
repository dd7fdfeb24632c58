"""Line deduplication by winnowing over line hashes.

A run is a stretch of consecutive lines of one document with at least ``min_words``
words. A run is a later repeat if the same lines stand, in the same order, at an
earlier place of the corpus (documents in order of id, then of text hash; lines
in order). Every line inside a later repeat is deleted; first occurrences stay.

1. Winnowing. From each line the shortest run is a window; the smallest hash of
   its lines is its fingerprint. A repeated run holds the same window at its start
   in both places, so both select the same line: each repeat shares a fingerprint.
2. Join positions. Fingerprints are counted (combined on the map side); those met
   at one place only are dropped. The shared ones become a bit map of fixed size
   (``BITS``), a filter that can only let too much through.
3. Extend both ways. From the lines of a window that passed, the match is grown
   forward (shortest run that starts there) and backward (shortest run that ends
   there). The lines of a repeated run are exactly covered by such runs that
   lie inside it. Equal runs meet by two independent 64-bit content keys; the least place of
   each is combined on the map side and joined back (a hot run's partition is
   split by the skew join), and all later places are deleted.

Defined results: NULL texts stay NULL; empty texts have one empty line; blank
lines have no words and take part in runs; rows that repeat id and text stand at
one place, so none of them is later than the other; an empty table gives no
rows; extra columns stay (``removed_lines`` replaces an input of that name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, configure, staged
from .textops import line_runs, mixed, run_hashes, slices, utf8, word_runs

MIN_WORDS = 50
BITS = 1 << 25


class _Lines:
    """Lines of some texts: hashes, words, and the windows that start or end at each line."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_words: int):
        starts, lengths, self.first = line_runs(raw, offsets)
        n = len(starts)
        full = lengths > 0
        self.hash = np.zeros((2, n), np.uint64)
        for k in (0, 1):
            self.hash[k, full] = run_hashes(raw, starts[full], lengths[full], seed=k)
        word_starts, _, _ = word_runs(raw, offsets, dark=True)
        self.words = np.searchsorted(word_starts, starts + lengths) - np.searchsorted(word_starts, starts)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        upto = np.concatenate([[0], np.cumsum(self.words)])
        line = np.arange(n)
        # [line, stop): shortest run forward; [begin, line + 1): shortest run backward
        stop = np.searchsorted(upto, upto[:-1] + min_words, "left")
        begin = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
        forward = stop <= self.first[doc + 1]
        backward = (upto[1:] >= min_words) & (begin >= self.first[doc])
        self.order = np.where(self.words > 0, mixed(self.hash[0], 7), np.uint64(2**64 - 1))
        self.forward_stop = stop
        self.forward = line[forward], stop[forward]
        self.backward = begin[backward], line[backward] + 1
        self.doc = doc

    def fingerprints(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The smallest line hash of each window."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        padded = np.append(self.order, np.uint64(2**64 - 1))
        return np.minimum.reduceat(padded, np.stack([begin, stop], 1).ravel())[::2]

    def keys(self, begin: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit content keys of runs of lines, each over the line hashes of its own seed, taken in one after another."""
        return [run_hashes(self.hash[k].view(np.uint8), 8 * begin, 8 * (stop - begin), seed=k) for k in (0, 1)]


def _fingerprint_counts(rows: DataFrame, min_words: int) -> DataFrame:
    """``f, n``: fingerprints and how many lines of a batch's documents carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                lines = _Lines(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_words)
                chosen = np.unique(lines.fingerprints(*lines.forward))
                value, n = np.unique(lines.order, return_counts=True)
                met = np.isin(value, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(value[met].view(np.int64)), pa.array(n[met])], ["f", "n"])

    return rows.select("body").mapInArrow(run, "f long, n long")


def _windows(rows: DataFrame, shared_fingerprints: bytes, min_words: int) -> DataFrame:
    """``k0, k1, doc, body_key, begin, stop`` of the runs, grown both ways, whose fingerprint is shared."""
    shared = rows.sparkSession.sparkContext.broadcast(shared_fingerprints)
    schema = T.StructType([
        T.StructField("k0", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType),
        T.StructField("body_key", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                lines = _Lines(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_words)
                begin = np.concatenate([lines.forward[0], lines.backward[0]])
                stop = np.concatenate([lines.forward[1], lines.backward[1]])
                place = np.unique(begin * (len(lines.doc) + 1) + stop)
                begin, stop = place // (len(lines.doc) + 1), place % (len(lines.doc) + 1)
                # a run holds the shortest run from its first line; that one's fingerprint speaks for it
                at = lines.fingerprints(begin, lines.forward_stop[begin]).view(np.int64) % BITS
                passed = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                begin, stop = begin[passed], stop[passed]
                k0, k1 = lines.keys(begin, stop)
                doc = lines.doc[begin]
                part = batch.slice(i, j - i)
                take = pa.array(doc)
                base = lines.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k0.view(np.int64)), pa.array(k1.view(np.int64)), part.column("doc").take(take), part.column("body_key").take(take),
                        pa.array((begin - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)),
                    ],
                    schema.names,
                )

    return rows.select("doc", "body_key", "body").mapInArrow(run, schema)


def later_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, body_key, runs array<struct<begin, stop>>``: for each text with deletions, the line ranges to delete."""
    configure(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body_key"), F.col(text).alias("body"))
    often = _fingerprint_counts(rows, min_words).groupBy("f").agg(F.sum("n").alias("n")).where("n > 1")
    windows = staged(_windows(rows, bit_map(often, "f", BITS), min_words))
    place = F.struct("doc", "body_key", "begin")
    first = windows.groupBy("k0", "k1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("k0").alias("a"), F.col("k1").alias("b"), "first"
    )
    later = windows.join(first, (F.col("k0") == F.col("a")) & (F.col("k1") == F.col("b"))).where(place > F.col("first"))
    return later.groupBy("doc", "body_key").agg(F.collect_set(F.struct("begin", "stop")).alias("runs"))


def dedup_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default all) of ``docs`` with ``text`` cut, plus ``n_lines`` and ``removed_lines``."""
    own = ["n_lines", "removed_lines"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    runs = later_repeats(docs, doc_id=doc_id, text=text, min_words=min_words).select(
        F.col("doc").alias("run_doc"), F.col("body_key").alias("run_key"), "runs"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body_key"), F.col(text).alias("body")
    )
    joined = rows.join(runs, F.col("doc").eqNullSafe(F.col("run_doc")) & (F.col("body_key") == F.col("run_key")), "left")
    return _cut(joined.select("row", "body", "runs"), text, keep)


def _cut(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("body", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("removed_lines", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lines, removed = batch.column("body").to_pylist(), [], []
            spans = batch.column("runs")
            for i, body in enumerate(bodies):
                n = body.count("\n") + 1 if body is not None else 0
                gone = 0
                if spans[i].is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    found = spans[i].values
                    np.add.at(edge, found.field("begin").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, found.field("stop").to_numpy(zero_copy_only=False), -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = n - int(stays.sum())
                    bodies[i] = "\n".join([x for x, s in zip(body.split("\n"), stays.tolist(), strict=True) if s])
                lines.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(bodies, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], schema.names
            )

    return rows.mapInArrow(run, schema).select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("body").alias(text), "n_lines", "removed_lines"
    )
