"""Ranked lexical search: the best position algorithm over impact lists.

Terms are the words of a text (runs of digits, letters and non-ASCII signs, A-Z
lowered). A document's score for an item sums, over the item's terms with repeats,
``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``
and ``m = 25 + (75 * n * N) div L`` in 64-bit integers (``N`` documents with a term,
``L`` their terms, ``n`` the document's terms, ``df`` documents with the term, ``tf`` its
occurrences). The ``k`` best documents with a score above 0 are returned, ties by id.

1. Postings. One pass over the whole texts keeps, per document, its length and the
   counts of terms that some item has, as Parquet in the shared folder; ``N``, ``L`` and
   all ``df`` are counted from that table.
2. Impact lists. A task takes its documents in shards of about ``SHARD_POSTINGS``
   postings. Each term's postings are ordered by impact, with every posting's
   position in its list kept beside the document (the direct access).
3. Best positions. The lists of an item are read downwards, in parallel and in growing
   steps. Each new document is completed by direct accesses to all its terms, which
   also mark their positions as seen. A list's best position ends its unbroken
   seen stretch; no unseen document can score more than the sum of the impacts at the
   best positions (0 for a list that was seen whole). Reading stops once that sum is
   strictly below the shard's k-th score, so that ties are never cut.
4. The shards' results meet per item; a limit inside each task precedes the shuffle.

Items are taken in blocks of at most ``BLOCK_BYTES`` distinct term bytes (a block
holds one item at least); each block reads the documents once.

Defined results: NULL and empty texts have no terms, and such items and documents
are in no result; rows that repeat id and text of an item are one item, other texts
under the same id are ranked apart; each row of a repeated document counts and is
ranked on its own; NULL document ids come last among equal scores; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, kept_table, scratch
from .textops import Lexicon, lowered, ragged, slices, utf8, word_runs

K = 10
SHARD_POSTINGS = 1_000_000
BLOCK_BYTES = 4_000_000
FIRST_STEP = 64

# A word, for Java's regular expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, text_key, terms array<struct<term, n>>, bytes``: the terms of each distinct item, in order."""
    plain = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    words = plain.select(
        "item", F.sha2("text", 256).alias("text_key"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), 0)).alias("term"),
    )
    counted = words.groupBy("item", "text_key", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("item", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("term", "n"))).alias("terms"), F.sum(F.octet_length("term") + 16).alias("bytes")
    )


def _postings(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``doc, n, terms array<int>, tfs array<int>`` of documents with a term; ``terms`` are numbers of ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    out = T.StructType([
        T.StructField("doc", docs.schema["doc"].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                body = lowered(raw[offs[i] : offs[j]])
                starts, lengths, first = word_runs(body, offs[i : j + 1] - offs[i])
                ids = lexicon.ids(body, starts, lengths)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                known = ids >= 0
                key, tf = np.unique(doc[known] * len(lexicon) + ids[known], return_counts=True)
                full = np.flatnonzero(np.diff(first))
                at = pa.array(np.append(np.searchsorted(key, full * len(lexicon)), len(key)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(i, j - i).take(pa.array(full)), pa.array(np.diff(first)[full]),
                        pa.ListArray.from_arrays(at, pa.array((key % max(len(lexicon), 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32))),
                    ],
                    out.names,
                )

    return docs.mapInArrow(run, out)


def _document_counts(postings: DataFrame, terms: int) -> DataFrame:
    """``term, df``, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    return postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Shard:
    """Impact lists of some documents: per term the postings by falling impact, per document its postings with their positions."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((doc, -impact, terms))
        self.first, self.terms, self.impact = first, terms, impact
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.list_at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.times = np.zeros(n_terms, np.int64)
        self.seen = np.zeros(len(order), bool)
        self.met = np.zeros(len(first) - 1, bool)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``k`` best for an item, and how many documents were completed."""
        begin, end = self.list_at[terms], self.list_at[terms + 1]
        some = end > begin
        terms, times, begin, end = terms[some], times[some], begin[some], end[some]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores, 0
        self.times[terms] = times
        best, read, step, marked, completed = begin.copy(), begin.copy(), FIRST_STEP, [], 0
        while True:
            upto = np.minimum(read + step, end)
            new = np.unique(self.list_doc[ragged(read, upto - read)])
            new = new[~self.met[new]]
            read, step = upto, 2 * step
            if len(new):
                self.met[new] = True
                completed += len(new)
                sizes = self.first[new + 1] - self.first[new]
                at = ragged(self.first[new], sizes)
                share = self.times[self.terms[at]]
                score = np.add.reduceat(share * self.impact[at], np.cumsum(sizes) - sizes)
                hit = self.position[at[share > 0]]
                self.seen[hit] = True
                marked.append(hit)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
                if len(docs) > k:
                    top = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[top], scores[top]
                else:
                    top = np.lexsort((docs, -scores))
                    docs, scores = docs[top], scores[top]
            for i in range(len(terms)):
                at, stop = best[i], end[i]
                width = 64
                while at < stop:
                    stretch = self.seen[at : min(at + width, stop)]
                    gap = int(stretch.argmin())
                    if not stretch[gap]:
                        at += gap
                        break
                    at, width = at + len(stretch), 4 * width
                best[i] = at
            # impacts at the best positions; a list that was seen whole has no unseen document
            last = np.where(best < end, self.list_impact[np.maximum(best - 1, begin)], 0)
            bound = int((times * last).sum())
            if bound == 0 or len(docs) == k and bound < scores[-1]:
                break
        self.times[terms] = 0
        for hit in marked:
            self.met[self.list_doc[hit]] = False
            self.seen[hit] = False
        return docs, scores, completed


def _ranked(postings: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``number, doc, score``: the ``k`` best documents of each shard for each item."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weight))
    out = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("doc", postings.schema["doc"].dataType), T.StructField("score", T.LongType())])

    def search(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        table = pa.Table.from_batches(parts).combine_chunks()
        table = table.take(pc.sort_indices(table.column("doc"), null_placement="at_end"))
        sizes = pc.list_value_length(table.column("terms")).to_numpy()
        terms, tf = (pc.list_flatten(table.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        m = 25 + 75 * table.column("n").to_numpy() * n_docs // n_words
        doc = np.repeat(np.arange(len(sizes)), sizes)
        impact = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        worth = impact > 0
        first = np.concatenate([[0], np.cumsum(np.bincount(doc[worth], minlength=len(sizes)))])
        shard = Shard(first, terms[worth], impact[worth], len(weight))
        number, found, scores = [], [], []
        for i, (wanted, times) in enumerate(items):
            docs, score, _ = shard.best(wanted, times, k)
            number.append(np.full(len(docs), i, np.int32))
            found.append(docs)
            scores.append(score)
        ids = table.column("doc").combine_chunks()
        ids = ids.take(pa.array(np.concatenate(found)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(number)), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(np.concatenate(scores))], out.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            held = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            if held.num_rows:
                parts.append(held)
                size += len(held.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield from search(parts)
                parts, size = [], 0
        if parts:
            yield from search(parts)

    return postings.mapInArrow(run, out)


def search(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = K, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs`` for each of ``items``."""
    spark = configure(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    kind = items.schema[item_id].dataType
    results = None
    with scratch(spark) as store:
        wanted = store(item_terms(items, item_id, item_text))
        blocks = _blocks(wanted, block_bytes)
        for b in range(blocks):
            block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item", "text_key"), F.lit(blocks)) == b)
            held = block.orderBy("item", "text_key").collect()
            words = sorted({t.term for r in held for t in r.terms})
            if not words:
                continue
            number = {w: i for i, w in enumerate(words)}
            postings = store(_postings(rows, [w.encode() for w in words]))
            n_docs, n_words = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not n_docs:
                continue
            weight = np.zeros(len(words), np.int64)
            for term, w in _document_counts(postings, len(words)).select(
                "term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
            ).collect():
                weight[term] = w
            asked = [(np.array([number[t.term] for t in r.terms]), np.array([t.n for t in r.terms])) for r in held]
            found = _ranked(postings, asked, weight, n_docs, n_words, k)
            best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            names = spark.createDataFrame(
                [(i, r.item) for i, r in enumerate(held)], T.StructType([T.StructField("item_number", T.IntegerType()), T.StructField("item_id", kind)])
            )
            # a block's names are bounded with it
            named = ranked.join(F.broadcast(names), F.col("number") == F.col("item_number")).select(
                "item_id", "rank", F.col("doc").alias("doc_id"), "score"
            )
            named = kept_table(named)
            results = named if results is None else results.unionByName(named)
    if results is None:
        schema = T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType()),
        ])
        return spark.createDataFrame([], schema)
    return results


def _blocks(wanted: DataFrame, block_bytes: int) -> int:
    """So many blocks, by hash, that none has more than ``block_bytes`` unless it is one item."""
    total, rows = wanted.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total // block_bytes))
    while 1 < blocks < rows:
        parts = wanted.groupBy(F.pmod(F.xxhash64("item", "text_key"), F.lit(blocks)).alias("b")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"))
        if not parts.where((F.col("s") > block_bytes) & (F.col("n") > 1)).take(1):
            break
        blocks *= 2
    return blocks
