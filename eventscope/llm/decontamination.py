"""Benchmark decontamination with one FM-index per training shard.

Words are runs of digits, letters a-z (A-Z lowered first) and non-ASCII
characters. A window is ``WINDOW`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit; runs of hit words are the removal spans.

A task indexes its documents shard by shard (at most ``SHARD_WORDS`` words, or one
document): words become ids of the benchmark's vocabulary, words outside it the
id 0. No phrase spans a 0, so runs too short to hold any window are left out of
the index; that loses nothing. Over the remaining ids the shard builds a suffix
array (prefix doubling), the Burrows-Wheeler transform
and a wavelet matrix over it. All windows are searched backwards at once with
wavelet ranks; suffix positions are sampled (every ``SAMPLE``-th), and occurrences are
located by walking to the next sample. Marks of all occurrences are merged per
document into spans.

Documents never move: the only exchange-free plan is scan, index, result. The
benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` of text, each searched
against all rows. Before blocks are formed, equal items are made one and long ones are cut by the
tasks into pieces of ``PIECE_WORDS`` words that overlap by a window less one word, so
no item outgrows a block; the blocks' sizes are checked before one is read
on the driver (a single word longer than a block is a block of its own). With several blocks
the first one's search gives all rows; of the others only the texts they hit come back, as
marks that are joined by a digest of the text, so no text is written again.

Defined results: NULL and empty texts have no words and no hits; NULL or empty
items have no window; a NULL ``item_id`` reads ''; repeated rows are judged each;
items that repeat an id are one item; an empty benchmark hits nothing; extra
columns are ignored (`find`) or kept (`remove_spans`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, staged
from .textops import Lexicon, classes, lowered, ragged, slices, utf8, word_runs

WINDOW = 10
SHARD_WORDS = 1_000_000
SAMPLE = 16
BLOCK_BYTES = 4_000_000
PIECE_WORDS = 20_000


class WaveletMatrix:
    """Ranks over an integer sequence, vectorised over queries."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``upto`` entries."""
        begin, end = np.zeros_like(upto), upto
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> b) & 1).astype(bool)
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - begin


class FmIndex:
    """Backward search and location in a sequence of ids >= 0 (0 separates)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = seq + 1
        seq[-1] = 0  # a unique end mark, smaller than separators and words
        n = len(seq)
        order = self._suffixes(seq)
        self.bwt = seq[order - 1]
        counts = np.bincount(seq, minlength=sigma + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.tree = WaveletMatrix(self.bwt, sigma + 2)
        sampled = order % SAMPLE == 0
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n = n

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling, until all suffixes are told apart."""
        n, k, rank = len(seq), 1, seq
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - k] = rank[k:] + 1
            key = rank * (int(follow.max()) + 1) + follow
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            if int(rank.max()) == n - 1:
                return order
            k *= 2

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges ``[lo, hi)`` of the suffixes that begin with each pattern (rows of one length)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j] + 1
            lo[alive] = self.before[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return (self.samples[self.sample_rank[at]] + steps) % self.n


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [lowered(np.frombuffer((t or "").encode(), np.uint8)) for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        body = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        starts, lengths, first = word_runs(body, offs)
        some, of = classes(body, starts, lengths)
        self.vocabulary = Lexicon([body[starts[k] : starts[k] + lengths[k]].tobytes() for k in some])
        ids = of + 1
        self.names = np.array(sorted({i for i, _ in items}), object)
        number = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for k, (name, _) in enumerate(items):
            words = ids[first[k] : first[k + 1]].tolist()
            size = min(window, len(words))
            for j in range(len(words) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(tuple(words[j : j + size]), set()).add(number[name])
        self.groups = []
        for size, found in sorted(by_length.items()):
            owners = [sorted(x) for x in found.values()]
            n = np.fromiter(map(len, owners), np.int64, len(owners))
            flat = np.fromiter((i for x in owners for i in x), np.int64, int(n.sum()))
            self.groups.append((size, np.array(list(found), np.int64), np.cumsum(n) - n, n, flat))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word, from 1 on; 0 for words that no item has."""
        return self.vocabulary.ids(raw, starts, lengths) + 1

    def hits(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Which words of a shard are hit, and the sorted item names per document."""
        docs = len(first) - 1
        marked, names = np.zeros(len(ids), bool), [[] for _ in range(docs)]
        if not self.groups or not len(ids):
            return marked, names
        # runs of vocabulary words inside one document, long enough for a window
        known = ids > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        heads = first[:-1][first[:-1] < len(ids)]
        begin[heads] = known[heads]
        starts = np.flatnonzero(begin)
        stop = np.ones(len(ids) + 1, bool)
        stop[:-1] = ~known | begin
        stops = np.flatnonzero(stop)
        lengths = stops[np.searchsorted(stops, starts, "right")] - starts
        enough = lengths >= self.shortest
        starts, lengths = starts[enough], lengths[enough]
        if not len(starts):
            return marked, names
        seq = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
        offset = np.cumsum(lengths + 1) - (lengths + 1)
        seq[ragged(offset, lengths)] = ids[ragged(starts, lengths)]
        place = np.zeros(len(seq), np.int64)  # position in the shard of each indexed word
        place[ragged(offset, lengths)] = ragged(starts, lengths)
        index = FmIndex(seq, len(self.vocabulary))
        found_doc, found_item = [], []
        edge = np.zeros(len(ids) + 1, np.int64)
        for size, patterns, owner_at, owner_n, owner in self.groups:
            lo, hi = index.search(patterns)
            which = np.flatnonzero(hi > lo)
            if not len(which):
                continue
            count = (hi - lo)[which]
            at = place[index.locate(ragged(lo[which], count))]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            doc = np.searchsorted(first, at, "right") - 1
            pair = np.unique(doc * len(patterns) + np.repeat(which, count))
            doc, window = pair // len(patterns), pair % len(patterns)
            found_doc.append(np.repeat(doc, owner_n[window]))
            found_item.append(owner[ragged(owner_at[window], owner_n[window])])
        marked = np.cumsum(edge[:-1]) > 0
        if found_doc:
            pair = np.unique(np.concatenate(found_doc) * len(self.names) + np.concatenate(found_item))
            for d, i in zip((pair // len(self.names)).tolist(), (pair % len(self.names)).tolist(), strict=True):
                names[d].append(self.names[i])
        return marked, names


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word", "words", "start", "end")]))
_FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS),
]


class _Part:
    """Some documents of a shard: their rows, word ids, and where each word stands in its text."""

    def __init__(self, batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, phrases: Phrases):
        self.batch = batch
        body = lowered(raw)
        starts, lengths, self.first = word_runs(body, offsets)
        self.ids = phrases.ids(body, starts, lengths).astype(np.int32)
        # spans are told in code points of their own document
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        base = np.repeat(points[offsets[:-1]], np.diff(self.first))
        self.starts, self.ends = points[starts] - base, points[starts + lengths] - base

    def result(self, hit: np.ndarray, names: list[list[str]]) -> pa.RecordBatch:
        first = self.first
        head = np.zeros(len(hit) + 1, bool)  # spans end with their document
        head[first] = True
        a = np.flatnonzero(hit & (head[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else np.zeros(0, np.int64)
        z = np.flatnonzero(hit & (head[1:] | ~np.concatenate([hit[1:], [False]]))) if len(hit) else a
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(a, first).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (a - first[np.searchsorted(first, a, "right") - 1], z - a + 1, self.starts[a], self.ends[z])],
                ["word", "words", "start", "end"],
            ),
        )
        total = np.concatenate([[0], np.cumsum(hit)])
        columns = {
            "row": self.batch.column("row"), "n_words": pa.array(np.diff(first)), "n_hit": pa.array(np.diff(total[first])),
            "items": pa.array(names, pa.list_(pa.string())), "spans": spans,
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _search(rows: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)  # one block: bounded by its caller
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), *_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        shard: list[_Part] = []

        def flush() -> Iterator[pa.RecordBatch]:
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in shard]))])
            marked, names = phrases.hits(np.concatenate([p.ids for p in shard]), first)
            doc = word = 0
            for p in shard:
                n = len(p.first) - 1
                yield p.result(marked[word : word + len(p.ids)], names[doc : doc + n])
                doc, word = doc + n, word + len(p.ids)
            shard.clear()

        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                shard.append(_Part(batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], phrases))
                if sum(len(p.ids) for p in shard) >= SHARD_WORDS:
                    yield from flush()
        if shard:
            yield from flush()

    return rows.mapInArrow(run, out)


def _pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """``id, text``: items of at most ``piece_words`` words as they are, longer ones in pieces; each window is whole in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            ids, texts = [], []
            for k, name in enumerate(batch.column("id").to_pylist()):
                body = raw[offs[k] : offs[k + 1]]
                starts, lengths, _ = word_runs(lowered(body), np.array([0, len(body)]))
                for begin in range(0, max(1, len(starts) - window + 1), max(1, piece_words - window + 1)):
                    stop = min(begin + piece_words, len(starts))
                    ids.append(name)
                    texts.append(body[starts[begin] : starts[stop - 1] + lengths[stop - 1]].tobytes().decode() if stop > begin else "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "text"])

    return items.mapInArrow(run, "id string, text string")


def _blocks(pieces: DataFrame, block_bytes: int) -> int:
    """So many blocks, by hash, that none is larger than ``block_bytes`` unless it is one piece."""
    total, rows = pieces.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total // block_bytes))
    while 1 < blocks < rows:
        parts = pieces.groupBy(_block(blocks).alias("b")).agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"))
        if not parts.where((F.col("s") > block_bytes) & (F.col("n") > 1)).take(1):
            break
        blocks *= 2
    return blocks


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id", "text"), F.lit(blocks))


def merged_spans(spans: Column) -> Column:
    """Spans in any order, some of them overlapping or adjacent, as disjoint ones in order."""
    empty = F.array().cast(_SPANS)

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        stop = F.greatest(last["word"] + last["words"], s["word"] + s["words"])
        longer = F.struct(
            last["word"].alias("word"), (stop - last["word"]).alias("words"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")
        )
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (s["word"] <= last["word"] + last["words"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def find(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """Columns ``keep`` (default all) of ``docs`` plus ``n_words, n_hit, items array<string>, spans``.

    ``spans`` are ``struct<word, words, start, end>``: first hit word, number of words, code points ``[start, end)``.
    """
    configure(docs.sparkSession)
    own = [f.name for f in _FOUND]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    ).distinct()
    pieces = _pieces(items, window, max(piece_words, window)).distinct().withColumn("weight", F.octet_length("text") + F.octet_length("id") + 64)
    pieces = staged(pieces)
    blocks = _blocks(pieces, block_bytes)
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    block = lambda b: [(r.id, r.text) for r in (pieces if blocks == 1 else pieces.where(_block(blocks) == b)).collect()]
    if blocks == 1:
        found = _search(docs.select(row.alias("row"), body.alias("body")), block(0), window)
        return found.select(*[F.col("row")[c].alias(c) for c in keep], *own)
    # a digest of the text stands for it where the marks of the blocks meet
    digest = F.sha2(body, 256)
    found = _search(docs.select(F.struct(row.alias("row"), digest.alias("digest")).alias("row"), body.alias("body")), block(0), window)
    texts = docs.select(digest.alias("row"), body.alias("body"))
    marks = None
    for b in range(1, blocks):
        hit = staged(_search(texts, block(b), window).where("n_hit > 0").select("row", "items", "spans").dropDuplicates(["row"]))
        marks = hit if marks is None else marks.unionByName(hit)
    marks = marks.groupBy(F.col("row").alias("k")).agg(F.flatten(F.collect_list("items")).alias("more"), F.flatten(F.collect_list("spans")).alias("also"))
    both = found.join(marks, F.col("row.digest") == F.col("k"), "left")
    spans = F.when(F.col("also").isNull(), F.col("spans")).otherwise(merged_spans(F.concat("spans", F.coalesce("also", F.array().cast(_SPANS)))))
    named = F.when(F.col("more").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more", F.array().cast("array<string>"))))))
    merged = both.select("row", "n_words", named.alias("items"), spans.alias("spans")).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    )
    return merged.select(*[F.col("row.row")[c].alias(c) for c in keep], *own)


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without its ``spans`` (code points, ascending, disjoint)."""
    n = F.size(spans)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(spans, i)["start"], F.length(text).cast("long")) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
        ),
    )
    return F.when(n > 0, F.array_join(pieces, "")).otherwise(text)
