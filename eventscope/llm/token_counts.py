"""Edit-aware token counts: a segment tree over each document's pre-tokens.

`build` splits a document into pre-tokens, encodes the distinct ones, and keeps
for every ``LEAF`` consecutive pre-tokens one leaf with its characters and tokens.
The tree is two integer arrays in heap layout (node ``i`` has children ``2i`` and
``2i + 1``, node 1 the document's totals).

`apply_edits` applies edits ``(pos, del, ins)`` one after another, positions in code
points of the text as it then is. Per edit it descends to the leaf that holds the
position less the context's characters (pre-tokens that end before that cannot have
changed: the context is longer than any lookahead of the split and any added token of the vocabulary), re-encodes from that leaf's start to the end of the leaf behind the
edit, and goes on leaf by leaf until the new split meets an old leaf boundary;
behind such a boundary the old split stays valid, since a pre-token depends only
on the text from its start on. New leaf sums are then added up the tree. Regions
of all documents of a batch are encoded together.

Defined results: a NULL or empty text has a tree of zeros; edits are clamped to
the text, NULL positions and lengths count as 0, NULL insertions as ''; NULL
edits and NULL edit lists do nothing; repeated rows are counted each; extra
columns stay (``tree`` and ``reencoded_chars`` replace inputs of that name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Vocabulary, vocabulary
from .common import configure
from .textops import slices, utf8

LEAF = 16
LOOKAHEAD = 16  # characters; more than any lookahead of the split
TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDITS = "array<struct<pos:int,del:int,ins:string>>"


def total(tree: str | Column) -> Column:
    """Tokens of the whole document."""
    tree = F.col(tree) if isinstance(tree, str) else tree
    return F.get(tree["tokens"], F.lit(1)).cast("long")


def context(voc: Vocabulary) -> int:
    """Characters around an edit that can change how it is split: an added token may be longer than any lookahead."""
    return max([LOOKAHEAD, *(len(t.decode("utf-8", "replace")) + 1 for t in voc.special)])


def _heap(leaves: np.ndarray) -> np.ndarray:
    size = 1 << max(0, int(len(leaves) - 1).bit_length()) if len(leaves) else 1
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    while size > 1:
        half = size // 2
        tree[half:size] = tree[size : 2 * size].reshape(half, 2).sum(1)
        size = half
    return tree


def _measure(voc: Vocabulary, raw: np.ndarray, offsets: np.ndarray):
    """Characters and tokens of each pre-token, and each text's first pre-token (n + 1)."""
    starts, _, first, per, _ = voc.counts(raw, offsets, want_ids=False)
    chars = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return chars, per, first


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))


def _trees(chars: list[np.ndarray], tokens: list[np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([_lists(chars), _lists(tokens)], ["chars", "tokens"])


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def build(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``docs`` plus ``tree struct<chars, tokens>``."""
    configure(docs.sparkSession)
    rows = docs.select(_row(docs), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                chars, per, first = _measure(voc, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                sums = []
                for values in (chars, per):
                    run_sum = np.concatenate([[0], np.cumsum(values)])
                    sums.append([
                        _heap(np.diff(run_sum[np.append(np.arange(a, b, LEAF), b)])) if b > a else _heap(values[:0])
                        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)
                    ])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), _trees(*sums)], ["row", "tree"])

    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("tree", TREE)])
    return rows.mapInArrow(run, out).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "tree"], "tree")


class _Document:
    """One document under edit."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], context: int):
        self.text, self.chars, self.tokens, self.context = text, chars, tokens, context
        self.reencoded = 0

    def leaf_at(self, x: int) -> tuple[int, int]:
        """The leaf node that holds character ``x`` (the last one that has any, past the end) and its start."""
        node, start, size = 1, 0, len(self.chars) // 2
        x = min(x, self.chars[1] - 1)
        while node < size:
            node *= 2
            if x >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node, start

    def open(self, pos: int, cut: int, ins: str) -> None:
        n = len(self.text)
        pos = min(max(pos, 0), n)
        cut = min(max(cut, 0), n - pos)
        self.text = self.text[:pos] + ins + self.text[pos + cut :]
        self.delta = len(ins) - cut
        self.first, self.start = self.leaf_at(max(pos - self.context, 0))
        self.last, start = self.leaf_at(pos + cut)
        self.end = start + self.chars[self.last]

    def region(self) -> str:
        """What to re-encode: up to the old leaf boundary tried now, and the characters that can decide it."""
        return self.text[self.start : self.end + self.delta + self.context]

    def close(self, chars: np.ndarray, tokens: np.ndarray) -> bool:
        """Take the region's pre-tokens if its split meets the old boundary; else ask for one more leaf."""
        ends = np.cumsum(chars)
        want = self.end + self.delta - self.start
        n = int(np.searchsorted(ends, want, "right"))
        if want and (not n or ends[n - 1] != want):
            size = len(self.chars) // 2
            nxt = self.last + 1
            while nxt < 2 * size and not self.chars[nxt]:
                nxt += 1
            if nxt < 2 * size:
                self.last, self.end = nxt, self.end + self.chars[nxt]
                return False
            raise AssertionError("the end of the text is always a boundary")
        self.reencoded += want
        slots = self.last - self.first + 1
        if n > 4 * LEAF * slots:
            self._rebuild(chars[:n], tokens[:n])
            return True
        bounds = np.linspace(0, n, slots + 1).astype(np.int64)
        for tree, values in ((self.chars, chars), (self.tokens, tokens)):
            sums = np.concatenate([[0], np.cumsum(values[:n])])
            tree[self.first : self.last + 1] = np.diff(sums[bounds]).tolist()
            lo, hi = self.first // 2, self.last // 2
            while lo:
                for node in range(lo, hi + 1):
                    tree[node] = tree[2 * node] + tree[2 * node + 1]
                lo, hi = lo // 2, hi // 2
        return True

    def _rebuild(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """A long insertion: new leaves are cut, the tree is laid out anew; nothing else is encoded."""
        size = len(self.chars) // 2
        at = np.append(np.arange(0, len(chars), LEAF), len(chars))
        for name, values in (("chars", chars), ("tokens", tokens)):
            old = getattr(self, name)
            fresh = np.diff(np.concatenate([[0], np.cumsum(values)])[at])
            setattr(self, name, _heap(np.concatenate([old[size : self.first], fresh, old[self.last + 1 :]]).astype(np.int64)).tolist())


def _apply(voc: Vocabulary, docs: list[_Document], edits: list[list[dict]]) -> None:
    for turn in range(max(map(len, edits), default=0)):
        pending = []
        for doc, todo in zip(docs, edits, strict=True):
            if turn < len(todo) and todo[turn] is not None:
                e = todo[turn]
                doc.open(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                pending.append(doc)
        while pending:
            bodies = [d.region().encode() for d in pending]
            offs = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
            chars, per, first = _measure(voc, np.frombuffer(b"".join(bodies), np.uint8), offs)
            pending = [
                d for d, a, b in zip(pending, first.tolist(), first[1:].tolist(), strict=False) if not d.close(chars[a:b], per[a:b])
            ]


def apply_edits(trees: DataFrame, path: str, *, text: str = "text", edits: str = "edits") -> DataFrame:
    """``trees`` with ``text`` and ``tree`` after the edits of column ``edits`` (`EDITS`), plus ``reencoded_chars``."""
    configure(trees.sparkSession)
    rows = trees.select(
        _row(trees), F.coalesce(F.col(text), F.lit("")).alias("body"), "tree", F.col(edits).cast(EDITS).alias("todo")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        reach = context(voc)
        for batch in batches:
            _, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                part = batch.slice(i, j - i)
                docs = [
                    _Document(body, tree["chars"], tree["tokens"], reach)
                    for body, tree in zip(part.column("body").to_pylist(), part.column("tree").to_pylist(), strict=True)
                ]
                _apply(voc, docs, [x or [] for x in part.column("todo").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array([d.text for d in docs], pa.string()),
                        _trees([np.array(d.chars) for d in docs], [np.array(d.tokens) for d in docs]),
                        pa.array([d.reencoded for d in docs], pa.int64()),
                    ],
                    ["row", "body", "tree", "reencoded_chars"],
                )

    out = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("body", T.StringType()),
        T.StructField("tree", TREE), T.StructField("reencoded_chars", T.LongType()),
    ])
    kept = [F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in trees.columns if c not in ("tree", "reencoded_chars")]
    return rows.mapInArrow(run, out).select(*kept, "tree", "reencoded_chars")


def update(trees: DataFrame, edits: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply an edit log ``(key, seq, pos, del, ins)`` to stored trees; documents without edits stay as they are.

    One document's edits depend on each other, so they meet in its row.
    """
    todo = edits.groupBy(F.col(key).alias("edit_key")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "pos", "del", "ins"))),
            lambda e: F.struct(e["pos"].cast("int").alias("pos"), e["del"].cast("int").alias("del"), e["ins"].alias("ins")),
        ).alias("edits")
    )
    base = trees.drop("edits")
    joined = base.join(todo, base[key].eqNullSafe(todo["edit_key"]), "left").drop("edit_key")
    return apply_edits(joined, path, text=text).drop("edits")
