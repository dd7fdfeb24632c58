"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

Encoding. A text is split into pre-tokens and every *distinct* pre-token of a
batch is encoded once; ids are then laid out by index arithmetic. Two things are
too long for that and go through halves:

* a pre-token of more than ``LEAF_BYTES`` (unsplit text): its halves are encoded
  on their own and joined (`Vocabulary.join`);
* a document of more than ``PIECE_BYTES``: it is cut into pieces that are encoded
  in parallel as rows of their own and joined pairwise, as a tree.

Join of two encodings ``A``, ``B``: re-encode a window of the last ``k`` tokens of ``A``
and the first ``k`` of ``B``; if its first token is still ``A``'s and its last token
still ``B``'s, both sides agree and the window replaces the tokens around the
join; else ``k`` doubles. This is exact: a token sequence is the BPE encoding of
its bytes if and only if each neighbouring pair is the encoding of its own
bytes, and all pairs outside the window are pairs of ``A`` or of ``B``. For pieces of
a document the pre-token split is first repaired around the cut: a pre-token
that ends three characters before the end of the left piece is final, and from
the first split point that the repaired text shares with the right piece on,
both splits are the same (a pre-token depends on the text from its start on,
never on what stands before).

Strings of the vocabulary's added tokens (``<|endoftext|>``) in a text become
their single id, as the vocabulary file says.

Defined results: NULL and empty texts have no ids and decode to ''; repeated
rows are encoded each; an empty table gives no rows; extra columns are kept by
`encode` under their names (its own are ``ids`` and, asked for, ``decoded``; an input
column of that name is replaced).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure
from .textops import classes, code_points, pre_tokens, ragged, slices, utf8

LEAF_BYTES = 256
PIECE_BYTES = 65_536


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins by which vocabulary files spell bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary read from its ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        spelled = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        for text in self.special:
            spelled.pop(text, None)
        # one pre-token at a time goes in, so the library's own split must not cut it
        self._merge = tiktoken.Encoding("bpe", pat_str=r"[\s\S]+", mergeable_ranks=spelled, special_tokens={})._core_bpe.encode_single_piece
        size = 1 + max([*spelled.values(), *self.special.values()])
        self.token = [b""] * size
        for text, i in [*spelled.items(), *self.special.items()]:
            self.token[i] = text
        lengths = np.fromiter(map(len, self.token), np.int64, size)
        self._raw = np.frombuffer(b"".join(self.token), np.uint8)
        self._start, self._length = np.cumsum(lengths) - lengths, lengths
        self._special_re = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or b"(?!)")

    # ---- one pre-token

    def word(self, text: bytes) -> list[int]:
        """Ids of one pre-token; a long one is encoded as halves and joined."""
        if len(text) <= LEAF_BYTES:
            return self._merge(text)
        half = len(text) // 2
        return self.join(self.word(text[:half]), self.word(text[half:]))

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of ``bytes(a) + bytes(b)``, given the encodings of both."""
        if not a or not b:
            return a + b
        k = 2
        while True:
            left, right = a[-k:], b[:k]
            window = self._merge(b"".join(self.token[i] for i in left + right))
            whole_a, whole_b = k >= len(a), k >= len(b)
            if (whole_a or window[0] == left[0]) and (whole_b or window[-1] == right[-1]):
                return a[: len(a) - len(left)] + window + b[len(right) :]
            k *= 2

    # ---- many texts

    def split(self, raw: np.ndarray, offsets: np.ndarray):
        """Pre-tokens of texts: byte starts, byte lengths, special id or -1, and first pre-token of each text (n + 1)."""
        points, at, byte_at = code_points(raw, offsets)
        marks = []
        if self.special:
            for m in self._special_re.finditer(raw.tobytes()):
                i = int(np.searchsorted(offsets, m.start(), "right")) - 1
                if m.end() <= offsets[i + 1]:
                    marks.append((m.start(), m.end(), self.special[m.group()]))
        breaks = at[:-1]
        if marks:
            cuts = np.searchsorted(byte_at, np.array([x[:2] for x in marks]).ravel())
            breaks = np.union1d(breaks, cuts)
        starts = byte_at[pre_tokens(points, breaks)]
        kind = np.full(len(starts), -1, np.int64)
        if marks:
            inside = np.zeros(len(starts), bool)
            for s, e, i in marks:
                lo, hi = np.searchsorted(starts, [s, e])
                inside[lo + 1 : hi] = True
                kind[lo] = i
            starts, kind = starts[~inside], kind[~inside]
        lengths = np.diff(np.append(starts, len(raw)))
        return starts, lengths, kind, np.searchsorted(starts, offsets)

    def counts(self, raw: np.ndarray, offsets: np.ndarray, *, want_ids: bool = True):
        """Split of the texts plus tokens per pre-token and, asked for, all ids in order."""
        starts, lengths, kind, first = self.split(raw, offsets)
        where, inverse = classes(raw, starts, lengths)
        body = raw.tobytes()
        s, e, special = starts[where].tolist(), (starts + lengths)[where].tolist(), kind[where].tolist()
        word, merge = self.word, self._merge
        encoded = [
            [k] if k >= 0 else merge(body[i:j]) if j - i <= LEAF_BYTES else word(body[i:j])
            for i, j, k in zip(s, e, special, strict=True)
        ]
        n = np.fromiter(map(len, encoded), np.int64, len(encoded))
        per = n[inverse]
        if not want_ids:
            return starts, lengths, first, per, None
        flat = np.fromiter((i for x in encoded for i in x), np.int32, int(n.sum()))
        return starts, lengths, first, per, flat[ragged((np.cumsum(n) - n)[inverse], per)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's offset in them (n + 1)."""
        _, _, first, per, ids = self.counts(raw, offsets)
        return ids, np.concatenate([[0], np.cumsum(per)])[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences and each one's offset in them (n + 1)."""
        lengths = self._length[ids]
        raw = self._raw[ragged(self._start[ids], lengths)]
        return raw, np.concatenate([[0], np.cumsum(lengths)])[offsets]

    def join_pieces(self, left: tuple, right: tuple) -> tuple:
        """Two neighbouring pieces ``(text, pre-token ends in bytes, ids per pre-token, ids)`` as one piece."""
        text_l, ends_l, per_l, ids_l = left
        text_r, ends_r, per_r, ids_r = right
        cut, text = len(text_l), text_l + text_r
        # pre-tokens that end three characters (12 bytes at most) before the cut are final, unless an added token spans it
        margin = max([12, *map(len, self.special)])
        keep = int(np.searchsorted(ends_l, cut - margin, "right")) if len(ends_l) else 0
        at = int(ends_l[keep - 1]) if keep else 0
        need = 1
        while True:
            need = min(need, len(ends_r))
            reach = cut + (int(ends_r[need - 1]) if need else 0)
            while reach < len(text) and (text[reach] & 0xC0) == 0x80:
                reach += 1
            over = reach + 4 * 4 + margin  # lookahead characters, and the rest of an added token
            while over < len(text) and (text[over] & 0xC0) == 0x80:
                over += 1
            region = np.frombuffer(text[at : min(over, len(text))], np.uint8)
            starts, lengths, kind, _ = self.split(region, np.array([0, len(region)]))
            ends = at + starts + lengths
            shared = np.isin(ends, cut + ends_r[:need]) & (ends <= reach)
            if need == len(ends_r) or shared.any():
                break
            need *= 2
        last = int(np.flatnonzero(shared)[0]) if shared.any() else len(ends) - 1
        drop = int(np.searchsorted(ends_r, ends[last] - cut, "right"))
        first_l = int(per_l[:keep].sum())
        known = {int(e): i for i, e in enumerate(ends_l)}
        ids, per = [ids_l[:first_l]], [per_l[:keep]]
        for s, e, k in zip((at + starts).tolist()[: last + 1], ends.tolist()[: last + 1], kind.tolist()[: last + 1], strict=True):
            if k >= 0:
                got = [k]
            elif s < cut < e and e - s > LEAF_BYTES and cut in known and (known[cut] == 0 and s == 0 or known[cut] and int(ends_l[known[cut] - 1]) == s) and len(ends_r) and int(ends_r[0]) + cut == e:
                # unsplit text across the cut: both halves are already encoded
                got = self.join(ids_l[len(ids_l) - int(per_l[-1]) :].tolist(), ids_r[: int(per_r[0])].tolist())
            else:
                got = self.word(text[s:e])
            ids.append(np.array(got, np.int32))
            per.append(np.array([len(got)]))
        first_r = int(per_r[:drop].sum())
        return (
            text,
            np.concatenate([ends_l[:keep], ends[: last + 1], cut + ends_r[drop:]]),
            np.concatenate([*per, per_r[drop:]]),
            np.concatenate([*ids, ids_r[first_r:]]),
        )


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once per worker process."""
    return Vocabulary(path)


def _binary_to_text(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    body = raw.tobytes()
    at = offsets.tolist()
    return pa.array([body[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)], pa.string())


def encode(docs: DataFrame, path: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` plus ``ids array<int>`` and, asked for, ``decoded string`` (made from the ids).

    ``path`` must be readable on every worker (it is a file of an installed package).
    """
    configure(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        out.add("decoded", T.StringType())

    def outputs(row: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        columns = {"row": row, "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))}
        if decoded:
            columns["decoded"] = _binary_to_text(*vocabulary(path).decode(ids, at))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                ids, at = voc.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield outputs(batch.column("row").slice(i, j - i), ids, at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, key in enumerate(batch.column("key").to_pylist()):
                body = raw[offs[i] : offs[i + 1]].tobytes()
                at, n = 0, 0
                pieces = []
                while at < len(body):
                    end = min(at + PIECE_BYTES, len(body))
                    while end < len(body) and (body[end] & 0xC0) == 0x80:
                        end += 1
                    pieces.append(body[at:end].decode())
                    at, n = end, n + 1
                    if len(pieces) == 16 or at == len(body):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(pieces), pa.string()), pa.array(range(n - len(pieces), n), pa.int32()), pa.array(pieces, pa.string())],
                            ["key", "piece", "body"],
                        )
                        pieces = []

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                starts, lengths, first, per, ids = voc.counts(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                base = np.repeat(offs[i:j] - offs[i], np.diff(first))
                at = np.concatenate([[0], np.cumsum(per)])[first]
                lists = lambda where, values: pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(values.astype(np.int32)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("piece"), part.column("body"), lists(first, starts + lengths - base), lists(first, per), lists(at, ids)],
                    ["key", "piece", "body", "ends", "per", "ids"],
                )

    def merge(table: pa.Table) -> pa.Table:
        voc = vocabulary(path)
        level = [
            (r["body"].encode(), np.array(r["ends"], np.int64), np.array(r["per"], np.int64), np.array(r["ids"], np.int32))
            for r in table.sort_by("piece").to_pylist()
        ]
        while len(level) > 1:
            level = [voc.join_pieces(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pa.table({"key": pa.array([table["key"][0].as_py()], pa.string()), "ids": pa.array([level[0][3]], pa.list_(pa.int32()))})

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                ids = np.zeros(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
                yield outputs(batch.column("row").slice(i, 1), ids, np.array([0, len(ids)]))

    long = F.octet_length("body") > PIECE_BYTES
    short_rows = rows.where(~long).mapInArrow(whole, out)
    # equal long texts share one encoding: their key is a digest of the text
    keyed = rows.where(long).withColumn("key", F.concat(F.sha2("body", 256), F.octet_length("body").cast("string")))
    pieces = (
        keyed.groupBy("key").agg(F.first("body").alias("body"))
        .mapInArrow(cut, "key string, piece int, body string")
        .repartition(F.col("key"), F.col("piece"))
        .mapInArrow(encode_pieces, "key string, piece int, body string, ends array<int>, per array<int>, ids array<int>")
    )
    joined = pieces.groupBy("key").applyInArrow(merge, "key string, ids array<int>")
    long_rows = keyed.select("row", "key").join(joined, "key").select("row", "ids")
    long_rows = long_rows.mapInArrow(decode_rows, out)
    result = short_rows.unionByName(long_rows)
    own = [c.name for c in out.fields[1:]]
    return result.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def decode(table: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """``table`` plus ``decoded string``: the text of its id lists (NULL and empty lists give '')."""
    configure(table.sparkSession)
    rows = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column("ids")
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                text = _binary_to_text(*voc.decode(lists.flatten().to_numpy(zero_copy_only=False), at))
                yield pa.RecordBatch.from_arrays([part.column("row"), text], ["row", "decoded"])

    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, out).select(*[F.col("row")[c].alias(c) for c in table.columns if c != "decoded"], "decoded")
