"""Vectorised text primitives used inside Arrow tasks (numpy over UTF-8 buffers, no per-row Python)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once in a Python worker.
SLICE_BYTES = 2_000_000

# Start values of the two hashes, and the multipliers behind each block.
_rng = np.random.Generator(np.random.PCG64(20240601))
_START = _rng.integers(1, 2**63, 2, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)
_MASK = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
# Runs beyond so many bytes are hashed in pieces, and then the pieces' hashes.
PIECE = 512


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and ``n + 1`` offsets into it (NULL counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row is a range of its own)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number (zeros behind the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def _folded(h: np.ndarray) -> np.ndarray:
    h *= _TIMES[0]
    h ^= h >> np.uint64(32)
    h *= _TIMES[1]
    h ^= h >> np.uint64(29)
    return h


def run_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of bytes ``raw[starts : starts + lengths]`` (none empty), by ``seed`` 0 or 1.

    Blocks of eight bytes are taken in one after another, each followed by
    multiplications and shifts, so that no sum of terms stands for a run. The hash
    tells runs apart, it does not prove them equal: ``same_runs`` does.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    window, lengths = _words(raw), lengths.astype(np.int64)
    h = np.full(len(starts), _START[seed], np.uint64)
    short = lengths <= PIECE
    live = np.flatnonzero(short)
    for at in range(0, int(lengths[live].max(initial=0)), 8):
        if at:
            live = live[lengths[live] > at]
        left = np.minimum(lengths[live] - at, 8)
        h[live] = _folded(h[live] ^ (window[starts[live] + at] & _MASK[left]))
    if len(rest := np.flatnonzero(~short)):
        count = -(-lengths[rest] // PIECE)
        first = np.cumsum(count) - count
        within = (np.arange(int(count.sum())) - np.repeat(first, count)) * PIECE
        size = np.minimum(np.repeat(lengths[rest], count) - within, PIECE)
        pieces = run_hashes(raw, np.repeat(starts[rest], count) + within, size, seed)
        h[rest] = run_hashes(pieces.view(np.uint8), 8 * first, 8 * count, seed)
    return _folded(h ^ (lengths.astype(np.uint64) * _TIMES[2]))


def same_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of each run equal those of the run that starts at ``other``."""
    same = lengths == other_lengths
    window = _words(raw)
    live = np.flatnonzero(same & (starts != other))
    for k in live[lengths[live] > PIECE]:
        same[k] = np.array_equal(raw[starts[k] : starts[k] + lengths[k]], raw[other[k] : other[k] + lengths[k]])
    live = live[lengths[live] <= PIECE]
    for at in range(0, int(lengths[live].max(initial=0)), 8):
        live = live[lengths[live] > at]
        differ = (window[starts[live] + at] ^ window[other[live] + at]) & _MASK[np.minimum(lengths[live] - at, 8)] != 0
        same[live[differ]] = False
        live = live[~differ]
    return same


def classes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal runs as classes: the index of a run of each class, and the class of every run.

    Runs meet by their hash; their bytes decide, so runs that only share a hash are told apart.
    """
    _, first, of = np.unique(run_hashes(raw, starts, lengths), return_index=True, return_inverse=True)
    while True:
        at = first[of]
        apart = np.flatnonzero(~same_runs(raw, starts, lengths, starts[at], lengths[at]))
        if not len(apart):
            return first, of
        # runs unlike the one that speaks for their hash: the same anew, under the other hash and within the old class
        _, more, inner = np.unique(np.stack([of[apart].astype(np.uint64), run_hashes(raw, starts[apart], lengths[apart], seed=1)]), axis=1, return_index=True, return_inverse=True)
        inner = inner.ravel()
        alone = ~same_runs(raw, starts[apart], lengths[apart], starts[apart[more[inner]]], lengths[apart[more[inner]]])
        if alone.any():
            names: dict[bytes, int] = {}
            inner = np.array([names.setdefault(raw[starts[k] : starts[k] + lengths[k]].tobytes(), len(names)) for k in apart])
            more = np.unique(inner, return_index=True)[1]
        of = of.copy()
        of[apart] = len(first) + inner
        first = np.concatenate([first, apart[more]])


class Lexicon:
    """Distinct words with numbers from 0 on; words of texts are looked up by hash and compared by their bytes."""

    def __init__(self, words: list[bytes]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        # words that share a hash stand next to each other; a look-up tries as many neighbours as the longest such run has
        hashes = run_hashes(raw, starts, lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.raw, self.starts, self.lengths = raw, starts, lengths
        self.tries = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def __len__(self) -> int:
        return len(self.order)

    def ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each run of bytes, -1 for words that are not in the lexicon."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return found
        hashes = run_hashes(raw, starts, lengths)
        at = np.searchsorted(self.hashes, hashes)
        both = np.concatenate([raw, self.raw])
        for k in range(self.tries):
            spot = np.minimum(at + k, len(self) - 1)
            maybe = np.flatnonzero((found < 0) & (self.hashes[spot] == hashes))
            word = self.order[spot[maybe]]
            same = same_runs(both, starts[maybe], lengths[maybe], len(raw) + self.starts[word], self.lengths[word])
            found[maybe[same]] = word[same]
        return found


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def line_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines (cut at each newline) of texts: byte starts, byte lengths, and each text's first line (n + 1)."""
    newline = np.flatnonzero(raw == 10)
    # a text of k newlines has k + 1 lines
    counts = np.diff(np.searchsorted(newline, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts = np.empty(int(first[-1]), np.int64)
    head = np.zeros(len(starts), bool)
    head[first[:-1]] = True
    starts[head] = offsets[:-1]
    starts[~head] = newline + 1
    ends = np.empty(len(starts), np.int64)
    tail = np.zeros(len(starts), bool)
    tail[first[1:] - 1] = True
    ends[tail] = offsets[1:]
    ends[~tail] = newline
    return starts, ends - starts, first


_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_IS_DARK = np.ones(256, bool)
_IS_DARK[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lowered, other bytes as they are."""
    return _LOWER[raw]


def word_runs(raw: np.ndarray, offsets: np.ndarray, *, dark: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lowered texts: byte starts, byte lengths, and word index of each text's first word (n + 1).

    Words are runs of digits, a-z and non-ASCII; with ``dark``, of anything but ASCII white space.
    """
    inside = (_IS_DARK if dark else _IS_WORD)[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


# Unicode White_Space.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = SPACE
    return table


def pre_tokens(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of ``points`` (code points); ``breaks`` are starts of independent texts.

    The split rule of byte-level BPE vocabularies: English contractions, runs of
    letters, of digits, of other signs, each with at most one blank before it, and
    runs of white space that leave their last character to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[breaks[breaks < n]] = True
    fresh[0] = fresh[n] = True
    run = fresh.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 0x20) & ~fresh[1:n]
    start = run[:n] & (space | ~after_blank)
    # the last white space of a longer run belongs to what follows it
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    start |= tail
    # contractions: a lone apostrophe that starts a pre-token, then s t m d, re ve ll
    quote = np.flatnonzero((points == 0x27) & run[:n] & ~after_blank)
    quote = quote[(quote + 1 < n)]
    quote = quote[run[quote + 1] & ~fresh[quote + 1] & (cls[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~fresh[far], points[far], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(single, 1, np.where(double, 2, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        rest = hit + 1 + size
        ok = rest < n
        start[rest[ok]] |= ~fresh[rest[ok]] & (cls[rest[ok]] == LETTER)
    return np.flatnonzero(start)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, each text's offset in them, and the byte offset of every code point (n + 1)."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    byte_at = np.append(lead, len(raw))
    return points, np.searchsorted(byte_at, offsets), byte_at
