"""Ranked lexical search and hard-negative mining against brute force, with edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import hard_negatives, lexical_search

from . import brute

ITEMS = "item_id long, text string"


def ranks(found):
    """Item -> (doc, score) in order of rank, ranks being 1, 2, ..."""
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r["rank"])):
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    for rows in out.values():
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
    return {i: [(d, s) for _, d, s in rows] for i, rows in out.items()}


def words(rng, n, size):
    return " ".join(f"w{min(int(x), size)}" for x in rng.zipf(1.3, n))


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_search_equals_brute_force(spark, docs, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(i, words(rng, int(rng.integers(1, 60)), 200)) for i in range(300)]
    rows += [(i + 300, rows[7][1]) for i in range(40)]  # equal scores: the smallest ids win
    items = [(i, words(rng, int(rng.integers(1, 25)), 260)) for i in range(20)] + [(20, rows[7][1]), (21, "nowhere found")]
    got = ranks(lexical_search.search(docs(rows), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes))
    expected = {i: x for (i, _), x in brute.lexical_ranks(rows, items).items() if x}
    assert got == expected
    assert [d for d, _ in got[20]] == [7, *range(300, 309)]


def test_search_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "Été ABC abc"), (4, "... !!"), (None, "abc"), (5, "abc"), (5, "abc"), (6, "x " * 200_000 + "abc"), (7, "été_x"), (8, "q " * 3)]
    items = [(1, "ABC abc"), (1, "ABC abc"), (2, None), (3, ""), (4, "été"), (None, "q"), (5, "?"), (6, "abc abc x"), (7, "x" * 100_000)]
    got = ranks(lexical_search.search(docs(rows), spark.createDataFrame(items, ITEMS)))
    brute_rows = [(10**9 if d is None else d, t) for d, t in rows]
    expected = {i: [(None if d == 10**9 else d, s) for d, s in x] for (i, _), x in brute.lexical_ranks(brute_rows, items).items() if x}
    assert got == expected
    assert set(got) == {1, 4, 6, None} and len(got[1]) == 5
    none = spark.createDataFrame([], ITEMS)
    assert lexical_search.search(docs(rows), none).count() == 0
    empty = lexical_search.search(docs([]), spark.createDataFrame(items, ITEMS))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_texts_under_one_id_are_ranked_apart(spark, docs):
    got = lexical_search.search(docs([(1, "a b"), (2, "b"), (3, "c d")]), spark.createDataFrame([(1, "a"), (1, "b")], ITEMS))
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_best_positions_stop_early_and_never_cut_ties():
    rng = np.random.default_rng(1)
    docs, terms = 5000, 12
    held = rng.random((docs, terms)) < 0.5
    held[:, 0] |= ~held.any(1)
    impact = rng.integers(1, 6, (docs, terms)) ** 6
    impact[: docs // 2] = impact[docs // 2 :]  # many equal scores
    held[: docs // 2] = held[docs // 2 :]
    row, term = np.nonzero(held)
    first = np.searchsorted(row, np.arange(docs + 1))
    shard = lexical_search.Shard(first, term, impact[held], terms)
    for wanted in ([3], [0, 5], [1, 2, 4, 7], list(range(terms))):
        times = rng.integers(1, 4, len(wanted))
        score = (impact * held)[:, wanted] @ times
        order = np.lexsort((np.arange(docs), -score))[:10]
        found, scores, completed = shard.best(np.array(wanted), times, 10)
        assert found.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
        assert not shard.seen.any() and not shard.met.any() and not shard.times.any()
        if len(wanted) < 3:
            assert completed < docs / 2


VECTORS = "vec_id long, label int, embedding array<float>"


def mined(spark, rows, every, **options):
    table = spark.createDataFrame(rows, VECTORS).withColumn("shard", F.lit("x")).withColumn("dim", F.lit("y")).repartition(3)
    table = table.withColumn("vector", hard_negatives.whole_numbers("embedding"))
    found = hard_negatives.mine(table, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def usable(rows):
    good = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: (r[0], r[1])):
        if all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    return good


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "anchor_rows": 7, "codes": 4}])
def test_hard_negatives_equal_brute_force(spark, options):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), (centers[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, i % 3, rows[10][2]) for i in range(300, 420)]  # one cell with many equal rows: ties
    good = usable(rows)
    got = mined(spark, rows, 10, **options)
    assert got == brute.hard_negatives(good, [i for i in good if i % 10 == 0])
    assert any(len({n for a, p, _, n, _, _ in got if a == x}) for x in range(0, 420, 10))


def test_hard_negatives_edges(spark):
    big = [300000.5, -200000.25]  # products beyond the whole numbers of a double
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.85, 0.5]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [1.0, None]),
        (6, 2, [1.0, float("nan")]), (7, 2, [float("inf"), 0.0]), (None, 2, [0.9, 0.5]), (8, 2, [0.9]), (9, 1, [0.8]), (20, 1, [0.9]),
        (10, 3, []), (11, 3, []), (12, 4, []), (30, 5, big), (31, 5, big), (32, 6, big), (2, 2, [0.85, 0.5]), (40, 7, [-1.0, 0.0]), (41, 7, [1.0, 0.0]),
    ]
    good = usable(rows)
    got = mined(spark, rows, 10)
    assert got == brute.hard_negatives(good, [i for i in good if i % 10 == 0])
    assert (0, 1, 1, 2, 256 * 230 + 128 * 128, 256 * 217 + 128 * 128) in got  # a near miss of the label, just below the positive
    assert (10, 11, 1, 12, 0, 0) in got and not any(a == 40 for a, *_ in got)  # a window below 0 is empty
    assert mined(spark, [], 10) == []


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(500, 9)))
    books = hard_negatives.fit(x[:, :4], 5, 4), hard_negatives.fit(x[:, 4:], 5, 4)
    codes = [hard_negatives.nearest(side, b) for side, b in zip((x[:, :4], x[:, 4:]), books, strict=True)]
    far = [np.sqrt(((side - b[c]) ** 2).sum(1)) for side, b, c in zip((x[:, :4], x[:, 4:]), books, codes, strict=True)]
    cells = hard_negatives.Cells(x, *codes, *far, books)
    for q in x[:20]:
        seen, left = [], np.inf
        for bound, rows in cells.visit(q):
            seen += rows.tolist()
            rest = np.setdiff1d(np.arange(500), seen)
            assert bound <= left and (cells.scores(rest, q) <= bound).all()
            left = bound
        assert sorted(seen) == list(range(500))
