"""Line dedup, MinHash and vector dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from eventscope.llm import embedding_dedup, line_dedup, minhash_dedup
from eventscope.llm.common import connected_components

from . import brute


@pytest.mark.parametrize("min_words", [1, 6, 10])
def test_line_dedup(docs, min_words):
    rnd = random.Random(min_words)
    lines = [" ".join(rnd.choice("abcdef") for _ in range(rnd.choice([0, 1, 2, 3, 6]))) for _ in range(9)]
    rows = [
        (d, rnd.choice([None, ""]) if rnd.random() < 0.1 else "\n".join(rnd.choice(lines[: rnd.randint(2, 9)]) for _ in range(rnd.randint(0, 9))))
        for d in range(60)
    ]
    out = line_dedup.dedup_lines(docs(rows), min_words=min_words)
    assert "kept" in out.columns and "body" in out.columns
    got, gone = {r.doc_id: r for r in out.collect()}, brute.later_lines(rows, min_words)
    assert len(got) == len(rows)
    for d, text in rows:
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d])
        assert got[d].text == left
        assert got[d].removed_lines == len(gone[d])


def test_line_dedup_edges(docs):
    passage = "one two three four five six"
    rows = [(1, passage), (1, passage), (2, f"x\n{passage}\ny"), (None, passage), (3, "\n\n"), (4, None), (5, "z\n" * 3000 + "z")]
    out = line_dedup.dedup_lines(docs(rows), min_words=6)
    got = sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None)
    # the NULL id comes first; rows that repeat id and text stand or fall together
    assert got == [(0, passage), (1, ""), (1, ""), (2, "x\ny"), (3, "\n\n"), (5, "z")]
    assert line_dedup.dedup_lines(docs(rows).where("doc_id > 9")).collect() == []


def test_line_dedup_leaves_parts_of_lines_and_short_repeats(docs):
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words)
    broken = " ".join(words[:20]) + "\n" + " ".join(words[20:40]) + "\n" + " ".join(words[40:])
    texts = [
        f"a {passage} b", f"c {passage} d",  # inside one line
        f"e {broken} f", f"g {broken} h",  # its only whole line has 20 words
        "licence text\nx", "licence text\ny", "licence text\nz",
        f"p\n{passage}\nq", f"r\n{passage}\ns",  # whole lines: the later one goes
    ]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs(list(enumerate(texts)))).collect()}
    assert got == {i: (t, 0) for i, t in enumerate(texts)} | {8: ("r\ns", 1)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_no_name_is_defined_twice():
    import ast
    from collections import Counter
    from pathlib import Path

    for file in Path(line_dedup.__file__).parent.glob("*.py"):
        names = Counter(x.name for x in ast.parse(file.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef))
        assert [n for n, k in names.items() if k > 1] == [], file.name


def near_rows(seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 40))] for _ in range(10)]
    rows = []
    for d in range(100):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice("abcdefghijklmnopXYZ")
        rows.append((d, rnd.choice([None, ""]) if rnd.random() < 0.05 else " ".join(words)))
    return rows


def test_minhash_components(docs):
    rows = near_rows(2)
    out = minhash_dedup.components(docs(rows), ngram=2)
    assert out.columns.count("kept") == 1
    got, want = {r.doc_id: r for r in out.collect()}, brute.near_components(rows, 2)
    assert {d: (got[d].n_shingles, got[d].component_id, got[d].kept) for d, _ in rows} == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_minhash_edges(docs):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (2, text.upper()), (7, ""), (8, None), (9, " \n"), (10, "one"), (11, "One"), (12, "w " * 30_000)]
    got = minhash_dedup.components(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (None, 2), (2, 2), (7, 7), (8, 8), (9, 9), (10, 10), (11, 10), (12, 12)}
    assert minhash_dedup.components(docs(rows).where("doc_id > 99")).collect() == []


def test_minhash_links_that_only_a_later_round_finds(docs):
    """Two copies of a text differ from a third by too much, but not from one in between."""
    base = [f"w{i}" for i in range(100)]
    steps = [list(base) for _ in range(12)]
    for k, words in enumerate(steps):
        for i in range(k):
            words[7 * i] = f"x{i}"
    rows = [(k * 3 % 12, " ".join(words)) for k, words in enumerate(steps)] + [(50 + k, "only here " * k) for k in range(1, 4)]
    rows = [(d, t) for d, t in dict(rows).items()]
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(docs(rows), ngram=1).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(rows, 1).items()}


def edited_copies(seed, copies, size, most):
    """Copies of one text with up to ``most`` words replaced: near its text, but often too far from each other."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    out = []
    for d in range(copies):
        words = list(base)
        for i in rnd.sample(range(size), rnd.randint(0, most)):
            words[i] = f"e{rnd.randint(0, 60)}"
        out.append(words)
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_minhash_clusters_of_far_copies(docs, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "SMALL", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", block)
    texts = [" ".join(x) for seed in (1, 2) for x in edited_copies(seed, 90, 60, 9)]
    rows = [((7 * d) % 200, t + (" other" * 3 if d >= 90 else "")) for d, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(docs(rows), ngram=2).collect()}
    want = {d: c for d, (_, c) in brute.near_components(rows, 2).items()}
    assert got == want and 2 < len(set(want.values())) < 150


def test_links_between_blocks_join_what_all_pairs_join():
    words = edited_copies(5, 240, 50, 8)
    sets = [np.unique([hash(w) for w in zip(x, x[1:], strict=False)]) for x in words]
    s, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    component = np.arange(240)
    component[50:150] = 50
    linked = lambda i, j: 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)

    def joined(links):
        forest = brute.Forest(set(component.tolist()))
        for i, j in links:
            forest.link(int(component[i]), int(component[j]))
        return [forest.top(int(c)) for c in component]

    rows = np.argsort(component, kind="stable")
    for left, right in ((rows, rows), (rows[::2], rows[1::2])):
        links = list(minhash_dedup.links_between(s, at, component, left, right, 80))
        assert all(linked(i, j) and component[i] != component[j] for i, j in links) and len(links) < 240
        pairs = [(i, j) for i in left for j in right if i != j and linked(i, j)]
        assert joined(links) == joined(pairs)


def vectors(seed, dim, groups):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 10)):
            out.append((centre + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.25])).astype(np.float32).tolist())
    return out


def test_embedding_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = list(enumerate(vectors(1, 32, 30) + [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None], [float("inf")] + [0.0] * 31, [1.0, 0.0], [2.0, 0.0]]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS node", "1 AS n_links").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.components(df).collect()}
    assert got == brute.vector_links(rows)


def test_embedding_edges(spark):
    rows = [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.components(df).collect())
    assert got == [(0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (9, 0, 9, True)]
    assert embedding_dedup.components(df.where("vec_id > 99")).collect() == []


def test_embedding_recall_and_estimates():
    """The estimate is unbiased, its bound holds, and the tables find pairs at the threshold as often as planned."""
    rng = np.random.default_rng(5)
    dim, n = 64, 3000
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    bits, tables = embedding_dedup.tables_for(1_000_000, 0.9, 0.01)
    plan = embedding_dedup.Plan(dim, bits, tables)
    assert (plan.buckets(x) == plan.buckets(y)).any(1).mean() > 0.97
    code, factor, *_ = plan.codes(x, np.arange(n))
    sign = np.unpackbits(code, axis=1)[:, :dim] * 2.0 - 1
    estimate = (sign * (y @ plan.rotation)).sum(1) / (np.sqrt(dim) * factor)
    assert abs(estimate.mean() - 0.9) < 0.005
    bound = embedding_dedup.SIGMAS * np.sqrt((1 - factor**2) / (factor**2 * (dim - 1)))
    assert (np.abs(estimate - 0.9) <= bound).mean() > 0.999
