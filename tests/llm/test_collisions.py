"""Texts that sums over bytes or words cannot tell apart: no operator may take one for the other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import bpe, decontamination, lexical_search, line_dedup, minhash_dedup, pii, textops, token_counts, toxicity

from . import brute


def thue_morse(n, a="a", b="b"):
    text = a
    while len(text) < n:
        text += text.translate(str.maketrans(a + b, b + a))
    return text


def complement(text, a="a", b="b"):
    return text.translate(str.maketrans(a + b, b + a))


SIZES = (1024, 2048)


@pytest.fixture
def clashing(docs):
    texts = [t for n in SIZES for t in (thue_morse(n), complement(thue_morse(n)))]
    return docs(list(enumerate(texts)), parts=1), texts


def test_hashes_and_lexicon():
    texts = [t.encode() for n in (64, *SIZES, 8192) for t in (thue_morse(n), complement(thue_morse(n)))]
    raw, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts)))
    starts = np.cumsum(lengths) - lengths
    for seed in (0, 1):
        assert len(np.unique(textops.run_hashes(raw, starts, lengths, seed))) == len(texts)
    assert textops.Lexicon(texts).ids(raw, starts, lengths).tolist() == list(range(len(texts)))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    real = textops.run_hashes
    monkeypatch.setattr(textops, "run_hashes", lambda raw, starts, lengths, seed=0: real(raw, starts, lengths, seed) % np.uint64(3))
    words = [f"w{i % 40}".encode() * (1 + i % 3) for i in range(200)]
    raw, lengths = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    starts = np.cumsum(lengths) - lengths
    first, of = textops.classes(raw, starts, lengths)
    assert [words[first[k]] for k in of] == words and len(first) == len(set(words))
    known = sorted(set(words))[::2]
    assert textops.Lexicon(known).ids(raw, starts, lengths).tolist() == [known.index(w) if w in known else -1 for w in words]


def test_token_counts_and_bpe(clashing, tokenizer, vocabulary_path):
    table, texts = clashing
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in bpe.encode(table.select("doc_id", "text"), vocabulary_path, decoded=True).collect()}
    assert [got[i].ids for i in range(len(texts))] == ids and [got[i].decoded for i in range(len(texts))] == texts
    trees = token_counts.build(table.select("doc_id", "text"), vocabulary_path)
    counted = dict(trees.select("doc_id", token_counts.total("tree").alias("n")).collect())
    assert [counted[i] for i in range(len(texts))] == list(map(len, ids))


def test_line_dedup(docs):
    rows = []
    for k, n in enumerate(SIZES):
        words = " ".join(f"w{i}" for i in range(60))
        rows += [(2 * k, f"{words} {thue_morse(n)}"), (2 * k + 1, f"{words} {complement(thue_morse(n))}")]
    # the same for the order of lines: equal lines, in an order and its complement
    for k, n in enumerate((64, 128)):
        for t in (thue_morse(n), complement(thue_morse(n))):
            rows.append((len(rows) + 10 * k, "\n".join({"a": "left line", "b": "right line"}[c] for c in t)))
    gone = brute.later_lines(rows, 50)
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs(rows), min_words=50).collect()}
    assert got == {d: len(gone[d]) for d, _ in rows} and not any(got[d] for d in range(4))


def test_decontamination_and_search(clashing):
    table, texts = clashing
    items = table.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts[::2])], "item_id long, text string")
    found = {r.doc_id: r["items"] for r in decontamination.find(table, items).collect()}
    assert found == {0: ["0"], 1: [], 2: ["1"], 3: []}
    hits = {(r.item_id, r.doc_id) for r in lexical_search.search(table, items).collect()}
    assert hits == {(0, 0), (1, 2)}


def test_minhash(docs):
    rows = [(i, " ".join([t] * (1 + i % 2))) for i, t in enumerate(t for n in SIZES for t in (thue_morse(n), complement(thue_morse(n))))]
    rows += [(10 + i, " ".join({"a": "x", "b": "y"}[c] for c in t)) for i, t in enumerate((thue_morse(64), complement(thue_morse(64))))]
    for ngram in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.components(docs(rows), ngram=ngram).collect()}
        assert got == brute.near_components(rows, ngram)


def test_terms_of_toxicity_and_pii(clashing):
    _, texts = clashing
    hashes, of = toxicity._terms(texts)
    whole = [hashes[of == i] for i in range(len(texts))]
    assert len({x[0] for x in whole}) == len(texts)
    assert len(set(pii._hash64([t.encode() for t in texts]).tolist())) == len(texts)


def test_pii_terms_of_clashing_words(docs):
    a, b = thue_morse(1024), complement(thue_morse(1024))
    rows = [(i, f"{a} {i} joe@x.org") for i in range(6)] + [(10 + i, f"{b} nothing here {i}") for i in range(12)]
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii.find(docs(rows)).collect()}
    assert all("term" in got[i] for i in range(6)) and not any(got[10 + i] for i in range(12))
