"""BPE and edit-aware counts against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventscope.llm import bpe, token_counts
from eventscope.llm.bpe import Vocabulary

PIECES = [
    "a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'LL", "s", "1", "23", "!", "é", "ß", "日本", "😀", "\t",
    "　", "<|endoftext|>", "<|", "|>", "x'", "\u0085", "\x1c", "²", "Ⅷ", "़", "…",
]


@pytest.fixture(scope="module")
def voc(vocabulary_path):
    return Vocabulary(vocabulary_path)


def encode(voc, texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, at = voc.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def sample(seed, n, size):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_batch_encoding_equals_the_library(voc, tokenizer):
    texts = sample(1, 2000, 30)
    assert encode(voc, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(bpe.vocabulary(path), [text])[0]
    assert ids == _library(path, Tokenizer).encode(text, add_special_tokens=False).ids


_LIBRARY = {}


def _library(path, kind):
    return _LIBRARY.setdefault(path, kind.from_file(path))


@pytest.mark.parametrize("letters", ["ab", "aé", "theiron", "a"])
def test_unsplit_text_by_halves(voc, tokenizer, monkeypatch, letters):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 16)
    rnd = random.Random(letters)
    for _ in range(60):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400)))
        assert voc.word(word.encode()) == tokenizer.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [7, 20, 50])
def test_pieces_join_exactly(voc, tokenizer, size):
    for text in [*sample(size, 250, 40), "x" * 200 + "ab" * 200 + " " * 80]:
        body, level, at = text.encode(), [], 0
        while at < len(body):
            end = min(at + size, len(body))
            while end < len(body) and (body[end] & 0xC0) == 0x80:
                end += 1
            part = np.frombuffer(body[at:end], np.uint8)
            starts, lengths, _, per, ids = voc.counts(part, np.array([0, len(part)]))
            level.append((body[at:end], starts + lengths, per, ids))
            at = end
        while len(level) > 1:
            level = [voc.join_pieces(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        got = level[0][3].tolist() if level else []
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encode_operator(docs, tokenizer, vocabulary_path, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 60)
    rnd = random.Random(4)
    long = "".join(rnd.choice(PIECES + [" word"]) for _ in range(400))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "abc" * 300), (5, "short text"), (None, long + "!")]
    out = bpe.encode(docs(rows), vocabulary_path, decoded=True)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns[-2:] == ["ids", "decoded"] and out.columns.count("ids") == 1
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    again = bpe.decode(out.select("doc_id", "text", "ids"), vocabulary_path).collect()
    assert all(r.decoded == (r.text or "") for r in again)


def test_encode_empty_table(docs, vocabulary_path):
    assert bpe.encode(docs([(1, "x")]).where("doc_id > 1"), vocabulary_path).collect() == []


def edited(text, edits):
    text = text or ""
    for e in edits or []:
        if e is None:
            continue
        pos = min(max(e[0] or 0, 0), len(text))
        cut = min(max(e[1] or 0, 0), len(text) - pos)
        text = text[:pos] + (e[2] or "") + text[pos + cut :]
    return text


def test_edits_equal_a_full_count(spark, tokenizer, vocabulary_path):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        text = rnd.choice([None, ""]) if rnd.random() < 0.1 else "".join(rnd.choice(PIECES + [" word", " other"]) for _ in range(rnd.randint(1, 200)))
        n = len(text or "")
        edits = [
            (rnd.choice([rnd.randint(0, n + 3), None, -2]), rnd.choice([0, 1, 5, 60, None]),
             rnd.choice(["", "x", None, " ", "<|endoftext|>", "'s", "many new words " * rnd.randint(1, 60)]))
            for _ in range(rnd.randint(0, 4))
        ]
        rows.append((i, text, rnd.choice([edits, edits, [None, *edits], None])))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}").repartition(2)
    trees = token_counts.build(df, vocabulary_path)
    out = {r.doc_id: r for r in token_counts.apply_edits(trees.withColumn("before", token_counts.total("tree")), vocabulary_path)
           .withColumn("after", token_counts.total("tree")).collect()}
    for i, text, edits in rows:
        want = edited(text, edits)
        assert out[i].text == want
        assert out[i].before == len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert out[i].after == len(tokenizer.encode(want, add_special_tokens=False).ids), (text, edits)
        tree = out[i].tree
        assert tree.chars[1] == len(want)
        assert all(tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1] for k in range(1, len(tree.tokens) // 2))


def test_a_small_edit_reads_little(spark, tokenizer, vocabulary_path):
    text = " some words of a longer text," * 2000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    log = spark.createDataFrame([(1, 0, 30_000, 5, "new"), (1, 1, 100, 0, "more")], "doc_id long, seq int, pos int, del int, ins string")
    out = token_counts.update(token_counts.build(df, vocabulary_path), log, vocabulary_path).withColumn("n", token_counts.total("tree")).first()
    assert out.reencoded_chars < 1000
    assert out.n == len(tokenizer.encode(out.text, add_special_tokens=False).ids)


def test_update_keeps_documents_without_edits(spark, vocabulary_path):
    df = spark.createDataFrame([(1, "a b"), (None, "c"), (3, None)], "doc_id long, text string")
    log = spark.createDataFrame([(1, 0, 0, 1, "zz")], "doc_id long, seq int, pos int, del int, ins string")
    out = token_counts.update(token_counts.build(df, vocabulary_path), log, vocabulary_path)
    assert {(r.doc_id, r.text) for r in out.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()} == {(1, "zz b"), (None, "c"), (3, "")}


def test_context_is_longer_than_every_added_token(voc):
    class Other:
        special = {("<|" + "é" * 40 + "|>").encode(): 1}

    assert token_counts.context(voc) >= max(16, *(len(t) for t in voc.special)) and token_counts.context(Other) == 45
