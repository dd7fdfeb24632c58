"""Decontamination, personal data and toxicity."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import decontamination, pii, toxicity

from . import brute


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    for _ in range(30):
        seq = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        index = decontamination.FmIndex(seq, 3)
        patterns = rng.integers(1, 4, (20, rng.integers(1, 5)))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(seq) - len(p)) if (seq[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("seed", range(3))
def test_decontamination(docs, seed, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    rnd = random.Random(seed)
    letters = ["a", "b", "C", "é", "Z9", "zz"]
    text = lambda n: rnd.choice([" ", "-", ", "]).join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    rows = [(d, rnd.choice([None, "", text(60), text(8)])) for d in range(40)]
    items = [(str(i % 5), text(rnd.choice([2, 6, 12]))) for i in range(7)]
    table = docs([(0, "")]).sparkSession.createDataFrame(items + [("9", None), (None, "a b a b a")], "item_id string, text string")
    known = items + [("9", ""), ("", "a b a b a")]
    for block in (4_000_000, 300):
        found = {r.doc_id: r for r in decontamination.find(docs(rows), table, window=4, block_bytes=block).collect()}
        for d, body in rows:
            assert (found[d].n_words, found[d].n_hit, sorted(found[d]["items"])) == brute.benchmark_hits(body, known, 4)
            assert sum(s.words for s in found[d].spans) == found[d].n_hit


def test_long_and_repeated_items_stay_within_blocks(docs, monkeypatch):
    """A long item is cut, a repeated one counted once: no block on the driver is above its bound."""
    rnd = random.Random(3)
    long = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60_000))
    words = long.split(" ")
    spark = docs([(0, "")]).sparkSession
    items = spark.createDataFrame([("long", long)] + [("again", "x y z " * 10)] * 500 + [("short", "q r")], "item_id string, text string")
    rows = [(1, " ".join(words[777:795])), (2, "say x y z x y z x y z x y z now"), (3, "q r"), (4, "none of it " * 5), (5, " ".join(words[-12:])), (6, None)]
    sizes = []
    real = decontamination._search

    def search(found, block, window):
        sizes.append(sum(len(t) + len(i) + 64 for i, t in block))
        return real(found, block, window)

    monkeypatch.setattr(decontamination, "_search", search)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontamination.find(docs(rows), items, block_bytes=30_000, piece_words=2_000).collect()}
    assert len(sizes) > 3 and max(sizes) <= 30_000
    one = {r.doc_id: (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontamination.find(docs(rows), items).collect()}
    assert got == one
    known = [("long", long), ("again", "x y z " * 10), ("short", "q r")]
    assert {d: x[:3] for d, x in got.items()} == {d: tuple(brute.benchmark_hits(t, known, 10)) for d, t in rows}


def test_remove_spans(docs):
    items = docs([(0, "")]).sparkSession.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    rows = [(1, "say THE quick, brown fox! é"), (2, "the quick brown fox"), (3, "the quick fox"), (4, None)]
    out = decontamination.find(docs(rows), items).withColumn("text", decontamination.remove_spans(F.col("text"), F.col("spans")))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "say ! é", 2: "", 3: "the quick fox", 4: None}
    assert decontamination.find(docs(rows).where("doc_id > 9"), items).collect() == []
    nothing = decontamination.find(docs(rows), items.where("item_id > 1")).collect()
    assert [r.n_hit for r in nothing] == [0] * 4


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    parts = ["a", "b@c.de", "@", ".", "1", "22", "255.", "+1", "-", " ", "(", "é", "4111 1111 1111 1111", "192.168.", "4111111111111111", "\n", "b.c", "300"]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == brute.pii_spans(text), text


def test_very_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000 + "@x.de " + "1" * 300_000 + " " + "1." * 100_000)[0] == ("email", 0, 300_005)


def planted(seed, ordinary=260, named=120):
    """Ordinary texts with rare words everywhere; some name a person and an account beside an e-mail address."""
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("abdeghilmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    fresh = iter(range(10**6))

    def prose(n):
        words = [common[min(int(rnd.paretovariate(0.8)) - 1, 399)] for _ in range(n)]
        for i in range(n):
            if rnd.random() < 0.04:
                words[i] = "rare" + "".join(chr(97 + int(c)) for c in str(next(fresh)))
            elif rnd.random() < 0.02:
                words[i] = str(rnd.randint(10, 60))
            elif rnd.random() < 0.1:
                words[i] = words[i].capitalize()
        return " ".join(words)

    rows, truth = [prose(rnd.randint(30, 80)) for _ in range(ordinary)], set()
    people = [(f"Q{chr(97 + i % 26)}{chr(97 + i // 26)}lor", f"{i}0047{i}1", f"p{i}@firm.org") for i in range(named)]
    for i, (name, account, mail) in enumerate(people):
        truth |= {name.lower(), account}
        # most are named in one text, some in two, some in many
        for _ in range(1 if i % 4 else 2 if i % 8 else 6):
            rows.append(f"{prose(rnd.randint(10, 40))}\n{name} {mail} {account}\n{prose(rnd.randint(10, 40))}")
    rnd.shuffle(rows)
    return rows, truth


def test_planted_names_and_accounts(docs):
    texts, truth = planted(4)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute.disclosing_terms(texts)
    flagged = [texts[i][s:e].lower() for i, found in got.items() for s, e in found]
    stand = sum(len([m for m in re.findall("[A-Za-z0-9]+", re.sub(r"\S+@\S+", " ", t)) if m.lower() in truth]) for t in texts)
    right = sum(w in truth for w in flagged)
    assert right >= 0.9 * len(flagged) and right >= 0.9 * stand and stand > 250


def test_rare_words_near_entities_by_chance_are_left(docs):
    """As many rare words beside entities as anywhere else: none is flagged."""
    rnd = random.Random(6)
    texts = []
    for i in range(150):
        words = [f"w{rnd.randint(0, 30)}" if rnd.random() < 0.8 else f"once{chr(97 + i % 26)}{i}x{k}" for k in range(30)]
        if i % 3 == 0:
            words.insert(rnd.randint(0, 30), f"a{i}@x.org")
        texts.append(" ".join(words))
    got = {r.doc_id: r.spans for r in pii.find(docs(list(enumerate(texts)))).collect()}
    assert [[(s.start, s.end) for s in got[i] if s.kind == "term"] for i in range(150)] == brute.disclosing_terms(texts) == [[]] * 150


def test_terms_of_several_texts_and_copies(docs):
    common = "the notes of Kim go to 12 at the office"
    texts = [f"{common} {i}" for i in range(20)] + [f"{common} zanzibar {i} joe@x.org" for i in range(8)] + ["Zanzibar é"]
    # copies of one text are one witness, not many
    texts += ["quibble near ann@y.org"] * 9 + [None, "", "+ @ . 1.2.3"]
    out = pii.find(docs(list(enumerate(texts)))).withColumn("clean", pii.sanitise(F.coalesce("text", F.lit("")), F.col("spans")))
    got = {r.doc_id: r for r in out.collect()}
    assert [[(s.start, s.end) for s in got[i].spans if s.kind == "term"] for i in range(len(texts))] == brute.disclosing_terms(texts)
    assert got[21].clean == f"{common} [TERM] 1 [EMAIL]" and got[28].clean == "[TERM] é" and got[3].clean == texts[3]
    assert got[29].clean == "quibble near [EMAIL]" and got[39].spans == [] and out.columns.count("spans") == 1


def test_pii_edges(docs):
    long = "word " * 100_000 + "joe@x.org Name " + "x" * 200_000
    rows = [(1, None), (1, None), (2, ""), (None, "a@b.cd"), (3, long), (4, "@@@ ++ 999.1.1.1"), (5, "a@b.cd"), (5, "a@b.cd")]
    got = sorted(((r.doc_id or 0), pii_text(r.spans)) for r in pii.find(docs(rows)).collect())
    assert got == [(0, "email:0:6"), (1, ""), (1, ""), (2, ""), (3, "email:500000:500009"), (4, ""), (5, "email:0:6"), (5, "email:0:6")]
    assert pii.find(docs(rows).where("doc_id > 200")).collect() == []
    assert pii.find(docs([(1, "no entity at all"), (2, None)])).where("size(spans) > 0").collect() == []


def pii_text(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abdeghilmnorst") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(2, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["Zounds", "vexil", "vexor", "vexant", "cursed", "blight"]))
        rows.append((i, " ".join(text)))
        if rnd.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels, {i for i, t in rows if any(w in t for w in ("Zounds", "vex", "cursed", "blight"))}


def test_toxicity_on_held_out_rows(docs):
    rows, labels, bad = toxic_rows(700, 1)
    gold = docs([(0, "")]).sparkSession.createDataFrame(labels + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), gold)
    got = {r.doc_id: r.score for r in toxicity.score(docs(rows), model).collect()}
    held = [i for i, _ in rows if i not in {x for x, _ in labels}]
    right = sum((got[i] >= 0.5) == (i in bad) for i in held) / len(held)
    assert right > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    lexicons = slice(0, toxicity.LEXICONS)
    assert model.voters["toxic"][lexicons].max() > 5 * model.voters["clean"][lexicons].max()
    assert model.voters["weight"].min() < 1  # lexicons that repeat each other count less


def test_toxicity_never_reads_held_out_labels(docs):
    rows, labels, _ = toxic_rows(200, 2)
    spark = docs([(0, "")]).sparkSession
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = table.withColumn("toxic", F.when(toxicity.in_training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(docs(rows), t) for t in (table, flipped))
    assert (a.terms == b.terms).all() and np.allclose(a.weights, b.weights)


def test_toxicity_counts_capitals_of_whole_texts():
    texts = ["", "An ordinary sentence of lower letters, as long as any prefix may be. " + "SHOUTING " * 40, "LOUD " * 5, "é" * 9 + "ÄÖ", "Z", "[@`{"]
    assert toxicity._capitals(texts).tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts]
    assert toxicity._capitals([]).tolist() == []
    whole, doc, lengths = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    assert toxicity._patterns(texts, whole, doc, lengths)[:, 0].tolist() == [False, True, True, False, True, False]


def test_toxicity_edges(docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words")]
    gold = docs([(0, "")]).sparkSession.createDataFrame([(1, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs(rows), toxicity.train(docs(rows), gold))
    assert [r.score for r in out.collect()] == [0.0] * 4 and out.columns.count("score") == 1
    empty = docs(rows).where("doc_id > 9")
    assert toxicity.score(empty, toxicity.train(empty, gold)).collect() == []
