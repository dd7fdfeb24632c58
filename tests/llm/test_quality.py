"""Quality rules: measures and thresholds against brute force, the guarantee on planted data, edge cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import quality_rules as rules

from . import brute

LABELS = "doc_id long, quality int, toxic int"


def test_measures(spark, docs):
    rng = np.random.default_rng(2)
    phrase = " ".join(f"p{i}" for i in range(8))
    texts = [
        None, "", " \t\n\r\x0b\x0c", "a", "a a a a a a a a", "a " * 9, phrase, f"{phrase} x {phrase}", f"{phrase} {phrase} p0", f"{phrase[:-3]} {phrase}",
        "x\nx\n \ny\nx\r\nx\n", "# a|b <c> $5 50%\n# a|b <c> $5 50%", "été à  l' école 😀😀 😀", "w" * 500_000, "ab cd ef gh " * 20_000,
        "\n".join(["same line of a few words here again"] * 300),
    ]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 2, int(rng.integers(1, 80)))) for _ in range(60)]
    texts += ["".join(rng.choice(list("ab \n\t#|"), int(rng.integers(1, 200)))) for _ in range(60)]
    table = docs(list(enumerate(texts))).withColumn("_words", F.lit("clash"))
    got = {r.doc_id: tuple(r[m] for m in rules.MEASURES) for r in rules.measured(table, "text").collect()}
    assert got == {i: brute.quality_measures(t) for i, t in enumerate(texts)}


def tail(k, n, p):
    return sum(math.exp(math.log(math.comb(n, j)) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def test_binomial_sum_is_exact(spark):
    cases = [(k, n, p) for p in (0.01, 0.1, 0.5) for n in (1, 7, 100, 1500) for k in (0, 1, 3, 15, n // 20, n) if k <= n]
    for p in (0.01, 0.1, 0.5):
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k int, n long")
        for r in rows.withColumn("x", rules.binomial_cdf(F.col("k"), F.col("n"), p)).collect():
            assert r.x == pytest.approx(min(1.0, tail(r.k, r.n, p)), rel=1e-9)
    far = spark.range(1).select(rules.binomial_cdf(F.lit(50), F.lit(2_000_000).cast("long"), 0.01).alias("x")).first().x
    assert 0 <= far < 1e-300


def texts_of(rng, n, junk):
    out = []
    for i in range(n):
        words = [f"{'x' * int(rng.integers(3, 7))}{j}" for j in range(int(rng.integers(40, 60)))]
        if junk[i]:
            words[::4] = ["##"] * len(words[::4])
        out.append(" ".join(words))
    return out


def expected_thresholds(rows, risk, error, levels):
    """The rule in plain Python: ``rows`` are ``(doc, stratum, good, values)`` that pass the base rules."""
    fits = lambda d: hashlib.sha256(str(d).encode()).hexdigest()[0] < "8"
    plans = {}
    for s in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == s and fits(r[0])]
        good, bad = [r[3] for r in own if r[2]], [r[3] for r in own if not r[2]]
        if not good:
            continue
        plans[s] = []
        for share in levels:
            cuts = []
            for r in range(len(rules.RULES)):
                c = sorted(v[r] for v in good)[max(1, math.ceil((1 - share) * len(good))) - 1]
                g, b = sum(v[r] > c for v in good), sum(v[r] > c for v in bad)
                cuts.append(c if b * max(len(good), 1) > rules.GAIN * max(g, 1) * max(len(bad), 1) else None)
            plans[s].append(cuts)
    tests, held = {}, {}
    for s, plan in plans.items():
        held[s] = [r[3] for r in rows if r[1] == s and not fits(r[0]) and r[2]]
        if held[s]:
            tests[s] = [sum(any(c is not None and v > c for v, c in zip(x, cuts, strict=True)) for x in held[s]) for cuts in plan]
    out = {}
    for s, ks in tests.items():
        for t, k in enumerate(ks):
            if tail(k, len(held[s]), risk) > error / len(tests):
                break
            out[s] = (t, len(tests), len(held[s]), k, plans[s][t])
    return out


def test_thresholds_equal_brute_force_and_hold_their_guarantee(spark):
    rng = np.random.default_rng(8)
    n = 1600
    strata = [("a", "a", "a", "b", None)[i % 5] for i in range(n)]
    junk = rng.random(n) < 0.25
    texts = texts_of(rng, n, junk)
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, strata, strict=True))]
    labels = [(i, int(not junk[i]), 0) for i in range(n)] + [(0, int(not junk[0]), 1), (n + 5, 1, 0), (3, None, 0), (None, 1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    table = table.withColumn("kept", F.lit("clash")).withColumn("stratum", F.lit("clash")).withColumn("cutoffs", F.lit("clash"))
    judged, limits = rules.apply(table, spark.createDataFrame(labels, LABELS), risk=0.05, error=0.1)
    assert judged.columns == ["doc_id", "text", "lang", "stratum", "cutoffs", *rules.MEASURES, "base_failed", "kept"]
    values = lambda w, c, s, d, r: [float(-w), -c / max(w, 1), c / max(w, 1), s / max(w, 1), d / max(w, 1), r / max(w, 1)]
    measures = [brute.quality_measures(t) for t in texts]
    usable = [(i, strata[i], not junk[i], values(*m)) for i, m in enumerate(measures) if m[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    expected = expected_thresholds(usable, 0.05, 0.1, rules.LEVELS)
    got = {r.stratum: (r.level, r.tests, r.n, r.k, r.cutoffs) for r in limits.collect()}
    assert got == expected and "a" in got
    for r in limits.collect():
        assert r.p_value == pytest.approx(tail(r.k, r.n, 0.05)) and r.p_value <= 0.1 / r.tests
    kept = {r.doc_id: r.kept for r in judged.collect()}
    caught = [not kept[i] for i in range(n) if junk[i] and strata[i] == "a"]
    lost = [not kept[i] for i in range(n) if not junk[i] and strata[i] == "a"]
    assert np.mean(caught) > 0.95 and np.mean(lost) <= 0.05


def test_the_error_is_not_exceeded_over_many_draws():
    """A level whose true false rejection share is above the risk is certified in at most the allowed share of draws."""
    rng = np.random.default_rng(4)
    n, risk, error = 400, 0.05, 0.1
    k = rng.binomial(n, 0.0501, 4000)
    assert np.mean([tail(int(x), n, risk) <= error for x in k]) <= error + 0.015


def test_hot_stratum_and_many_strata_take_the_salted_join(spark, docs, monkeypatch):
    rng = np.random.default_rng(8)
    junk = rng.random(700) < 0.3
    rows = list(enumerate(texts_of(rng, 700, junk)))
    table = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 10 < 8, "hot").otherwise(F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, int(not junk[i]), 0) for i in range(700)], LABELS)
    plain = {r.doc_id: r.kept for r in rules.apply(table, labels, risk=0.05, error=0.1)[0].collect()}
    monkeypatch.setattr(rules, "BROADCAST_STRATA", 1)
    salted = {r.doc_id: r.kept for r in rules.apply(table, labels, risk=0.05, error=0.1)[0].collect()}
    assert plain == salted and len(plain) == 700 and not all(plain.values())


def test_edges(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "too few"), (None, text), (5, "a b c d e f g h " * 10), (6, "z" * 300_000 + " " + text)]
    none = spark.createDataFrame([], LABELS)
    table = docs(rows).withColumn("lang", F.lit(None).cast("string"))
    judged, limits = rules.apply(table, none, keep=["doc_id"])
    got = sorted(((r.doc_id or 0), r.n_words, r.base_failed, r.kept) for r in judged.collect())
    assert got == [(0, 30, False, True), (1, 30, False, True), (1, 30, False, True), (2, 0, True, False), (3, 0, True, False), (4, 2, True, False),
                   (5, 80, True, False), (6, 31, False, True)]
    assert limits.count() == 0
    judged, limits = rules.apply(docs([]).withColumn("lang", F.lit("x")), none)
    assert judged.count() == 0 and limits.count() == 0


def test_no_python_in_the_plan(spark, docs):
    judged, limits = rules.apply(docs([(1, "a b")]).withColumn("lang", F.lit("x")), spark.createDataFrame([(1, 1, 0)], LABELS))
    measured = rules.measured(docs([(1, "a b")]), "text")
    for df in (judged, limits, measured):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
