"""Plain-Python versions of the operators' rules, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np

DARK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def later_lines(docs, min_words):
    """Line numbers to delete per document: every run tried, the least place of each kept."""
    first, places = {}, []
    for doc, text in docs:
        if text is None:
            continue
        lines = text.split("\n")
        words = [len(DARK.findall(x)) for x in lines]
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += words[j]
                if total >= min_words:
                    key = tuple(lines[i : j + 1])
                    first[key] = min(first.get(key, (doc, i)), (doc, i))
                    places.append((key, doc, i, j))
    gone = defaultdict(set)
    for key, doc, i, j in places:
        if (doc, i) > first[key]:
            gone[doc].update(range(i, j + 1))
    return gone


def benchmark_hits(text, items, window):
    """``(words, hit words, item names)`` of one text."""
    windows = defaultdict(set)
    for name, body in items:
        words = WORD.findall((body or "").translate(LOWER))
        n = min(window, len(words))
        for j in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[j : j + n])].add(name)
    words = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for n in {len(k) for k in windows}:
        for j in range(len(words) - n + 1):
            found = windows.get(tuple(words[j : j + n]))
            if found:
                names |= found
                hit.update(range(j, j + n))
    return len(words), len(hit), sorted(names)


def shingles(text, n):
    words = DARK.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_components(docs, ngram, percent=80):
    """Document -> (size of its set, smallest document reachable)."""
    sets = {d: shingles(t, ngram) for d, t in docs}
    forest, names = Forest(sets), sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                forest.link(a, b)
    return {d: (len(sets[d]), forest.top(d)) for d in names}


def vector_links(rows, threshold=0.9):
    """Vector -> (links, smallest vector reachable)."""
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    forest, links = Forest([i for i, _ in rows]), defaultdict(int)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                forest.link(i, j)
    return {i: (links[i], forest.top(i)) for i, _ in rows}


def lexical_ranks(docs, items, k=10):
    """Item text -> its best ``(doc, score)``; documents and items as ``(id, text)``."""
    counts = [(d, Counter(WORD.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, words = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = {}
    for name, text in items:
        found = []
        for d, c, size in counts:
            m, score = 25 + 75 * size * n // words, 0
            for t, q in Counter(WORD.findall((text or "").translate(LOWER))).items():
                if c[t]:
                    score += q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d))
        out[name, text] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def hard_negatives(rows, anchors, k=5, low=80, high=100):
    """``(anchor, positive, rank, negative, positive score, negative score)`` of rows ``id -> (label, whole numbers)``."""
    out = []
    for a in anchors:
        label, v = rows[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in rows.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in scores if x[2] == label][:k]:
            inside = [(s, j) for s, j, other in scores if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(inside[:k])]
    return sorted(out)


def quality_measures(text):
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    words = DARK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if DARK.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    again = {p for i, g in enumerate(grams) if often[g] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(again)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def wilson(share, n, z):
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(texts, posterior=0.5, bits=1.0, few=2):
    """Row -> spans of terms that disclose an entity; every count made one by one."""
    free, spans = [], []
    for t in texts:
        base = pii_spans(t)
        spans.append(base)
        free.append([m for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", t or "") if not any(s < m.end() and m.start() < e for _, s, e in base)])
    low = lambda m: m.group().translate(LOWER)
    shape = lambda m: 0 if re.search("[0-9]", m.group()) else 1 if "A" <= m.group()[0] <= "Z" else 2
    classes = []
    for t, found, base in zip(texts, free, spans, strict=True):
        out = []
        for i, m in enumerate(found):
            d = 9
            for _, s, _ in base:
                at = sum(x.start() < s for x in found)
                d = min(d, at - i if i < at else i - at + 1)
            out.append((shape(m), {1: 0, 2: 1, 3: 2, 4: 2}.get(d, 3)) if d <= 8 else None)
        classes.append(out)
    rows_of, near_of, texts_with = Counter(), Counter(), defaultdict(set)
    for t, found, base in zip(texts, free, spans, strict=True):
        for w in {low(m) for m in found}:
            rows_of[w] += 1
            near_of[w] += bool(base)
            texts_with[w].add(t or "")
    candidates = {w for w in rows_of if near_of[w] and near_of[w] >= posterior * rows_of[w]}
    named = defaultdict(set)
    for t, base in zip(texts, spans, strict=True):
        for k, s, e in base:
            named[k, t[s:e].translate(LOWER)].add(t)
    n = len({t or "" for t in texts})
    bad = set()
    for w in candidates:
        k = len(texts_with[w])
        for e in named.values():
            both = len(texts_with[w] & e)
            if k > few and both and wilson(both / k, k, 1.645) >= posterior and math.log2(both * n / (k * len(e))) >= bits:
                bad.add(w)
    all_, rare, away, away_rare = Counter(), Counter(), Counter(), Counter()
    for found, cls in zip(free, classes, strict=True):
        for m, c in zip(found, cls, strict=True):
            lonely = rows_of[low(m)] <= few
            if c is None:
                away[shape(m)] += 1
                away_rare[shape(m)] += lonely
            else:
                all_[c] += 1
                rare[c] += lonely
    disclosing = {
        c for c in all_ if rare[c] and (away_rare[c[0]] + 1) / (away[c[0]] + 2) <= (1 - posterior) * wilson(rare[c] / all_[c], all_[c], 2.576)
    }
    for found, cls in zip(free, classes, strict=True):
        bad |= {low(m) for m, c in zip(found, cls, strict=True) if c in disclosing and low(m) in candidates and len(texts_with[low(m)]) <= few}
    return [[m.span() for m in found if low(m) in bad] for found in free]
