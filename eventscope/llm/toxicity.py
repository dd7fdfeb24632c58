"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Lexicons. Document counts of words and word beginnings (4 to 6 bytes) in at most
   ``LABELLED`` labelled rows (those of smallest id hash) give the ``FEATURES`` terms that
   set the classes apart most. The strongest toxic ones are dealt out to
   ``LEXICONS`` lexicon voters; fixed patterns (capitals, exclamation marks, ...) are
   further voters. A voter fires or not; a document's votes are a bit mask.
2. Label model. Every document of the corpus votes; masks are counted (combined on
   the map side). EM over the mask counts estimates how often each voter fires on
   toxic and on clean documents, started from the labelled rows. Second moments of
   the votes in each class give the voters' correlations; a voter's evidence is
   divided by one plus the sum of its positive correlations, and EM is run again.
   The driver sees sums of fixed size only.
3. Classifier. Logistic regression on the posterior labels of at most ``LABELLED``
   labelled rows (a label counts as one more, reliable vote) and about ``FIT_ROWS``
   other documents picked by hash. Its inputs are the terms and patterns of
   the text, nothing else. It scores whole texts, all documents.

The two bounds are parameters of `train`; counts, masks and scores cover all rows.

Defined results: NULL and empty texts get the score of a text without terms;
labels that are NULL or not 0 / 1 are left out, of several labels of an id the
largest counts; without a toxic and a clean label every score is 0; repeated rows
are scored each; an empty table gives no rows; extra columns stay (``score``
replaces an input of that name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, configure, scratch
from .textops import mixed, run_hashes, slices, utf8

LABELLED = 20_000
FIT_ROWS = 20_000
FEATURES = 4096
LEXICONS = 24
PREFIXES = (4, 5, 6)
MIN_TOXIC = 5
BITS = 1 << 23
GOLD = np.log(0.98 / 0.02)
EM_ROUNDS = 12

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of the texts, word starts, word lengths, and each word's text."""
    parts = [t.lower().encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _LETTER[raw]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return raw, starts, ends - starts, np.searchsorted(offs, starts, "right") - 1


def _terms(texts: list[str], words: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (words and word beginnings) and the text of each."""
    raw, starts, lengths, doc = words or _words(texts)
    hashes, docs = [mixed(run_hashes(raw, starts, lengths), 1)], [doc]
    for k in PREFIXES:
        longer = lengths > k
        hashes.append(mixed(run_hashes(raw, starts[longer], np.full(int(longer.sum()), k)), k))
        docs.append(doc[longer])
    return np.concatenate(hashes).view(np.int64), np.concatenate(docs)


def _capitals(texts: list[str]) -> np.ndarray:
    """How many capitals A-Z each whole text holds."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)  # a byte between texts, so that none is empty
    first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return np.add.reduceat(raw - np.uint8(0x41) < 26, first, dtype=np.int64) if parts else np.zeros(0, np.int64)


def _patterns(texts: list[str], whole: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fixed patterns, one column each; ``whole`` are the hashes of the words, in order."""
    n = len(texts)
    words = np.bincount(doc, minlength=n)
    letters = np.bincount(doc, weights=lengths, minlength=n)
    chars = np.array([len(t) for t in texts])
    upper = _capitals(texts)
    bang = np.array([t.count("!") for t in texts])
    ask = np.array([t.count("?") for t in texts])
    order = np.lexsort((whole, doc))
    h, d = whole[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    kinds = np.bincount(d[new], minlength=n)
    some = np.maximum(words, 1)
    return np.stack([
        upper > 0.4 * np.maximum(chars, 1), bang > 0.2 * some, ask > 0.1 * some, letters < 0.5 * chars,
        words < 20, words > 2000, kinds < 0.3 * words, letters > 9 * some,
    ], axis=1)


N_PATTERNS = 8


@dataclass
class Model:
    """Everything scoring needs: a few thousand numbers."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ascending
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # voter of each term or -1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_PATTERNS))
    bias: float = -np.inf
    voters: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, input)`` pairs of the texts, each once: terms they hold, then patterns they match."""
        words = _words(texts)
        hashes, doc = _terms(texts, words)
        n = len(words[1])
        pattern = np.nonzero(_patterns(texts, hashes[:n], doc[:n], words[2]))
        if not hasattr(self, "_filter"):
            self._filter = np.zeros(1 << 20, bool)
            self._filter[self.terms & (2**20 - 1)] = True
        met = self._filter[hashes & (2**20 - 1)]
        hashes, doc = hashes[met], doc[met]
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        right = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        pair = np.unique(doc[right] * max(len(self.terms), 1) + at[right])
        doc, term = pair // max(len(self.terms), 1), pair % max(len(self.terms), 1)
        return np.concatenate([doc, pattern[0]]), np.concatenate([term, len(self.terms) + pattern[1]])

    def masks(self, texts: list[str], inputs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        doc, term = inputs or self.inputs(texts)
        voter = np.concatenate([self.lexicon, LEXICONS + np.arange(N_PATTERNS)])[term]
        out = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(out, doc[voter >= 0], np.int64(1) << voter[voter >= 0])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.zeros(len(texts))
        doc, term = self.inputs(texts)
        z = self.bias + np.bincount(doc, weights=self.weights[term], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _votes(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(LEXICONS + N_PATTERNS)) & 1 == 1


def _log_odds(votes: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    fired, silent = np.log(p["toxic"] / p["clean"]), np.log((1 - p["toxic"]) / (1 - p["clean"]))
    return np.log(p["share"] / (1 - p["share"])) + votes @ (p["weight"] * (fired - silent)) + (p["weight"] * silent).sum()


def _batches(rows: DataFrame, schema: str, kernel) -> DataFrame:
    """``kernel(texts, part)`` over slices of column ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                part = batch.slice(i, j - i)
                yield kernel(part.column("body").to_pylist(), part)

    return rows.mapInArrow(run, schema)


def _term_counts(rows: DataFrame, wanted: bytes | None) -> DataFrame:
    """``term, n, toxic``: labelled documents, and toxic ones, that hold a (wanted) term."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def kernel(texts: list[str], part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, doc = _terms(texts)
        if shared.value is not None:
            bits = np.frombuffer(shared.value, np.uint8)
            at = hashes % BITS
            met = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hashes, doc = hashes[met], doc[met]
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        term, first, n = np.unique(hashes, return_index=True, return_counts=True)
        bad = np.add.reduceat(toxic, first) if len(first) else toxic
        return pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], ["term", "n", "toxic"])

    counts = _batches(rows.select("body", "toxic"), "term long, n long, toxic long", kernel)
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _choose_terms(labelled: DataFrame, n_toxic: int, n_clean: int, features: int) -> Model:
    frequent = _term_counts(labelled.where("toxic = 1"), None).where(F.col("toxic") >= MIN_TOXIC)
    counts = _term_counts(labelled, bit_map(frequent, "term", BITS)).where(F.col("toxic") >= MIN_TOXIC)
    rate = F.col("n") / F.lit(float(n_toxic + n_clean))
    gap = F.col("toxic") / F.lit(float(n_toxic)) - (F.col("n") - F.col("toxic")) / F.lit(float(n_clean))
    z = gap / F.sqrt(rate * (1 - rate + F.lit(1e-6)) * F.lit(1 / n_toxic + 1 / n_clean))
    scored = counts.select("term", z.alias("z"), (F.col("toxic") / F.col("n")).alias("precision"))
    top = scored.orderBy(F.col("z").desc(), "term").limit(features * 3 // 4).collect()
    low = scored.where("z < 0").orderBy("z", "term").limit(features // 4).collect()
    chosen = sorted({r["term"]: r for r in [*top, *low]}.values(), key=lambda r: r["term"])
    voter = {r["term"]: k % LEXICONS for k, r in enumerate(r for r in top if r["z"] > 3 and r["precision"] > 0.5)}
    return Model(
        terms=np.array([r["term"] for r in chosen], np.int64),
        lexicon=np.array([voter.get(r["term"], -1) for r in chosen], np.int64),
        weights=np.zeros(len(chosen) + N_PATTERNS),
    )


def _moments(counts: DataFrame, p: dict[str, np.ndarray], second: bool) -> np.ndarray:
    """Posterior-weighted sums over all mask counts: class sizes, firings, and (``second``) joint firings per class."""
    v = LEXICONS + N_PATTERNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * v + (2 * v * v if second else 0))
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            votes = _votes(batch.column("mask").to_numpy(zero_copy_only=False))
            posterior = 1 / (1 + np.exp(-np.clip(_log_odds(votes, p), -60, 60)))
            for k, w in enumerate((n * posterior, n * (1 - posterior))):
                total[k] += w.sum()
                total[2 + k * v : 2 + (k + 1) * v] += w @ votes
                if second:
                    total[2 + 2 * v + k * v * v : 2 + 2 * v + (k + 1) * v * v] += ((votes * w[:, None]).T @ votes).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    summed = counts.mapInArrow(run, "s array<double>").selectExpr("posexplode(s) AS (i, x)").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(2 + 2 * v + (2 * v * v if second else 0))
    for r in summed.collect():
        out[r["i"]] = r["x"]
    return out


def _label_model(counts: DataFrame, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """EM for the voters' firing rates; correlations thin out the evidence of voters that repeat each other."""
    v, p = LEXICONS + N_PATTERNS, start
    for round_ in range(2):
        for _ in range(EM_ROUNDS // 2):
            s = _moments(counts, p, False)
            size = s[:2]
            if size.sum() == 0:
                return p
            # a prior worth 2 % of the corpus holds the rates near those of the labelled rows
            prior = 0.02 * size.sum()
            rate = {k: (s[2 + i * v : 2 + (i + 1) * v] + prior * start[k]) / (size[i] + prior) for i, k in enumerate(("toxic", "clean"))}
            p = p | {k: np.clip(r, 1e-4, 1 - 1e-4) for k, r in rate.items()}
            p["share"] = np.clip((size[0] + prior * start["share"]) / (size.sum() + prior), 1e-4, 1 - 1e-4)
        if round_ == 0:
            s = _moments(counts, p, True)
            worst = np.zeros((v, v))
            for i in (0, 1):
                n = max(s[i], 1e-9)
                mean = s[2 + i * v : 2 + (i + 1) * v] / n
                joint = s[2 + 2 * v + i * v * v : 2 + 2 * v + (i + 1) * v * v].reshape(v, v) / n
                spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
                worst += 0.5 * np.maximum((joint - mean[:, None] * mean[None, :]) / (spread[:, None] * spread[None, :]), 0)
            np.fill_diagonal(worst, 0)
            p["correlation"] = worst
            p["weight"] = 1 / (1 + worst.sum(1))
    return p


def _fit(model: Model, inputs: list[np.ndarray], target: np.ndarray, rounds: int = 300, penalty: float = 1e-5) -> None:
    """Logistic regression on soft labels (Adam on the full bounded sample)."""
    n, size = len(inputs), len(model.weights)
    lengths = np.fromiter(map(len, inputs), np.int64, n)
    flat = np.concatenate(inputs) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), lengths)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(target.mean() / (1 - target.mean()))
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, weights=w[flat], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        grad = np.append(np.bincount(flat, weights=error[row], minlength=size) / n + penalty * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    labelled_rows: int = LABELLED, fit_rows: int = FIT_ROWS, features: int = FEATURES,
) -> Model:
    """A model learned from training labels and the votes of all documents."""
    spark = configure(docs.sparkSession)
    gold = (
        labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1) & in_training(doc_id))
        .groupBy(F.col(doc_id).alias("labelled_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(labelled_rows)
    )
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    with scratch(spark) as store:
        # at most ``labelled_rows`` rows: a broadcast of known size
        labelled = store(docs.select(F.col(doc_id).alias("id"), body).join(F.broadcast(gold), F.col("id") == F.col("labelled_id")).select("body", "toxic"))
        seen = dict(labelled.groupBy("toxic").count().collect())
        if not seen.get(0) or not seen.get(1):
            return Model()
        model = _choose_terms(labelled, seen[1], seen[0], features)
        shared = spark.sparkContext.broadcast(model)

        def masks(texts: list[str], part: pa.RecordBatch) -> pa.RecordBatch:
            mask, n = np.unique(shared.value.masks(texts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(mask, pa.int64()), pa.array(n, pa.int64())], ["mask", "n"])

        def examples(texts: list[str], part: pa.RecordBatch) -> pa.RecordBatch:
            doc, term = shared.value.inputs(texts)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(1, len(texts)))
            lists = [x.astype(np.int16).tobytes() for x in np.split(term[order], cut)]
            return pa.RecordBatch.from_arrays(
                [pa.array(shared.value.masks(texts, (doc, term))), pa.array(lists, pa.binary()), part.column("toxic")], ["mask", "terms", "toxic"]
            )

        every = docs.select(F.col(doc_id).alias("id"), body)
        counts = store(_batches(every.select("body"), "mask long, n long", masks).groupBy("mask").agg(F.sum("n").alias("n")))
        total = counts.agg(F.sum("n")).first()[0]
        share = int(min(1.0, fit_rows / max(total, 1)) * 1_000_000)
        # id and text pick the row, so copies of one text are picked one by one
        others = every.where(F.pmod(F.xxhash64("id", "body"), F.lit(1_000_000)) < share).select("body", F.lit(None).cast("int").alias("toxic"))
        fit = _batches(labelled.unionByName(others), "mask long, terms binary, toxic int", examples).collect()
        votes = _votes(np.array([r["mask"] for r in fit], np.int64))
        known = np.array([-1 if r["toxic"] is None else r["toxic"] for r in fit])
        rate = lambda y: np.clip((votes[known == y].sum(0) + 0.5) / ((known == y).sum() + 1), 1e-4, 1 - 1e-4)
        model.voters = _label_model(counts, {
            "toxic": rate(1), "clean": rate(0), "weight": np.ones(votes.shape[1]),
            "share": np.clip((known == 1).sum() / (known >= 0).sum(), 1e-3, 1 - 1e-3),
        })
    odds = _log_odds(votes, model.voters) + GOLD * (known == 1) - GOLD * (known == 0)
    _fit(model, [np.frombuffer(r["terms"], np.int16).astype(np.int64) for r in fit], 1 / (1 + np.exp(-np.clip(odds, -60, 60))))
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) of ``docs`` plus ``score`` (0 to 1)."""
    configure(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])

    def kernel(texts: list[str], part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.scores(texts))], ["row", "score"])

    return _batches(rows, out, kernel).select(*[F.col("row")[c].alias(c) for c in keep], "score")
