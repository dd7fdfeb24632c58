"""Personal data: base patterns plus information-theoretic disclosure of terms.

Base kinds (leftmost, non-overlapping per kind; a match that fails its check is
dropped without retry): ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19
digits, Luhn), ``phone`` (10 to 15 digits). The strings found are the protected
entities.

Terms are all runs of letters, digits and non-ASCII characters, A-Z lowered, that touch
no base span. A term discloses an entity if co-occurrence in the corpus shows that it
points to it; then all its occurrences outside base spans become spans of kind ``term``,
which `sanitise` removes or generalises. Candidates are terms whose documents hold
entities in at least ``min_posterior`` of them. Evidence is counted in distinct texts,
so that copies of one text are one witness.

* Terms of ``FEW + 1`` texts or more speak for themselves. For an entity, ``both`` of the
  term's ``texts`` hold it: the lower Wilson bound of ``both / texts`` must reach
  ``min_posterior``, and the pointwise mutual information ``log2(both * n / (texts *
  with_entity))`` must reach ``min_pmi_bits``. With fewer texts no bound can reach a half.
* Rarer terms are judged by their class: their shape (with a digit, capitalised, other)
  and their distance from the nearest entity in words (1, 2, 3 to 4, 5 to 8). A word
  that stands near an entity by chance is rare as often as words elsewhere are. Of a
  class' occurrences the share of rare terms (in at most ``FEW`` documents) has a lower
  Wilson bound ``L``, and words of the shape farther from any entity are rare with share
  ``p``: of the class' rare terms a share of at least ``1 - p / L`` stands there because of the
  entity. The class discloses if that share reaches ``min_posterior``. Rare terms farther
  than 8 words from every entity are not flagged.

Three passes over the documents: base spans; counts of terms and classes; places of
candidates. Between them term counts move, combined on the map side, and the places of
candidates, once per distinct text. A fixed-size bit map of the candidates (``BITS`` bits,
whatever the corpus) goes to the workers as a first filter; exact joins on the term's
hash decide. Pairs are formed inside a text only of terms and entities that both stand in
several texts.

Defined results: NULL and empty texts have no spans; repeated rows each get
theirs; an empty table gives no rows; extra columns are kept (``spans`` replaces an
input of that name).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, configure, kept_table, staged
from .textops import lowered, run_hashes, slices, utf8

KINDS = ("email", "ip", "card", "phone")
FEW = 2
# Distances in words up to which a class reaches, and the classes of distance 1, 2, ...
REACH = 8
_NEAR = np.array([-1, 0, 1, 2, 2, 3, 3, 3, 3, -1])
SHAPES = 3
BUCKETS = 4
Z_TERM, Z_CLASS = 1.645, 2.576
BITS = 1 << 23

# Fixed patterns of the base kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x30:0x3A] = _IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is a local part up to an ``@`` and a dotted domain: each ``@`` is looked at once."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _hash64(words: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return run_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)


def _base(rows: DataFrame) -> DataFrame:
    """``row, body_key, spans, entities``: base spans, and the distinct entities of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column("body").to_pylist()]
                spans = [base_spans(t) for t in texts]
                entities = [sorted({f"{k}:{t[s:e].translate(_ASCII_LOWER)}" for k, s, e in x}) for t, x in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("body_key"),
                        pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _SPANS_ARROW),
                        pa.array(entities, pa.list_(pa.string())),
                    ],
                    ["row", "body_key", "spans", "entities"],
                )

    out = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("body_key", T.StringType()),
        T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("entities", T.ArrayType(T.StringType())),
    ])
    return rows.mapInArrow(run, out)


_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class _Runs:
    """Terms of some texts outside base spans: byte starts and ends, hashes, text, shape, class (-1: far from any entity)."""

    def __init__(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray):
        inside = _IS_TERM[raw]
        before = np.concatenate([[False], inside[:-1]])
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]])
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.holds, edge, heads = np.zeros(len(texts), bool), np.zeros(len(raw) + 1, np.int32), []
        for k, text in enumerate(texts):
            found = base_spans(text)
            if found:
                self.holds[k] = True
                body = raw[offsets[k] : offsets[k + 1]]
                points = offsets[k] + np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
                np.add.at(edge, points[[s for _, s, _ in found]], 1)
                np.add.at(edge, points[[e for _, _, e in found]], -1)
                heads.append(points[[s for _, s, _ in found]])
        if heads:
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            free = covered[starts] == covered[ends]
            starts, ends = starts[free], ends[free]
        self.starts, self.ends = starts, ends
        self.owner = np.searchsorted(offsets, starts, "right") - 1
        self.hashes = run_hashes(lowered(raw), starts, ends - starts).view(np.int64)
        digits = np.concatenate([[0], np.cumsum((raw >= 0x30) & (raw < 0x3A))])
        capital = (raw[starts] >= 0x41) & (raw[starts] < 0x5B)
        self.shape = np.where(digits[ends] > digits[starts], 0, np.where(capital, 1, 2))
        far = np.full(len(starts), REACH + 1)
        if heads:
            at = np.concatenate(heads)
            text = np.searchsorted(offsets, at, "right") - 1
            place = np.searchsorted(starts, at)  # the first term behind the entity's start
            for d in range(1, REACH + 1):
                for spot in (place - d, place + d - 1):
                    ok = (spot >= 0) & (spot < len(starts))
                    spot, own = spot[ok], text[ok]
                    spot = spot[self.owner[spot] == own]
                    far[spot] = np.minimum(far[spot], d)
        near = _NEAR[far]
        self.cls = np.where(near >= 0, self.shape * BUCKETS + near, -1)


_COUNTS = ["n", "near", *[f"far{s}" for s in range(SHAPES)]]


def _counted(texts: DataFrame) -> DataFrame:
    """``term, cls, n, near, far0, ..``: per term its documents, those with an entity, and its occurrences far from any by shape;
    rows without a term count the occurrences of each class (in ``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                found = _Runs([t or "" for t in batch.column("body").slice(i, j - i).to_pylist()], raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                order = np.lexsort((found.owner, found.hashes))
                owner, hashes = found.owner[order], found.hashes[order]
                away = np.where(found.cls[order] < 0, found.shape[order], -1)
                term, first = np.unique(hashes, return_index=True)
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                total = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)  # noqa: E731, B023
                columns = [total(new), total(new & found.holds[owner]), *[total(away == s) for s in range(SHAPES)]]
                cls, many = np.unique(found.cls[found.cls >= 0], return_counts=True)
                pad = np.zeros(len(cls), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([term, pad]), pa.int64(), mask=np.arange(len(term) + len(cls)) >= len(term)),
                        pa.array(np.concatenate([np.full(len(term), -1), cls]).astype(np.int32)),
                        pa.array(np.concatenate([columns[0], many])), *[pa.array(np.concatenate([c, pad])) for c in columns[1:]],
                    ],
                    ["term", "cls", *_COUNTS],
                )

    schema = "term long, cls int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return texts.select("body").mapInArrow(run, schema).groupBy("term", "cls").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _places(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``body_key, m, near, hits``: where candidates stand, for each distinct text that holds one (``m`` rows have it)."""
    wanted = bit_map(candidates, "term", BITS)
    schema = "body_key string, near boolean, hits array<struct<term:long,start:long,end:long,cls:int>>"
    if not any(wanted):
        return texts.sparkSession.createDataFrame([], schema + ", m long")
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            raw, offs = utf8(batch.column("body"))
            for i, j in slices(offs):
                body, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                part = batch.slice(i, j - i)
                runs = _Runs([t or "" for t in part.column("body").to_pylist()], body, at)
                spot = runs.hashes % BITS
                passed = (bits[spot >> 3] >> (spot & 7)) & 1 == 1
                owner, starts, ends = runs.owner[passed], runs.starts[passed], runs.ends[passed]
                points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                base = points[at[:-1]][owner]
                held, first = np.unique(owner, return_index=True)
                hits = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(owner)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(runs.hashes[passed], pa.int64()), pa.array(points[starts] - base, pa.int64()),
                         pa.array(points[ends] - base, pa.int64()), pa.array(runs.cls[passed].astype(np.int32))],
                        ["term", "start", "end", "cls"],
                    ),
                )
                yield pa.RecordBatch.from_arrays([part.column("body_key").take(pa.array(held)), pa.array(runs.holds[held]), hits], ["body_key", "near", "hits"])

    # equal texts have equal hits, so one list per text is enough
    return texts.mapInArrow(run, schema).groupBy("body_key").agg(F.first("near").alias("near"), F.first("hits").alias("hits"), F.count(F.lit(1)).alias("m"))


def wilson(share: Column, n: Column, z: float) -> Column:
    """Lower bound of a share seen in ``n`` draws."""
    middle, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n)


def _by_themselves(hits: DataFrame, texts_of: DataFrame, entities: DataFrame, n: int, min_posterior: float, min_pmi_bits: float) -> DataFrame:
    """``term``: terms of more than ``FEW`` texts that disclose an entity (``entities``: ``body_key, entity`` per distinct text)."""
    known = entities.join(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")).where("with_entity > 1"), "entity")
    often = texts_of.where(F.col("texts") > FEW)
    held = hits.where("near").select("body_key", F.explode(F.array_distinct("hits.term")).alias("term")).join(often, "term")
    # an entity of fewer texts than the term's share needs cannot reach it
    met = held.join(known, "body_key").where(F.col("with_entity") >= min_posterior * F.col("texts"))
    both = met.groupBy("entity", "term", "texts", "with_entity").agg(F.count(F.lit(1)).alias("both"))
    pmi = F.log2(F.col("both") * F.lit(float(n)) / (F.col("texts") * F.col("with_entity")))
    return both.where((wilson(F.col("both") / F.col("texts"), F.col("texts"), Z_TERM) >= min_posterior) & (pmi >= min_pmi_bits)).select("term").distinct()


def _by_class(hits: DataFrame, texts_of: DataFrame, candidates: DataFrame, counts: DataFrame, min_posterior: float) -> DataFrame:
    """``term``: terms of at most ``FEW`` texts with an occurrence in a class whose rare terms stand there because of entities."""
    away = counts.where("term IS NOT NULL").agg(*[
        ((F.coalesce(F.sum(F.when(F.col("n") <= FEW, F.col(f"far{s}"))), F.lit(0)) + 1) / (F.coalesce(F.sum(f"far{s}"), F.lit(0)) + 2)).alias(f"p{s}")
        for s in range(SHAPES)
    ])
    placed = hits.where("near").select("m", F.explode("hits").alias("h")).select("m", "h.term", "h.cls").where("cls >= 0")
    seen = placed.join(candidates.where(F.col("with_term") <= FEW).select("term"), "term", "left_semi")
    rare = seen.groupBy("cls").agg(F.sum("m").alias("rare")).withColumnRenamed("cls", "c")
    totals = counts.where("term IS NULL").select("cls", F.col("n").alias("all"))
    bound = wilson(F.col("rare") / F.col("all"), F.col("all"), Z_CLASS)
    chance = F.get(F.array(*[F.col(f"p{s}") for s in range(SHAPES)]), F.floor(F.col("cls") / BUCKETS).cast("int"))
    classes = totals.join(rare, F.col("cls") == F.col("c")).crossJoin(F.broadcast(away)).where(chance <= (1 - min_posterior) * bound).select(F.col("cls").alias("c"))
    # as many rows as there are classes
    disclosing = [r.c for r in classes.collect()]
    return placed.where(F.col("cls").isin(disclosing)).select("term").distinct().join(texts_of.where(F.col("texts") <= FEW), "term", "left_semi")


def _term_spans(hits: DataFrame, flagged: DataFrame) -> DataFrame:
    """``body_key, terms``: spans of flagged terms, for each text that holds one."""
    exact = hits.selectExpr("body_key", "inline(hits)").join(flagged.select("term"), "term")
    span = F.struct(F.lit("term").alias("kind"), "start", "end")
    return exact.groupBy("body_key").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def find(
    docs: DataFrame, *, keep: list[str] | None = None, text: str = "text", min_posterior: float = 0.5, min_pmi_bits: float = 1.0,
) -> DataFrame:
    """Columns ``keep`` (default all) of ``docs`` plus ``spans array<struct<kind, start, end>>`` in order of start."""
    configure(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("body"),
        # 128 bits stand for a text
        F.concat_ws(".", F.hex(F.xxhash64(body)), F.hex(F.xxhash64(F.lit(1), body))).alias("body_key"),
    )
    texts = rows.select("body", "body_key")
    base = _base(rows)
    if text in keep:  # texts stay where they are: the short columns alone are kept for the second use
        slim = _base(texts.withColumn("row", F.struct(F.lit(0).alias("z"))))
        entities = staged(slim.where(F.size("entities") > 0).select("body_key", F.explode("entities").alias("entity")).distinct())
    else:
        base = staged(base)
        entities = base.select("body_key", F.explode("entities").alias("entity")).distinct()
    n = texts.select("body_key").distinct().count()
    counts = kept_table(_counted(texts))
    candidates = counts.where("term IS NOT NULL").where((F.col("near") > 0) & (F.col("near") >= min_posterior * F.col("n"))).select("term", F.col("n").alias("with_term"))
    hits = staged(_places(texts, candidates))
    texts_of = staged(
        hits.select(F.explode(F.array_distinct("hits.term")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
        .join(candidates.select("term"), "term", "left_semi")
    )
    flagged = staged(
        _by_themselves(hits, texts_of, entities, n, min_posterior, min_pmi_bits).unionByName(_by_class(hits, texts_of, candidates, counts, min_posterior))
    )
    terms = _term_spans(hits, flagged)
    order = F.array_sort(
        F.transform(
            F.concat("spans", F.coalesce("terms", F.array().cast(T.ArrayType(_SPAN)))),
            lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    spans = F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = base.select("row", "body_key", "spans").join(terms, "body_key", "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in keep], spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(text: Column, spans: Column, *, generalise: bool = True) -> Column:
    """``text`` with its spans replaced by ``[KIND]`` (or removed); of overlapping spans the first wins."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")) if generalise else F.lit(""),
                ).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
