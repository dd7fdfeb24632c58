"""Quality rules with risk-controlled thresholds (DataFrame and SQL functions only).

Words are runs of anything but ASCII white space. Each text is measured once (word
and symbol counts, repeated lines, words inside 8-word windows that the text has twice or more).
Fixed base rules reject a text; the method's rules reject more, by thresholds that
are learned per stratum under a guarantee:

* Fitting rows (half of the labelled rows, by a hash of their id) propose, per
  stratum and rule, a path of ``LEVELS`` thresholds from lenient to strict: quantiles of the
  good rows that pass the base rules. A rule takes part in a level only if, on the fitting rows, it rejects
  low-quality rows at least ``GAIN`` times as often as good ones.
* Holdout rows (the other half) test the levels. With ``k`` of ``n`` good holdout rows
  rejected by all rules of a level together, the exact binomial test asks whether a
  false rejection share above ``risk`` is ruled out: ``P(Binomial(n, risk) <= k) <= error / strata``,
  which is the Clopper-Pearson upper bound lying at or below ``risk``.
* Multiple testing. Within a stratum levels are tested in order up to the first that
  fails (fixed sequence, which needs no further correction); strata share ``error``
  evenly (Bonferroni). With probability ``1 - error`` or more, no stratum loses a share
  above ``risk`` of its good rows to the learned rules. A stratum with too few holdout rows for any
  level gets none, so nothing but the base rules rejects there.

Exactness. Repeated windows are found by hash and then compared by their words.
The binomial sum runs in logarithms over ``k + 1`` terms of a table with one row per stratum and level.

A stratum or a single row may be large: texts stay in their row, strata meet in
counts that are combined on the map side, and the thresholds are joined back by
broadcast only if there are at most ``BROADCAST_STRATA`` strata, else by a salted join.

Defined results: NULL and empty texts have no words and fail the base rules; NULL
strata are a stratum of their own; rows that repeat an id are judged one by one, and
if such an id has a label each of its rows counts as labelled; labels that repeat an id count once (the least quality); labels
without a text or with NULL quality are ignored; no labels or an empty table give
no thresholds; extra columns are kept (``keep``), the operator's own replace inputs of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, kept_table, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
RISK, ERROR = 0.01, 0.05
GAIN = 3.0
# Shares of good fitting rows beyond a rule's threshold, from lenient to strict.
LEVELS = (0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03)
BROADCAST_STRATA = 10_000
SALTS = 64

# Rule -> the measured value that is too high beyond its threshold.
RULES = {
    "few_words": "-n_words",
    "short_words": "-word_chars / n_words",
    "long_words": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(pairs: Column) -> Column:
    """Places ``i`` of an array of ``struct<k, i>`` whose ``k`` stands in it twice or more."""
    by_key = F.sort_array(pairs)
    next_ = F.zip_with(by_key, F.slice(by_key, F.lit(2), F.size(pairs)), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), F.slice(next_, F.lit(1), F.size(pairs) - 1))
    either = F.zip_with(next_, before, lambda a, b: a | b)
    return F.array_compact(F.zip_with(by_key, either, lambda x, e: F.when(e, x["i"])))


def measured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus the columns ``MEASURES`` of ``text``."""
    body, words, grams = F.col("_body"), F.col("_words"), F.col("_grams")
    rows = rows.withColumn("_body", text_or_empty(text))
    rows = rows.withColumn("_words", F.array_remove(F.split("_body", r"[\x20\x09-\x0D]+", -1), ""))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
        "_lines": F.filter(F.split(body, "\n", -1), lambda x: F.length(F.ltrim(x, F.lit(SPACE))) > 0),
        "_grams": F.transform(words, lambda w: F.xxhash64(w)),
    })
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines", "_body")
    # hashes of 2, 4 and 8 words in a row, each from two of the size before
    for k in (1, 2, 4):
        rows = rows.withColumn("_grams", F.zip_with(grams, F.slice(grams, F.lit(k + 1), F.size(grams)), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("_grams", F.when(F.col("n_words") >= WINDOW, F.slice(grams, F.lit(1), F.size(grams) - (WINDOW - 1))))
    # most texts repeat nothing; the others are looked at by place
    rows = rows.withColumn("_maybe", F.when(
        F.size(F.array_distinct(grams)) < F.size(grams), _repeated(F.transform(grams, lambda g, i: F.struct(g.alias("k"), i.alias("i"))))
    )).drop("_grams")
    rows = rows.withColumn("_texts", F.transform(
        "_maybe", lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("k"), i.alias("i"))
    )).drop("_maybe", "_words")
    rows = rows.withColumn("_at", F.when(F.size("_texts") > 0, F.sort_array(_repeated(F.col("_texts"))))).drop("_texts")
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", F.lit(2), F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda x, y: x + y,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_at") > 0, covered), F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """``P(Binomial(n, p) <= k)``, summed in logarithms from the largest of the terms 0 .. k, the last one."""
    odds = F.log(F.lit(p / (1 - p)))
    # the terms' logarithms, less that of the first
    upto = F.aggregate(
        F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("log"), F.lit(float("-inf")).alias("sum")),
        lambda acc, j: F.struct(
            (acc["log"] + F.when(j < k, F.log((n - j) / (j + 1)) + odds).otherwise(0.0)).alias("log"),
            (F.greatest(acc["sum"], acc["log"]) + F.log1p(F.exp(-F.abs(F.when(acc["sum"] == float("-inf"), F.lit(float("inf"))).otherwise(acc["sum"] - acc["log"]))))).alias("sum"),
        ),
    )["sum"]
    return F.least(F.lit(1.0), F.exp(upto + n * F.log(F.lit(1 - p))))


def certified(k: Column, n: Column, risk: float, error: Column) -> Column:
    """Whether ``k`` of ``n`` rule out a share above ``risk`` at ``error``. From ``k >= n * risk`` on, the sum is at least about a half."""
    return F.when(k >= F.ceil(n * risk), F.lit(False)).otherwise(binomial_cdf(k.cast("int"), n, risk) <= error)


def _by_stratum(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined (left) to ``table``, one row per ``stratum``: by broadcast behind a count, else salted."""
    table = table.withColumnRenamed("stratum", "_stratum")
    if len(table.select("_stratum").take(BROADCAST_STRATA + 1)) <= BROADCAST_STRATA:
        return rows.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_spread", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(
        salted, F.col("stratum").eqNullSafe(F.col("_stratum")) & (F.col("_spread") == F.col("_salt")), "left"
    ).drop("_stratum", "_salt", "_spread")


def _values() -> Column:
    """The rules' measured values as an array in the order of ``RULES`` (texts without words fail the base rules)."""
    return F.array(*[F.expr(f"CAST({v.replace('/ n_words', '/ greatest(n_words, 1)')} AS double)") for v in RULES.values()])


def fitting(doc: str) -> Column:
    """Half of the labelled rows, by a hash of their id: they propose thresholds, the other half tests them."""
    return F.substring(F.sha2(F.col(doc).cast("string").cast("binary"), 256), 1, 1) < "8"


def thresholds(judged: DataFrame, *, risk: float = RISK, error: float = ERROR, levels: tuple = LEVELS) -> DataFrame:
    """``stratum, level, tests, n, k, cutoffs array<double>, p_value`` from labelled rows ``doc, stratum, good, vals``.

    One row per stratum with a certified level: the last one; ``cutoffs`` in the order of
    ``RULES`` (NULL for a rule that does not take part), ``n`` good holdout rows, ``k`` of them rejected,
    ``p_value`` the exact binomial probability.
    """
    n_rules = len(RULES)
    rows = judged.withColumn("fits", fitting("doc"))
    shares = F.array(*[F.lit(1 - x) for x in levels])
    path = rows.where("fits AND good").groupBy("stratum").agg(
        F.array(*[F.percentile_approx(F.col("vals")[r], shares, F.lit(10_000)) for r in range(n_rules)]).alias("path")
    )
    path = kept_table(path)
    placed = kept_table(_by_stratum(rows, path, "doc").where("path IS NOT NULL"))
    # per row and rule: the first level whose threshold the value is beyond (levels only get stricter)
    first = F.transform(
        F.col("path"), lambda p, r: F.coalesce(F.array_position(F.transform(p, lambda c: F.get(F.col("vals"), r) > c), True), F.lit(0)).cast("int")
    )
    fitted = placed.where("fits").select("stratum", "good", F.posexplode(first).alias("rule", "at"))
    met = fitted.groupBy("stratum", "rule").agg(
        F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads"),
        *[F.count_if(F.col("good") & (F.col("at") > 0) & (F.col("at") <= t + 1)).alias(f"g{t}") for t in range(len(levels))],
        *[F.count_if(~F.col("good") & (F.col("at") > 0) & (F.col("at") <= t + 1)).alias(f"b{t}") for t in range(len(levels))],
    )
    useful = lambda t: F.col(f"b{t}") * F.greatest("goods", F.lit(1)) > GAIN * F.greatest(f"g{t}", F.lit(1)) * F.greatest("bads", F.lit(1))
    chosen = met.select("stratum", "rule", F.array(*[useful(t) for t in range(len(levels))]).alias("use"))
    chosen = chosen.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "use"))), lambda x: x["use"]).alias("use"))
    plan = kept_table(path.join(chosen, path.stratum.eqNullSafe(chosen.stratum)).select(path.stratum, F.transform(
        F.sequence(F.lit(0), F.lit(len(levels) - 1)),
        lambda t: F.zip_with("path", "use", lambda p, u: F.when(F.get(u, t), F.get(p, t))),
    ).alias("plan")))
    held = _by_stratum(placed.where("NOT fits AND good").select("doc", "stratum", "vals"), plan, "doc").where("plan IS NOT NULL")
    beyond = F.transform("plan", lambda cuts: rejected(F.col("vals"), cuts))
    tested = held.select("stratum", F.posexplode(beyond).alias("level", "gone")).groupBy("stratum", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("k")
    )
    tested = kept_table(tested)
    # the correction counts every stratum that is tested
    tests = tested.select("stratum").distinct().count()
    share = F.lit(error / max(tests, 1))
    passed = tested.withColumn("ok", certified(F.col("k"), F.col("n"), risk, share))
    in_order = Window.partitionBy("stratum").orderBy("level")
    kept = passed.withColumn("ok", F.min("ok").over(in_order)).where("ok").groupBy("stratum").agg(F.max_by(F.struct("level", "n", "k"), "level").alias("x"))
    kept = kept.withColumnRenamed("stratum", "s").select("s", "x.*")
    return kept.join(plan, kept.s.eqNullSafe(plan.stratum)).select(
        "stratum", "level", F.lit(tests).alias("tests"), "n", "k", F.get("plan", F.col("level")).alias("cutoffs"),
        binomial_cdf(F.col("k").cast("int"), F.col("n"), risk).alias("p_value"),
    )


def rejected(values: Column, cutoffs: Column) -> Column:
    """Whether a value is beyond its threshold."""
    return F.exists(F.zip_with(values, cutoffs, lambda v, c: F.coalesce(v > c, F.lit(False))), lambda x: x)


def apply(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", strata: str = "lang", label_id: str = "doc_id", quality: str = "quality",
    keep: list[str] | None = None, risk: float = RISK, error: float = ERROR, levels: tuple = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Columns ``keep`` (default all) of ``docs`` plus the measures, ``base_failed`` and ``kept``; and the thresholds used."""
    configure(docs.sparkSession)
    own = [*MEASURES, "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(doc_id).alias("doc"), F.col(strata).alias("stratum"), F.col(text).alias("text")
    )
    # texts are read once; everything after works on their measures
    table = kept_table(measured(rows, "text").drop("text").withColumn("base_failed", base_failed()).withColumn("vals", _values()))
    good = labels.where(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_doc")).agg((F.min(quality) == 1).alias("good"))
    labelled = table.where("NOT base_failed").select("doc", "stratum", "vals").join(good, F.col("doc") == F.col("label_doc")).select("doc", "stratum", "good", "vals")
    limits = kept_table(thresholds(labelled, risk=risk, error=error, levels=levels))
    judged = _by_stratum(table, limits.select("stratum", "cutoffs"), "doc").withColumn(
        "kept", ~F.col("base_failed") & ~F.when(F.col("cutoffs").isNotNull(), rejected(F.col("vals"), F.col("cutoffs"))).otherwise(F.lit(False))
    )
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], *own), limits
