"""Training-data pipeline over ``documents``: five stages, each one of the ``eventscope.llm`` operators.

======================  ===========================================================================
stage                   decision
======================  ===========================================================================
toxicity                documents scored 0.5 or more go
line_dedup              later repeats of runs of 50 words or more are cut out; a document that
                        loses all its lines goes
near_dedup              of documents linked at a Jaccard similarity of 0.8 on five-word shingles
                        the one with the smallest id of each group stays
decontamination         words inside benchmark windows are cut out; a document made of nothing
                        else goes
bpe                     token ids of each text, decoded again as a check
======================  ===========================================================================

All but the last stage return the columns of ``documents``, ``n_chars`` kept up to date.
Between stages the table is written as Parquet to the shared folder and read
again. SQL cannot express the classifier or the encoder, so there is no SQL
counterpart; tests compare the stages with brute-force versions.

Defined results: a NULL or empty text scores 0 and passes every stage unchanged (NULL
stays NULL up to the last stage, which encodes it as no tokens); texts of any length are worked on
whole; rows that repeat id and text fall together in the near-duplicate stage and each of them stays if
theirs is the smallest id of its group; a NULL id is never the smallest beside another one; an empty
table gives an empty result; extra columns are kept up to the last stage, which returns its own
only (one that is named like an operator's result, such as ``kept`` or ``spans``, holds that result from
its stage on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.llm import bpe, decontamination, line_dedup, minhash_dedup
from eventscope.llm import toxicity as toxicity_model
from eventscope.llm.common import kept_table, read, scratch
from eventscope.llm.queries import vocabulary_path


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` counted anew."""
    chars = F.length("text").cast("long")
    return changed.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_model.score(docs.select(F.struct("*").alias("doc"), "text"), model)
    return scored.where("score < 0.5").select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs)
    return _with_text(docs, cut.where("removed_lines = 0 OR removed_lines < n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(docs).where("kept").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find(docs, read(spark, sf_dir, "benchmark"))
    left = found.where("n_hit = 0 OR n_hit < n_words")
    return _with_text(docs, left.withColumn("text", decontamination.remove_spans(F.col("text"), F.col("spans"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, vocabulary_path(), decoded=True)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch(spark) as store:
        for _, stage in STAGES[:-1]:
            docs = store(stage(spark, docs, sf_dir))
        return kept_table(STAGES[-1][1](spark, docs, sf_dir))
