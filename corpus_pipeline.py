"""Corpus pipeline: five stages from raw documents to tokenised training rows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet in the shared checkpoint folder and reread as the next
stage's ``docs``.  All stages but the last keep the columns of ``documents``
(and any extra ones).

Cases (null, empty and very long texts, repeated rows, empty tables, clashing
names) are those of the operators; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from talkframe.llm.tables import documents, prepare, stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the learned decision list."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept(docs, quality_rules.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that five documents share (the largest id keeps them)."""
    prepare(spark)
    out = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8."""
    prepare(spark)
    return ngram_join.representatives(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.encoded(docs).drop("text")


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("source mix", mix), ("BPE", tokens)]

#: The decision list is learned and the tokenizer is a library, so no SQL states
#: the rows; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
