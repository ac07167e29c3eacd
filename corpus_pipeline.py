"""A training corpus from raw documents: five stages, each one operator of ``etlspec.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlspec.llm import decontaminate, lines, packing, quality, simhash
from etlspec.llm.common import forget, stored
from etlspec.llm.queries import table, word_tokenizer

#: A document goes if its probability of good quality is below this.
LEAST_QUALITY = 0.3
#: Documents are near copies if their fingerprints differ in so many bits at most, or their shingles are that similar.
NEAR_BITS, NEAR_SIMILARITY = 3, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from the labelled documents among ``docs``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, score_col="_quality")
    return scored.where(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the boilerplate lines of each source out of its documents; ``n_chars`` follows the text."""
    clean = lines.dedup_lines(docs, dropped_col="_dropped")
    n_chars = F.when(F.col("_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).drop("_dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, by fingerprints and sketches of five-word shingles."""
    return simhash.keep_one(docs, shingle_words=5, max_bits=NEAR_BITS, similarity=NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of ten words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 4,096."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_tokens),
]
#: SQL can express neither the classifier nor fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in shared storage until the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
