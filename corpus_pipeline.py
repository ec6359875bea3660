"""A training corpus from raw documents: quality, dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; the table before it is then deleted.
All but the last return the columns of `documents`.

Defined cases: an empty table passes all stages empty; a null, empty or blank text
fails the quality rules; rows without a doc_id stay through the near-duplicate stage,
as they cannot be named; of repeated rows with one doc_id and text one stays there; a
null source is a source of its own; other columns pass through all stages but the last,
but those named like the columns that an operator adds are not kept apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard, line_dedup, mixing, quality, sentencepiece_scan
from weftline.llm._graph import dropped, quoted, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (operator 6)."""
    field = quality.fit_field(quality.training_chains(docs, table(spark, sf_dir, "labels")))
    return quality.keep_quality(docs, field)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut out of the texts (operator 1)."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 8)."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; documents repeat as often as taken (operator 10)."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids (operator 2): doc_id, source, n_tokens, ids."""
    coded = sentencepiece_scan.encode(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", near_duplicates),
    ("mixing sources", mix),
    ("sentencepiece encoding", tokens),
]
#: SQL cannot express the line labelling, the chunk boundaries or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)  # only the stage that has just been written read it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
