"""A training corpus from `documents` in five stages, each of them one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. The tables that an operator writes for itself are released when
the next stage begins, unless its docs still read them. All but the last return the columns of `documents`.

Cases, in every stage: null ids and sources, null, empty and blank texts, repeated rows, empty tables
and further columns of any name are taken as the stage's operator says. Texts without words are
rejected by the classifier. The last stage returns doc_id and digests alone.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, line_dedup, mixing, resampling, similarity
from attesta.llm.tables import fresh, made, read, release, written

#: Tables that the stage before has written for itself.
_before: list[str] = []


def _stage(run):
    """A stage that first releases what the one before has written for itself, unless docs still reads it."""

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _before, docs)
        so_far = len(made(spark))
        out = run(spark, docs, sf_dir)
        _before[:] = made(spark, so_far)
        return out

    return staged


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labels; rejected documents go."""
    return resampling.keep(docs, read(spark, sf_dir, "labels"))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text."""
    lines, dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    out = line_dedup.drop_boilerplate(docs, n_lines_col=lines, n_dropped_col=dropped)
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, one stays."""
    return similarity.drop_near_duplicates(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands in it as often as the mix passes over its words."""
    return mixing.mixed_documents(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts and their round trip, as digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: The classifier and the tokenizer are not SQL; tests compare stages with plain versions, and run() with the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage_{i}")
    return docs
