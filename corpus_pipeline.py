"""A training corpus from raw documents: language, quality, repeated lines, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import jaccard_join, language_id, line_dedup, packing, quality
from geolith.llm.common import remove, save, table
from geolith.tables import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects (no letters, or like none of its languages) go."""
    found = language_id.predict(docs, language_id.fit(docs))
    return found.where(~F.col("__rejected")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score below 0.3 go."""
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.where(F.col("__score") >= 0.3).select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    found = line_dedup.line_dedup(docs)
    n_chars = F.when(F.col("__n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked as near copies (80 % of their 5-word shingles) the one with the smallest doc_id stays."""
    gone = jaccard_join.jaccard_components(docs, percent=80, n=5).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone, _ = save(gone, "nearcopies")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", no_near_copies),
    ("best-fit packing", packed),
]

#: SQL can't express the learned stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # a stage's own tables go when it is written, and its input as well
            out, written = save(stage(spark, docs, sf_dir), f"stage{i}", scratch=False)
        if path:
            remove(spark, path)
        docs, path = out, written
    return docs
