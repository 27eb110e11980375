"""A corpus from documents to the mix: five operators, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns the
mix, one row per document taken. The filters judge each row where it stands; only near-duplicates join their verdict by
doc_id, so there a document goes if any of the rows that repeat its id does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, mixing, neardup, quality, toxicity
from tidewright.llm.shared import ids_for_join, materialise
from tidewright.session import load


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity network rejects."""
    return toxicity.clean_documents(docs, load(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality rules reject."""
    return quality.good_documents(docs, load(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows with a null id stay."""
    copies = materialise(neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "copies")
    return docs.join(ids_for_join(copies), "doc_id", "left_anti").select(docs.columns)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the benchmark contaminates."""
    return decontaminate.unseen_documents(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size and the words taken, for documents that it takes."""
    return mixing.mix(docs).filter("taken > 0").select("doc_id", "source", "size", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("quality", good),
    ("near_duplicates", single),
    ("decontamination", unseen),
    ("mixing", mixed),
]

#: The trained stages have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read back as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
