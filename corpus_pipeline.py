"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept; `run` writes its rows as
Parquet in the shared folder and rereads them as the next stage's documents. A
lost executor thus costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerwatch.llm import exact, mixing, packing, quality, simhash
from peerwatch.llm.common import table
from peerwatch.sources.staging import folder, run_folder, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels teach it; they decide no document."""
    return quality.fit(docs, table(spark, sf_dir, "labels")).keep(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per distinct text: that with the largest id."""
    return exact.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate component of the SimHash operator, as its query links them: that with the smallest id."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows, one row per piece of a document, with the piece's ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = folder(spark)
    for name, step in STAGES:
        with run_folder(spark):  # what a stage stages for itself goes once its rows are written
            docs = stage(step(spark, docs, sf_dir), name, into=kept)
    return docs


#: The classifier, the fingerprints and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
