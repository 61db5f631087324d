"""A corpus pipeline in four stages: toxicity, near duplicates, benchmark passages, SentencePiece pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilens.llm import decontamination, sentencepiece, simhash, toxicity
from perilens.llm.shared import drop_folder, shared_folder, table

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a field learned from the training labels scores below TOXIC."""
    field = toxicity.fit(docs, toxicity.training(table(spark, sf_dir, "labels")))
    scored = toxicity.toxicity(docs, field)
    return scored.where(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the least doc_id.

    Operator 2's links, SimHash fingerprints within two bits found in BK-trees, and of what those don't reach texts whose runs of five
    words have a similarity of 0.8; a group is what both kinds connect. Rows are told apart by id and text: of rows that repeat an id,
    or have none, the right one stays.
    """
    return simhash.distinct_documents(docs, width=5, similarity=0.8, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item with a containment of 0.8 or more, each row by its own text."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their SentencePiece ids, decoded again: ``round_trip`` tells whether the text came back.

    It doesn't where a text holds a U+2581, which comes back as a space; a null text has null ids and counts as back. All columns of
    the documents stay, but for those of the names that the stage gives.
    """
    both = sentencepiece.encode(docs, decoded_col="decoded")
    return both.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: The stages learn, hash and search in ways that SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, then dropped when the next are there."""
    import uuid

    folder = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            drop_folder(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
