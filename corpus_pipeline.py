"""Preparing a corpus in five stages, from the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, doc_id, text, lang, source and n_chars.  run()
writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, nearcopies, queries, substring, toxicity, workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text is predicted to be toxic.

    A row is judged by its text, whatever its id: rows without an id, rows that
    repeat, and rows that share an id are judged one by one.  Null and empty
    texts have the score of the base rate and stay.
    """
    model = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 or more of the 5-word shingles of two texts are common to both.

    Candidates come from SimHash under covering masks and, for texts whose
    fingerprints are further apart, from minhash; all are checked exactly.
    That with the smallest id stays, one without an id only where no other has
    one; of rows that repeat id and text one stays.  Null and empty texts are
    copies of each other.
    """
    return nearcopies.one_of_each(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; others stay as they are.

    All rows stay, also those whose whole text is struck (empty then) or was
    null; rows that repeat strike each other.  n_chars follows the text.
    """
    found = substring.remove_repeats(docs, carry=("text", "lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(F.col("kept"))
    return found.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a benchmark window, judged row by row by their text; null and empty texts stay."""
    found = decontam.find(docs, queries.table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number, and digests of the ids and of the text decoded from them; null texts have none."""
    return bpe.round_trip_digests(docs, queries.vocabulary(queries.BYTE_BPE), keep_ids=True)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("repeated passages", passages), ("decontamination", decontaminated), ("BPE encoding", encoded)]

#: SQL has neither the learned grammar nor the fingerprints and minhash of near duplicates nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = workspace.written(docs, f"stage-{i}")
    return docs
