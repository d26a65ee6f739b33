"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm.dart_minhash import keep_one_of_each
from jobscope.llm.decontamination import remove_contaminated
from jobscope.llm.packing import pack_documents
from jobscope.llm.pii import replace_private
from jobscope.llm.toxicity import fit_toxicity, remove_toxic
from jobscope.llm.workspace import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts toxic go. It learns from the rows of ``docs`` that have labels.

    Null and empty texts are scored as texts without words, long ones whole; repeated rows share a fate. All columns stay, whatever
    their names; nulls in them don't matter. An empty table stays empty; without labels of both kinds nothing is learned.
    """
    return remove_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest doc_id (a null id comes last).

    Rows with null texts all stay; of texts without a word, exact copies are one class. Of rows that repeat an id and its text one
    stays, unlike texts under one id all do. Texts are compared whole. All columns stay; an empty table stays empty.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go.

    Null and empty texts contain none and stay, null and empty items are in none; long texts are read whole; repeated rows share a
    fate. All columns stay; an empty table, of documents or of items, takes nothing away.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; personal data in their texts is replaced by pseudonyms, and n_chars follows.

    The key is the session's (``spark.jobscope.pseudonym.key``); without one a published key is taken, with a warning. Null and empty texts
    stay as they are, long ones are read whole, repeated rows give equal rows. All other columns pass unread.
    """
    return replace_private(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece, its end id; only texts over a sequence's length are cut; repeated rows are packed once
    each. Columns but doc_id and text aren't read; an empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The trained, hashed and tokenizing stages can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
