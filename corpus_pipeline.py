"""The training-data pipeline: language ID, near duplicates, decontamination, personal data, packing.

Each stage reads what the one before has written and works on all of it. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.decontamination import decontaminate
from folioscan.llm.jaccard import one_of_each
from folioscan.llm.language import UNKNOWN, identify
from folioscan.llm.packing import pack_documents
from folioscan.llm.queries import vocabulary
from folioscan.llm.rows import DOCUMENTS, read, written
from folioscan.llm.surrogates import replace_entities

# SQL expresses neither the automata nor the tokenizer.
ORACLE_SQL = None


def of_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go; the models learn from the documents that have a label.

    These are the documents without text or letters: a text in a language that no sample holds stays, under the nearest
    language, and where no labelled document has letters, so that there is no model, all documents with letters stay.
    """
    return identify(docs, docs, keep=F.col("lang_pred") != UNKNOWN, untrained="mis").select(*DOCUMENTS)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, similarity 0.8) the document with the smallest id stays; of repeated rows one.

    Null texts and texts without words all stay; in a class with null ids the smallest id that is not null stays.
    """
    return one_of_each(docs).select(*DOCUMENTS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more stands in a test item go; all others stay as they are.

    A null or empty text has no words and stays; each repeated row is judged alike; null items hold nothing.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), mode="documents").select(*DOCUMENTS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates stand for personal data; ``n_chars`` follows the text where it has changed.

    Null and empty texts stay as they are; repeated rows get the same text each.
    """
    kind = docs.schema["n_chars"].dataType
    out = replace_entities(docs)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; a null or empty text is its end id, a repeated row its own document."""
    return pack_documents(docs, vocabulary(), ids=False)


STAGES = [
    ("language ID", of_a_language),
    ("near duplicates", one_per_class),
    ("decontamination", clean_of_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{k}") if k < len(STAGES) - 1 else out
    return docs
