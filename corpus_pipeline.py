"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

Every stage is one operator of ``millrace.llm``: texts whose language can't be told go, boilerplate lines go
from what is left, one document of each group of near copies stays, documents in which a benchmark
passage occurs go, and the rest is packed into training sequences.

Defined results: a null or empty text, or one without a letter, goes with the first stage; one that line dedup empties
stays as an empty text, once.  Rows without an id and rows that share one are told apart by their texts
until packing.  Repeated rows become one.  Extra columns are carried to the last stage.  Empty documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import catalog, decontam, langid, linededup, neardup, pack
from millrace.llm._scratch import written

#: Least probability at which a document's language counts as told.
LANGUAGE_LEAST = 0.3
#: A document goes if windows of so many benchmark items occur in it.
LEAKED_ITEMS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is told with ``LANGUAGE_LEAST`` probability."""
    return langid.accepted(docs, least=LANGUAGE_LEAST)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; ``n_chars`` follows the text where it changed."""
    return linededup.cleaned(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, that of the least id; texts without anything left are one class."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of ``benchmark`` occurs."""
    return decontam.uncontaminated(docs, catalog.table(spark, sf_dir, "benchmark"), least_items=LEAKED_ITEMS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence."""
    return pack.pack(docs, catalog.tokenizer_path())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: Language ID, MinHash and packing are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
