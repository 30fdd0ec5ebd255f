"""Documents made ready for training, in five stages.

Each stage takes (session, documents, folder of tables) and returns a DataFrame,
which is written and read again as the next one's documents.  All but the last
return the columns of their documents, whatever else these hold.  In every stage
empty documents give an empty table, texts count whole however long they are, and
rows that repeat another are judged as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolot.llm import decontamination, ngram_join, packing, pii, toxicity
from echolot.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a factorization machine, fitted on the labelled ones among them, doesn't find toxic.

    Null and empty texts and rows with a null id are judged too, by what a text without
    terms scores; without labels of both kinds all stay.  A score that ties with the
    threshold is toxic.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the lowest id, of each group that n-gram Jaccard similarity joins.

    Null and empty texts and rows with a null id stay; rows that repeat an id go or stay together.
    """
    return ngram_join.clean(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no passage of the benchmark; items of a few words are no evidence.  Null and empty texts and rows with a null id stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars counts the new text, and is null for a null text."""
    return pii.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in bins of training sequences' length.  Null and empty texts have no piece; null and repeated ids are packed as others are."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_leaks),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: The model, the banding and message passing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
