"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, as Parquet, and its decisions take
effect: documents of low quality go, toxic ones go, one of each group of near
duplicates stays, sources are mixed to their target weights, and texts are
encoded.  SQL can't express the learned stages, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostrakon.llm import bpe, cotrain, mixing, partenum, toxicity
from ostrakon.llm.common import materialise, table
from ostrakon.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotrain.kept_documents(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 in shingles of five words."""
    return partenum.deduplicated(docs, 80, 100, 5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass over a document, with the words drawn."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row."""
    return bpe.encoded_corpus(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
