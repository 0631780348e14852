"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, cotrain, editprint, htmlcrf, matroska, mixing, partenum, sharding, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: in the folder ``OSTRAKON_TOKENIZERS`` if that is set, else as ``public_tokenizers`` says; the files are never part of the library."""
    folder = os.environ.get("OSTRAKON_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_windows(chat.with_trap(spark, table(spark, sf_dir, "conversations"))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.with_neighbours(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.store(table(spark, sf_dir, "documents")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract_pages(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"), 85, 100, 4)


QUERIES: dict[str, Query] = {
    "op1_matroska": op1_matroska,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_bpe": op7_bpe,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op2_chat": chat.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op10_jaccard_join": partenum.ORACLE_SQL,
}
