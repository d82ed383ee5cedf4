"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes any columns beside ``doc_id`` and ``text`` and works on all
rows its predecessor kept. The first four return the columns of documents; the
last adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``round_trip``
(the ids decode to the text), in place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe, decontamination, quality_rules, secrets, simhash
from daybook.llm.queries import table, vocabulary
from daybook.llm.store import cut, prepare

#: The SQL for run()'s rows: none, as edit distances, SimHash and BPE ids have no SQL form; see tests/llm.
ORACLE_SQL: str | None = None

NEW = ("n_tokens", "ids", "round_trip")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near-duplicates."""
    prepare(spark)
    return simhash.keep_first(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific credentials masked in their texts."""
    prepare(spark)
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    prepare(spark)
    carry = [c for c in docs.columns if c not in NEW]
    found = bpe.encode(docs, vocabulary(), carry, decoded="_decoded")
    return found.select(*carry, "n_tokens", "ids", (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
