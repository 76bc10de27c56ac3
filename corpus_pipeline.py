"""Corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm._common import materialize
from lumenframe.llm.exact_dedup import drop_exact_copies
from lumenframe.llm.jaccard_join import drop_near_copies
from lumenframe.llm.mixing import select_mixture
from lumenframe.llm.packing import pack
from lumenframe.llm.toxicity import drop_toxic
from lumenframe.shipping import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Share of the tokens left that the mixture takes; no document is taken twice.
MIXTURE_FRACTION = 0.9


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels of the training folds alone are learned from."""
    ship_package(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the document with the smallest id stays."""
    ship_package(spark)
    return drop_exact_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles, the one with the smallest id stays."""
    ship_package(spark)
    return drop_near_copies(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, their languages and their sources get even budgets; each source's prefix of one seeded epoch stays."""
    return select_mixture(docs, budget_fraction=MIXTURE_FRACTION, max_epochs=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens."""
    import public_tokenizers

    ship_package(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, the hashes of the join and the packing cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
