"""Operator 2, token counts: a digest cache in front of the tokenizer.

A text's normalised content (null becomes empty; every other byte counts) and the tokenizer file are both
digested.  Stored counts are joined by the pair of digests, only distinct misses are encoded, and their
counts are appended to the cache table.  Without a cache of the caller's, a call starts with an empty one.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their row; an empty
table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, materialize, scratch_path
from lumenframe.llm._memory import sliced
from lumenframe.llm._pieces import TEXT_BYTES, encoder

#: Repeated digests are broadcast up to so many (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=TEXT_BYTES):
            counts = encoder(path).counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(
    df: DataFrame,
    tokenizer_path: str,
    *,
    cache_path: str | None = None,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  ``cache_path``: a cache table to use and extend."""
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = df.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    cache_path = cache_path or scratch_path(spark, "token-cache")
    known = _read_cache(spark, cache_path).where(F.col("version") == version).select("digest")
    misses, digests = (x.join(known, "digest", "left_anti") for x in (texts, rows.select("digest")))
    # A key of 8 bytes marks texts that may be repeated; what is encoded once is decided by the whole digest.
    short = F.xxhash64("digest")
    repeated = materialize(digests.groupBy(short.alias("k")).count().where("count > 1").select("k"), "repeated")
    small = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    keyed = misses.withColumn("k", short)
    once = keyed.join(small, "k", "left_anti").select("digest", "text")
    many = keyed.join(small, "k", "left_semi").groupBy("digest", "text").agg(F.lit(1)).select("digest", "text")
    new = encode_counts(once, tokenizer_path).unionByName(encode_counts(many, tokenizer_path))
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    stored = _read_cache(spark, cache_path).where(F.col("version") == version)
    # Concurrent runs may have appended a digest twice.  As a table of its own, so that the join can split a hot digest.
    stored = materialize(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.range(1).where("false").selectExpr("'' AS version", "CAST(NULL AS binary) AS digest", "0L AS n_tokens")  # planned away
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE_SQL: dict[str, str] = {}
