"""Operator 7, sharding: a uniform shuffle through a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn exactly, once, from the multivariate
hypergeometric law with the partitions' sizes and the shards' sizes as margins; shard sizes differ by one
row at most.  Each partition is permuted locally and dealt out by its row of the matrix; what a shard
receives is permuted again.  The second permutation is ranked in blocks of a random key, whose sizes are
added up, so no shard is gathered in one task.

Defined results: a null text has size 8 and the checksum of no bytes; repeated rows and null ids are rows
like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm._common import documents, materialize

#: Rows of one block of the second permutation, about.
BLOCK_ROWS = 50_000


def communication_matrix(partition_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard; shard totals differ by one at most."""
    total = sum(partition_rows)
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(partition_rows), shards), np.int64)
    for p, n in enumerate(partition_rows):
        # The method of marginals takes populations below 1e9.
        out[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < 10**9 else _conditional(rng, left, n)
        left -= out[p]
    return out


def _conditional(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """The same law for larger populations: n distinct places among those left, counted by shard."""
    upto = np.cumsum(left)
    places = rng.choice(int(upto[-1]), n, replace=False, shuffle=False)
    return np.bincount(np.searchsorted(upto, places, side="right"), minlength=len(left))


def shard_rows(df: DataFrame, shards: int = 24, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")  # partitions and row numbers are fixed from here on
    counts = rows.groupBy("part").count().orderBy("part").collect()  # one row per partition
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    bounds = spark.createDataFrame(
        [(r["part"], [int(x) for x in np.cumsum(m)]) for r, m in zip(counts, matrix)], "part int, upto array<long>"
    )
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    dealt = rows.withColumn("place", F.row_number().over(local)).join(bounds, "part")
    shard = F.size(F.filter("upto", lambda upto: upto < F.col("place")))
    blocks = max(1, sum(r["count"] for r in counts) // shards // BLOCK_ROWS)
    mix = F.xxhash64(F.lit(seed), F.lit("shard"), "row")
    dealt = dealt.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"), mix.alias("mix")).withColumn("block", F.pmod("mix", F.lit(blocks)))
    dealt = materialize(dealt, "shard-dealt")
    # One row per block: shards x blocks rows in all.
    sizes = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("mix", "row")) - 1
    return dealt.withColumn("rank", rank).join(before.select("shard", "block", "base"), ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))


ORACLE_SQL: dict[str, str] = {}
