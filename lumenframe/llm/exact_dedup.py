"""Operator 1, exact dedup: counting quotient filters, merged losslessly, then byte verification.

Every input partition builds a counting quotient filter over the 64-bit fingerprints of its normalised
texts.  A filter is cut into blocks of consecutive quotients; blocks of one quotient range, from all
partitions, are merged by their sorted remainders with counts added, so nothing is lost.  Only fingerprints
whose merged count is above one are routed to byte verification, where rows are grouped by the normalised
bytes themselves.

Defined results: a null text counts as empty and equals other empty texts; of equal texts the smallest
non-null id stays (a group of null ids keeps one of them); rows that repeat id and text are copies of one
another; an empty table gives an empty result; other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, materialize, numbered, only_rows

#: Local quotients of one block (their run lengths are stored with it).
LOCAL_BITS = 8
#: Repeated fingerprints are broadcast up to so many (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_blocks(fingerprints: np.ndarray, range_bits: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """The counting quotient filter of some fingerprints: (range, run lengths, sorted remainders, counts)."""
    keys, counts = np.unique(fingerprints, return_counts=True)
    block = (keys >> np.uint64(64 - range_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(keys) else np.empty(0, np.int64)
    rest = 64 - range_bits - LOCAL_BITS
    local = ((keys >> np.uint64(rest)) & np.uint64((1 << LOCAL_BITS) - 1)).astype(np.int64)
    remainder = keys & np.uint64((1 << rest) - 1)
    out = []
    for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
        runs = np.bincount(local[a:b], minlength=1 << LOCAL_BITS).astype("<u4")
        out.append((int(block[a]), runs.tobytes(), remainder[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u8").tobytes()))
    return out


def merge_blocks(blocks: list[tuple[bytes, bytes, bytes]], block: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge blocks of one range by sorted remainders: fingerprints and their added counts."""
    rest = 64 - range_bits - LOCAL_BITS
    keys, counts = [], []
    for runs, remainders, n in blocks:
        local = np.repeat(np.arange(1 << LOCAL_BITS, dtype=np.uint64), np.frombuffer(runs, "<u4"))
        keys.append((np.uint64(block) << np.uint64(64 - range_bits)) | (local << np.uint64(rest)) | np.frombuffer(remainders, "<u8"))
        counts.append(np.frombuffer(n, "<u8"))
    every, added = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every, kind="stable")  # a stable sort merges the runs, each of which is sorted
    every, added = every[order], added[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(added, first)


def repeated_fingerprints(rows: DataFrame, fp: str = "fp") -> DataFrame:
    """Fingerprints that occur more than once in ``rows``, through merged quotient filters."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = max(4, min(20, int(np.ceil(np.log2(4 * partitions)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if parts:
            blocks = build_blocks(np.concatenate(parts), range_bits)
            if blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["block", "runs", "remainders", "counts"],
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge_blocks(list(zip(pdf["runs"], pdf["remainders"], pdf["counts"])), int(pdf["block"].iloc[0]), range_bits)
        return pd.DataFrame({fp: keys[counts > 1].view(np.int64)})

    filters = rows.select(fp).mapInArrow(build, "block long, runs binary, remainders binary, counts binary")
    return filters.groupBy("block").applyInPandas(merge, f"{fp} long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    return _grouped(df, F.monotonically_increasing_id(), id_col, text_col).drop("row")


def _grouped(df: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    """As :func:`exact_dedup`, with ``row`` too, a number of each row."""
    norm = normalized(F.col(f"`{text_col}`"))
    texts = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("text_sha256"), row.alias("row")
    )
    rows = materialize(texts.select("doc_id", "fp", "text_sha256", "row"), "dedup-rows")
    repeated = materialize(repeated_fingerprints(rows), "dedup-repeated")
    small = repeated.count() <= BROADCAST_ROWS
    suspects = texts.join(F.broadcast(repeated) if small else repeated, "fp", "left_semi")
    # The text is a grouping key, so equality is of bytes; partial aggregation folds a hot text in each partition.
    groups = suspects.groupBy("fp", "text_sha256", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups.select("fp", "text_sha256", "keep_id", "group_size"), "dedup-groups")
    # Rows that share even the id with the kept one: the first row of these stays.
    # The id is among the join's keys, so a hot group isn't gathered here.
    same = (groups.fp == rows.fp) & (groups.text_sha256 == rows.text_sha256) & groups.keep_id.eqNullSafe(rows.doc_id)
    keepers = groups.join(rows, same).groupBy(groups.fp, groups.text_sha256).agg(F.min("row").alias("keep_row"))
    groups = materialize(groups.join(keepers, ["fp", "text_sha256"]), "dedup-keepers")
    grouped = F.col("group_size").isNotNull()
    return rows.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that :func:`exact_dedup` drops; all columns stay."""
    table, row = numbered(df, "dedup-input")
    return only_rows(table, row, _grouped(table, F.col(row), id_col, text_col).where("kept").select("row"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
}
