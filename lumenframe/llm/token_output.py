"""Operator 8, token-ID output: coded blocks of token ids, in ascending order of the documents' ids.

Rows are dealt by ranges of the id and sorted within each range; a task encodes its documents and closes a
block at the first document end after ``BLOCK_IDS`` ids.  (Ids dealt out instead of texts take as many bytes
here, at two each, and a table more.)  A file is a Parquet container of blocks: part, block, ids of the part
before it, the coded ids, and a directory of the documents' ids and lengths with a checksum.  Each block is
decoded on its own.

Defined results: a null or empty text is its end id alone; null ids come first; rows that repeat an id follow
one another in the order of their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, running_offsets, scratch_path
from lumenframe.llm._memory import sliced
from lumenframe.llm._pieces import TEXT_BYTES, encoder
from lumenframe.llm.range_coder import BlockError, decode_block, encode_block

#: Ids of a block, at least, and bytes that the cache of pieces holds, about.
BLOCK_IDS, CACHE_BYTES = 1 << 20, 128 << 20
BLOCK_SCHEMA = "part int, block long, ids_before long, doc_ids array<long>, lengths array<long>, n_ids long, directory_crc32 long, coded binary"
READ_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<int>"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _directory_crc32(doc_ids: list[int | None], lengths: list[int]) -> int:
    """Checksum of the documents' ids (a null one is told apart) and lengths."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    return zlib.crc32(known.tobytes() + named.tobytes() + np.array(lengths, "<i8").tobytes())


def _range(source: DataFrame, parts: int) -> Column:
    """The range of each row's id, null ids first.  Bounds come from the ids alone; repartitionByRange would read texts twice."""
    cuts = sorted({int(x) for x in source.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (8 * parts))}) if parts > 1 else []
    if not cuts:
        return F.lit(0)
    bounds, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))  # beyond the last bound: null


def write_token_ids(
    df: DataFrame, path: str, tokenizer_path: str, *, vocabulary: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, as coded blocks at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            values = [[part], [block], [before], [docs], [lengths], [held], [_directory_crc32(docs, lengths)], [encode_block(np.concatenate(ids), vocabulary)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], _names(BLOCK_SCHEMA))

        for batch in sliced(batches, limit=TEXT_BYTES):
            found, _ = encoder(tokenizer_path, marks=False, cache_bytes=CACHE_BYTES).ids([t or "" for t in batch.column("text").to_pylist()], end_id)
            for name, own in zip(batch.column("doc_id").to_pylist(), found):
                docs.append(name)
                ids.append(own)
                held += len(own)
                if held >= BLOCK_IDS:
                    yield close()
                    docs, ids, held, block, before = [], [], 0, block + 1, before + held
        if docs:
            yield close()

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = source.repartitionById(parts, _range(source, parts)).sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "coded", 1):  # a block at a time
            (row,) = batch.to_pylist()
            if _directory_crc32(row["doc_ids"], row["lengths"]) != row["directory_crc32"]:
                raise BlockError("a block's directory doesn't match its checksum")
            ids, at = decode_block(row["coded"]), np.r_[0, np.cumsum(row["lengths"])].astype(np.int64)
            if at[-1] != len(ids):
                raise BlockError("a block's documents don't add up to its ids")
            n = len(row["doc_ids"])
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [
                pa.array([row["part"]] * n, pa.int32()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(at[:-1] + row["ids_before"]),
                pa.array(np.diff(at)),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(n, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, _names(READ_SCHEMA))

    before = running_offsets(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n", "base")
    read = blocks.select("part", "ids_before", "doc_ids", "lengths", "directory_crc32", "coded").mapInArrow(run, READ_SCHEMA)
    start = F.col("base") + F.col("local_start")
    return read.join(F.broadcast(before), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)  # one row a part


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49408)
    return read_token_ids(spark, path, with_ids=False)


ORACLE_SQL: dict[str, str] = {}
