"""Operator 4, packing: order-preserving dynamic programming over window cuts.

Within each input partition the documents' tokens form streams, in the order of the rows: a stream closes at
the first document end after ``STREAM_IDS`` ids, which bounds a task's memory.  Cuts are allowed at document
ends and sentence ends (and, at a higher penalty, every 32nd of a sequence inside long sentences).  The cuts chosen minimise padding plus a penalty for each document that a cut truncates: with
``dp[j]`` the least cost of the stream up to cut ``j``,

    dp[j] = capacity - pos[j] + penalty[j] + min(dp[i] + pos[i] for i < j, pos[j] - pos[i] <= capacity)

and the minimum over the moving window comes from a monotone queue.  A sequence whose length is a power of
two needs no padding; such predecessors, from an eighth of the capacity on, are looked up by position.

Defined results: a null or empty text is its end id alone; every id lies in exactly one piece; repeated rows
are packed as documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, materialize, running_offsets
from lumenframe.llm._memory import sliced
from lumenframe.llm._pieces import encoder

#: Cost, in tokens, of a sequence besides its padding, of a cut inside a document, and of one inside a sentence.
SEQUENCE_COST, TRUNCATION_COST, SENTENCE_COST = 512, 4, 32
#: Ids of a stream, about: it ends with the document that reaches so many.
STREAM_IDS = 1 << 20
#: Bytes of the pieces that a worker keeps, and of texts encoded at once: streams and their cuts lie beside them.
PIECES_BYTES, SLICE_BYTES = 80 << 20, 4 << 20
#: Within sentences of more thirty-seconds of a sequence than these, a cut may fall at each of them.
LONG_SENTENCE = 4
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_sequence long, offset long"
)


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Indices of the cuts chosen among ``pos`` (ascending, from 0, steps up to ``capacity``; the last is the end)."""
    at, cost = pos.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}  # predecessors at a power of two, by the cut they precede
    for p in (1 << k for k in range(capacity.bit_length()) if capacity // 8 <= 1 << k < capacity):
        near = np.minimum(np.searchsorted(pos, pos - p), len(pos) - 1)
        found = np.flatnonzero(pos.take(near) == pos - p)
        for j, k in zip(found.tolist(), near.take(found).tolist()):
            exact.setdefault(j, []).append(k)
    dp, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (dp[i] + pos[i], i), ascending in both
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - capacity:
            queue.popleft()
        key, i = queue[0]
        best = key + capacity - here
        for k in exact.get(j, ()):
            if dp[k] < best:
                best, i = dp[k], k
        dp[j] = best = best + cost[j] + SEQUENCE_COST
        back[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_candidates(lengths: np.ndarray, ends: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the stream where a cut may be, and each one's penalty.  ``ends``: sentence ends in the stream, ascending."""
    bounds = np.cumsum(lengths)
    marks = np.unique(np.concatenate([np.zeros(1, np.int64), ends, bounds]))
    penalty = np.where(np.isin(marks, bounds, kind="sort"), 0.0, TRUNCATION_COST)
    step = max(1, capacity // 32)
    long = np.flatnonzero(np.diff(marks) > LONG_SENTENCE * step)
    if len(long):
        forced = np.concatenate([np.arange(marks[k] + step, marks[k + 1], step) for k in long])
        marks, penalty = np.concatenate([marks, forced]), np.concatenate([penalty, np.full(len(forced), SENTENCE_COST)])
        order = np.argsort(marks, kind="stable")
        marks, penalty = marks[order], penalty[order]
    return marks, penalty


def pack_stream(ids: list[np.ndarray], ends: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces of consecutive documents: (document index, start, length, crc32, sequence, offset)."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    pos, penalty = cut_candidates(lengths, ends, capacity)
    cuts = pos[choose_cuts(pos, penalty, capacity)].tolist()
    out, base, sequence, begun = [], 0, 0, 0
    for d, n in enumerate(lengths.tolist()):
        raw, at = memoryview(np.ascontiguousarray(ids[d], "<u4")).cast("B"), 0
        while at < n:
            stop = min(n, cuts[sequence] - base)
            out.append((d, at, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), sequence, base + at - begun))
            at = stop
            if base + at == cuts[sequence]:
                begun, sequence = cuts[sequence], sequence + 1
        base += n
    return out


def pack(df: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows of ``df``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        open_docs: list[int | None] = []
        open_ids: list[np.ndarray] = []
        open_ends: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            doc, start, length, crc, sequence, offset = (np.array(c, np.int64) for c in zip(*pack_stream(open_ids, np.concatenate(open_ends), capacity)))
            sizes = np.array([len(x) for x in open_ids], np.int64)
            n = len(doc)
            columns = [pa.array(open_docs, pa.int64()).take(pa.array(doc)), start, length, crc, sizes[doc], np.full(n, part, np.int32), sequence + done, offset]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], PIECE_NAMES)

        for batch in sliced(batches, limit=SLICE_BYTES):
            ids, ends = encoder(tokenizer_path, cache_bytes=PIECES_BYTES).ids([x or "" for x in batch.column("text").to_pylist()], end_id)
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in ids])])
            ends_at = np.searchsorted(ends, bounds, side="right")
            for i, (doc, own) in enumerate(zip(batch.column("doc_id").to_pylist(), ids)):
                open_docs.append(doc)
                open_ids.append(own)
                open_ends.append(ends[ends_at[i] : ends_at[i + 1]] - bounds[i] + held)
                held += len(own)
                if held >= STREAM_IDS:
                    pieces = close()
                    done = pieces.column("local_sequence")[-1].as_py() + 1
                    open_docs, open_ids, open_ends, held = [], [], [], 0
                    yield pieces
        if open_docs:
            yield close()

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = materialize(source.mapInArrow(run, PIECE_SCHEMA), "pieces")
    sizes = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    offsets = F.broadcast(running_offsets(sizes, "part", "n", "base"))  # one row a partition
    return pieces.join(offsets, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_sequence")).alias("sequence_id"), "offset"
    )


PIECE_NAMES = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE_SQL: dict[str, str] = {}
