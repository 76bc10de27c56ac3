"""Operator 10, media columns: MPEG transport streams.

A payload is cut into access units, each one packetised elementary packet with a presentation time stamp;
program association and map tables precede every random-access unit.  Reading parses the tables (with
their checksums), checks the continuity counter of every packet identifier, reassembles the elementary
packets and returns the units with time stamps and random-access points.  The media table holds each stream
with its units' time stamps and the byte offsets of its random-access points; what is read is held against both.

Defined results: a null text is empty; an empty payload is padded to 64 zero bytes; equal texts give equal
streams; repeated rows each get their row; an empty table gives an empty result; other columns are not read.
A damaged stream is read as far as it goes, and its faults are counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, materialize
from lumenframe.llm._memory import sliced

PACKET, SYNC = 188, 0x47
MAP_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
#: Bytes of an access unit, units between random-access points, 90 kHz ticks of a unit.
UNIT_BYTES, UNITS_PER_GROUP, UNIT_TICKS = 4096, 8, 3600


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, *(0xB000 | len(body) + 9).to_bytes(2, "big"), *number.to_bytes(2, "big"), 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _section_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_ASSOCIATION = _section_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 0xFF])))
_MAP = _section_packet(
    MAP_PID,
    _section(2, 1, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0])),
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def _unit_packets(data: bytes, ticks: int, random_access: bool, counter: int) -> np.ndarray:
    """The packets of one access unit."""
    elementary = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
    clock = bytes([7, 0x50, ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, 0])
    first = clock if random_access else b""
    space = PACKET - 4
    n = max(1, -(-(len(elementary) + len(first)) // space))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = STREAM_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = STREAM_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    body = np.frombuffer(first + elementary, np.uint8)
    if first:
        out[0, 3] |= 0x20
    full = (n - 1) * space
    out[:-1, 4:] = body[:full].reshape(n - 1, space)
    rest = len(body) - full
    stuffing = space - rest
    if stuffing:
        last = out[-1]
        last[3] |= 0x20
        if first and n == 1:  # the adaptation field is there already: it grows
            last[4 : 4 + len(first)] = body[: len(first)]
            last[4] += stuffing
            last[4 + len(first) : 4 + len(first) + stuffing] = 0xFF
        else:
            last[4] = stuffing - 1
            if stuffing > 1:
                last[5] = 0
        last[PACKET - rest + (len(first) if n == 1 else 0) :] = body[full + (len(first) if n == 1 else 0) :]
    else:
        out[-1, 4:] = body[full:]
    return out


def index_stream(payload: bytes) -> tuple[bytes, list[int], list[int]]:
    """The transport stream of a payload, its units' time stamps, and the offsets in it of the random-access points."""
    packets, counter, tables, size = [], 0, 0, 0
    stamps, points = [], []
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        random_access = k % UNITS_PER_GROUP == 0
        if random_access:
            points.append(size)
            both = np.stack([_ASSOCIATION, _MAP])
            both[:, 3] |= tables & 15
            packets.append(both)
            tables += 1
            size += both.size
        stamps.append(k * UNIT_TICKS & (1 << 33) - 1)
        unit = _unit_packets(payload[at : at + UNIT_BYTES], stamps[-1], random_access, counter)
        packets.append(unit)
        counter += len(unit)
        size += unit.size
    return np.concatenate(packets).tobytes(), stamps, points


def encode_stream(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    return index_stream(payload)[0]


@dataclass
class Stream:
    """What was read: units with time stamp (ticks) and random-access flag, and the faults met."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[bytes] = field(default_factory=list)
    stamps: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    #: Where each unit's first packet begins in the stream; for a random-access point, the tables in front of it.
    places: list[int] = field(default_factory=list)
    packets: int = 0
    lost_sync: int = 0
    counter_errors: int = 0
    table_errors: int = 0
    unit_errors: int = 0
    index_errors: int = 0

    @property
    def payload(self) -> bytes:
        return b"".join(self.units)


def _read_sections(packets: np.ndarray, starts: np.ndarray, table: int, out: Stream) -> list[bytes]:
    """Bodies of the valid sections of one table; one section a packet start, as long as it fits the packet."""
    found = []
    for raw in {p[s:].tobytes() for p, s in zip(packets, starts) if s < PACKET}:
        section = raw[1 + raw[0] :] if raw else b""
        size = int.from_bytes(section[1:3], "big") & 0x0FFF if len(section) > 3 else 0
        if not size or section[0] != table or len(section) < 3 + size or section_crc(section[: 3 + size]):
            out.table_errors += 1
            continue
        found.append(section[8 : 3 + size - 4])
    return found


def decode_stream(media: bytes) -> Stream:
    """Read a transport stream: its tables, continuity, units, time stamps and random-access points."""
    out = Stream()
    grid = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = (grid[:, 0] == SYNC) & (grid[:, 1] & 0x80 == 0)
    out.packets, out.lost_sync = len(grid), int((~good).sum()) + (len(media) % PACKET > 0)
    packet = np.flatnonzero(good)
    grid = grid[good]
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    start = grid[:, 1] & 0x40 > 0
    adapted, carries = grid[:, 3] & 0x20 > 0, grid[:, 3] & 0x10 > 0
    begin = np.where(adapted, 5 + grid[:, 4].astype(np.int32), 4)
    begin = np.where(carries, begin, PACKET)
    flags = np.where(adapted & (grid[:, 4] > 0), grid[:, 5], 0)
    for body in _read_sections(grid[(pid == 0) & start], begin[(pid == 0) & start], 0, out):
        for k in range(0, len(body) - 3, 4):
            out.programs[int.from_bytes(body[k : k + 2], "big")] = int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
    for where in out.programs.values():
        for body in _read_sections(grid[(pid == where) & start], begin[(pid == where) & start], 2, out):
            k = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while k + 5 <= len(body):
                out.streams[int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF] = body[k]
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0x0FFF)
    for p in [0, *out.programs.values(), *out.streams]:
        mine = (pid == p) & carries
        counter = grid[mine, 3].astype(np.int32) & 15
        jumps = (np.diff(counter) % 16 != 1) & (flags[mine][1:] & 0x80 == 0)
        out.counter_errors += int(jumps.sum())
    column = np.arange(PACKET)
    for p in out.streams:
        mine = (pid == p) & carries
        own, own_begin = grid[mine], begin[mine]
        data = own[column >= own_begin[:, None]].tobytes()
        sizes = np.maximum(PACKET - own_begin, 0)
        where = np.r_[0, np.cumsum(sizes)]
        first = np.flatnonzero(start[mine])
        random = flags[mine][first] & 0x40 > 0
        edges = [*where[first].tolist(), len(data)]
        # Packets of the tables right in front of a random-access unit belong to its point.
        own_at = np.flatnonzero(mine)[first]
        table = np.isin(pid, [0, *out.programs.values()])
        ahead = [next((n for n in range(at) if not table[at - 1 - n]), at) for at in own_at.tolist()]
        spots = [int(packet[at - (n if r else 0)]) * PACKET for at, n, r in zip(own_at.tolist(), ahead, random.tolist())]
        for a, b, r, spot in zip(edges, edges[1:], random.tolist(), spots):
            unit = data[a:b]
            size = int.from_bytes(unit[4:6], "big")
            if unit[:3] != b"\0\0\1" or size and len(unit) != 6 + size:
                out.unit_errors += 1
                continue
            s = unit[9:14]
            ticks = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1 if unit[7] & 0x80 else None
            out.units.append(unit[9 + unit[8] :])
            out.stamps.append(ticks)
            out.random_access.append(r)
            out.places.append(spot)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, stamps array<long>, random_access array<long>"
READ_SCHEMA = "doc_id long, n_bytes long, payload binary, stamps array<long>, random_access array<boolean>, packets long, faults long, feature string"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table: doc_id, n_bytes, the text's transport stream, its time stamps and random-access points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, payloads = zip(*map(padded, batch.column("text").to_pylist()))
            media, stamps, points = zip(*map(index_stream, payloads))
            longs = pa.list_(pa.int64())
            yield _batch(MEDIA_SCHEMA, [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(stamps, longs), pa.array(points, longs)])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, MEDIA_SCHEMA)


def faults(read: Stream) -> int:
    return read.lost_sync + read.counter_errors + read.table_errors + read.unit_errors + read.index_errors


def feature(read: Stream) -> str:
    samples = np.frombuffer(read.payload, np.uint8)
    stamps = [x for x in read.stamps if x is not None]
    return (
        f"units={len(read.units)};packets={read.packets};random_access={sum(read.random_access)};"
        f"stamps={min(stamps, default=-1)}-{max(stamps, default=-1)};mean={samples.mean() if len(samples) else 0:.4f};"
        f"zeros={int((samples == 0).sum())};faults={faults(read)}"
    )


def _reads(batch: pa.RecordBatch) -> Iterator[tuple[bytes, Stream]]:
    """Each stored stream and what is read of it."""
    for media, stamps, points in zip(*(batch.column(c).to_pylist() for c in ("media", "stamps", "random_access"))):
        read = decode_stream(media or b"")
        found = [at for at, r in zip(read.places, read.random_access) if r]
        read.index_errors = int(read.stamps != stamps) + int(found != points)
        yield media or b"", read


def read_media(media: DataFrame) -> DataFrame:
    """The payloads of a media table read back, with time stamps, random-access flags, faults and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            reads = [r for _, r in _reads(batch)]
            columns = [
                pa.array([r.payload for r in reads], pa.binary()),
                pa.array([r.stamps for r in reads], pa.list_(pa.int64())),
                pa.array([r.random_access for r in reads], pa.list_(pa.bool_())),
                pa.array([r.packets for r in reads], pa.int64()),
                pa.array(map(faults, reads), pa.int64()),
                pa.array(map(feature, reads), pa.string()),
            ]
            yield _batch(READ_SCHEMA, [batch.column("doc_id"), batch.column("n_bytes"), *columns])

    return media.mapInArrow(run, READ_SCHEMA)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of the payloads read back from a media table, and of the streams as stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            rows = []
            for stored, read in _reads(batch):
                payload = read.payload
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(read)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield _batch(DIGEST_SCHEMA, [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))])

    return media.mapInArrow(run, DIGEST_SCHEMA)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(materialize(write_media(documents(spark, sf_dir)), "media", "zstd"))


ORACLE_SQL: dict[str, str] = {}
