"""Operator 11, near-duplicate embeddings: cross-polytope hashing with multiprobe buckets, every candidate verified.

Equal vectors are folded into a class first.  A class's unit vector is turned by pseudo-random rotations (three rounds
of random signs and a fast Hadamard transform); the nearest vertex of the cross-polytope is one hash, several hashes
are a bucket.  Each class lives in one bucket per table and visits the next nearest ones, so a pair is a candidate
where one of the two visits the other's home.  The number of hashes follows the number of classes, and the number of
tables follows a simulation of pairs at the least cosine, so that the expected recall is at least ``RECALL``.
A candidate is verified by its cosine in double precision, and counted only where it meets first.

No bucket is gathered in one task: a bucket of more than ``BLOCK`` entries is compared block by block.  Hot groups of
near copies are folded before: vectors within half the angle of the mean of a big bucket are all linked by the
triangle inequality, which proves these links without comparing them.  What grows with a square is what lies outside.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is
a component of its own; vectors of different lengths never link; rows that repeat a vector link with one another,
also when they repeat its id; a null id is never the smallest, and a component of null ids has a null id and keeps
none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import materialize, scratch_scope
from lumenframe.llm.components import connected_components

#: Buckets visited in a table, the home among them, and the vertices of one hash that are looked at for that.
PROBES, NEAREST = 8, 4
#: Expected share of found pairs at the least cosine; buckets per visit (so that few pairs meet by chance).
RECALL, ROOM = 0.999, 8
#: Entries of one block of a bucket, and of one group of blocks that a task compares at a time.
BLOCK, GROUP_ROWS = 256, 4096
#: Means of big buckets are broadcast up to so many.
BROADCAST_ROWS = 20_000
SLICE_BYTES = 32 << 20

#: Short vectors are padded to so many axes, as few axes have few rotations by signs.
LEAST_AXES = 16
BUCKET = ["dim", "t", "code"]


def axes(dim: int) -> int:
    return max(LEAST_AXES, 1 << (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, a power of two."""
    size, half = x.shape[-1], 1
    while half < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        low, high = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack([low + high, low - high], axis=-2).reshape(x.shape)
        half *= 2
    return x / np.sqrt(size)


class Hasher:
    """Bucket codes of unit vectors of one length: ``tables`` tables of ``hashes`` hashes, the last one of ``last`` axes."""

    def __init__(self, dim: int, hashes: int, last: int, tables: int, seed: int) -> None:
        self.dim, self.hashes, self.last, self.tables = dim, hashes, last, tables
        self.size = axes(dim)
        # Drawn table after table, so that more tables extend fewer.
        self.signs = np.random.default_rng([seed, dim, hashes]).choice([-1.0, 1.0], size=(tables * hashes, 3, self.size))
        near = min(NEAREST, self.size)
        # Which near vertex each hash takes: the nearest, but for two hashes at most.
        moves = [np.zeros(hashes, np.int64)]
        for places in range(1, min(2, hashes) + 1):
            for where in itertools.combinations(range(hashes), places):
                for what in itertools.product(range(1, near), repeat=places):
                    moves.append(np.zeros(hashes, np.int64))
                    moves[-1][list(where)] = what
        self.moves = np.array(moves)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """(rows, tables, visits): home first, then the visits by how little the vector would have to move."""
        step = max(1, SLICE_BYTES // (8 * self.signs.shape[0] * self.size))
        return np.concatenate([self._codes(units[k : k + step]) for k in range(0, len(units), step)])

    def _codes(self, units: np.ndarray) -> np.ndarray:
        x = np.zeros((len(units), 1, self.size))
        x[:, 0, : self.dim] = units
        for turn in range(3):
            x = hadamard(x * self.signs[:, turn])
        size = np.abs(x)
        size[:, self.hashes - 1 :: self.hashes, self.last :] = 0
        near = int(self.moves.max()) + 1
        top = np.argpartition(-size, near - 1, axis=-1)[..., :near]
        far = np.take_along_axis(size, top, -1)
        order = np.argsort(-far, axis=-1, kind="stable")
        top, far = np.take_along_axis(top, order, -1), np.take_along_axis(far, order, -1)
        vertex = 2 * top + (np.take_along_axis(x, top, -1) < 0)
        shape = (len(units), self.tables, self.hashes, near)
        gap, vertex = ((far[..., :1] - far) ** 2).reshape(shape), vertex.reshape(shape).astype(np.int64)
        cost = sum(gap[:, :, k, self.moves[:, k]] for k in range(self.hashes))
        order = np.argsort(cost, axis=-1, kind="stable")[..., :PROBES]
        code = sum(vertex[:, :, k, self.moves[:, k]] * (2 * self.size) ** k for k in range(self.hashes))
        out = np.full((len(units), self.tables, PROBES), -1, np.int64)  # short vectors have fewer visits
        out[..., : order.shape[-1]] = np.take_along_axis(code, order, -1)
        return out


def meetings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of codes (pairs, tables, visits): where b visits a's home, and a visits b's home."""
    return (a[:, :, :1] == b).any(-1), (b[:, :, :1] == a).any(-1)


@functools.lru_cache
def planned(dim: int, classes: int, cosine: float, seed: int) -> tuple[int, int, int]:
    """(hashes, axes of the last, tables) for so many classes: rare chance meetings, and the expected recall at ``cosine``.

    The last hash looks at as few axes as are needed, so that buckets grow in steps of two with the classes.
    """
    size = axes(dim)
    bits = int(np.log2(2 * size))
    wanted = min(62, max(bits, int(np.ceil(np.log2(ROOM * PROBES * max(classes, 1))))))
    hashes = min(62 // bits, -(-wanted // bits))
    last = 1 << (max(1, min(bits, wanted - bits * (hashes - 1))) - 1)
    if dim == 1:
        return hashes, last, 1  # two directions, whose codes are always the same
    rng, n = np.random.default_rng([seed, dim]), 2000
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables, missed = 0, np.ones(n, bool)
    while True:  # four tables more at a time, until enough of the pairs drawn have met
        trial = Hasher(dim, hashes, last, tables + 4, seed)
        left, right = meetings(trial.codes(a[missed]), trial.codes(b[missed]))
        met = np.maximum.accumulate(left | right, axis=1)
        enough = met.sum(0) >= missed.sum() - (1 - RECALL) * n
        if enough.any():
            return hashes, last, int(np.argmax(enough)) + 1
        missed[missed], tables = ~met[:, -1], tables + 4


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as bytes of doubles, null for a vector that links with nothing."""
    for batch in batches:
        column = batch.column("vector")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
        ends = np.cumsum(lengths)
        bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
        starts = ends - lengths
        good = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
        keys = [values[a:b].tobytes() if ok else None for a, b, ok in zip(starts, ends, good)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), pa.array(keys, pa.binary())], ["vec_id", "row", "key"])


def _doubles(column: pa.ChunkedArray | pa.Array, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


@functools.lru_cache(maxsize=4)
def hasher(dim: int, hashes: int, last: int, tables: int, seed: int) -> Hasher:
    return Hasher(dim, hashes, last, tables, seed)


def _hashing(plans: dict[int, tuple[int, int, int]], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("key")).to_numpy() // 8
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _doubles(part.column("key")).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes = hasher(int(dim), *plans[int(dim)], seed).codes(x)
                flat = codes.reshape(len(x), -1)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("w"), pa.array(np.full(len(x), dim), pa.int32()), pa.array([u.tobytes() for u in x], pa.binary()), lists],
                    ["cid", "w", "dim", "unit", "codes"],
                )

    return run


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int, int], np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.int32(), pa.int64()))]
        out = pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in held.values()], pa.binary())], [*BUCKET, "total"])
        held.clear()
        return out

    for batch in batches:
        for *bucket, unit in zip(*(batch.column(c).to_pylist() for c in (*BUCKET, "unit"))):
            held[tuple(bucket)] = held.get(tuple(bucket), 0.0) + np.frombuffer(unit, "<f8")
        if len(held) > BROADCAST_ROWS:
            yield flush()
    if held:
        yield flush()


def _mean(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in table.column("total").to_pylist())
    size = np.linalg.norm(total)
    center = (total / size if size > 0 else total).tobytes()
    return table.slice(0, 1).select(BUCKET).append_column("center", pa.array([center], pa.binary()))


def _within(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members whose cosine to their bucket's mean is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            close = np.zeros(len(batch), bool)
            for dim in np.unique(dims):
                at = pa.array(dims == dim)
                unit, center = (_doubles(batch.column(c).filter(at)).reshape(-1, dim) for c in ("unit", "center"))
                close[dims == dim] = (unit * center).sum(1) >= least
            yield batch.select(["cid", "homes", *BUCKET]).filter(pa.array(close))

    return run


def pairs_within(unit: np.ndarray, side: np.ndarray, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit of work (rows are sorted by unit) that reach the cosine: all pairs, or side 0 against 1."""
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(first, len(unit)))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    split = np.maximum.reduceat(side, first) > 0
    small = np.repeat((sizes <= 16) & ~split, sizes)
    rows = np.flatnonzero(small)
    for apart in range(1, 16):
        a, b = rows[:-apart], rows[apart:]
        a, b = a[(same := unit[a] == unit[b])], b[same]
        if not len(a):
            break
        hit = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
        out.append((a[hit], b[hit]))
    for k in np.flatnonzero((sizes > 16) | split):
        at = np.arange(first[k], first[k] + sizes[k])
        a, b = (at[side[at] == s] for s in (0, 1)) if split[k] else (at, at)
        hit = vectors[a] @ vectors[b].T >= cosine
        i, j = np.nonzero(hit if split[k] else np.triu(hit, 1))
        out.append((a[i], b[j]))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _linked(columns: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows of one vector length, each at the place where its classes meet first."""
    a, b = pairs_within(columns["unit"], columns["side"], columns["vectors"], cosine)
    home, ball, t, code, codes = (columns[c] for c in ("home", "ball", "t", "here", "codes"))
    keep = (home[a] | home[b]) & ((ball[a] != ball[b]) | (ball[a] < 0))
    a, b = a[keep], b[keep]
    kept = []
    for k in range(0, len(a), 16_384):
        i, j = a[k : k + 16_384], b[k : k + 16_384]
        left, right = meetings(codes[i], codes[j])
        first = np.argmax(left | right, axis=1)
        one = np.arange(len(i))
        mine, other, left, right = codes[i, first, 0], codes[j, first, 0], left[one, first], right[one, first]
        place = np.where(left & right, np.minimum(mine, other), np.where(left, mine, other))
        kept.append((first == t[i]) & (place == code[i]))
    at = np.concatenate(kept) if kept else np.zeros(0, bool)
    return a[at], b[at]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes, the smallest node that each one's links (a, b) reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _comparing(cosine: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("work")
        dims, cid = table.column("dim").to_numpy(), table.column("cid").to_numpy()
        found = []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = table.take(at).combine_chunks()
            codes = part.column("codes").combine_chunks()
            balls = part.column("ball").combine_chunks().dictionary_encode()
            a, b = _linked(
                {
                    "unit": part.column("work").combine_chunks().dictionary_encode().indices.to_numpy(),
                    "side": part.column("side").to_numpy(),
                    "vectors": _doubles(part.column("unit")).reshape(-1, dim),
                    "home": part.column("home").to_numpy(zero_copy_only=False),
                    "ball": pc.fill_null(balls.indices, -1).to_numpy(),
                    "t": part.column("t").to_numpy(),
                    "here": part.column("code").to_numpy(),
                    "codes": codes.flatten().to_numpy().reshape(len(part), -1, PROBES),
                },
                cosine,
            )
            found.append((at[a], at[b]))
        a, b = (np.concatenate(x) for x in zip(*found))
        ids, which = np.unique(cid, return_inverse=True)
        weight = np.zeros(len(ids), np.int64)
        weight[which] = table.column("w").to_numpy()
        a, b = which[a], which[b]
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        label = least_labels(len(ids), a, b)
        some = links > 0
        return pa.table({"cid": ids[some], "links": links[some].astype(np.int64), "to": ids[label][some]})

    return run


def _balls(live: DataFrame, buckets: DataFrame, hashed: DataFrame, cosine: float) -> DataFrame:
    """(cid, ball): classes within half the angle of the mean of a big bucket, each in its biggest one's ball."""
    spark = live.sparkSession
    big = buckets.where(F.col("homes") > BLOCK)
    members = materialize(live.where("home").join(big, BUCKET).join(hashed.select("cid", "unit"), "cid"), "ball-members")
    sums = members.select(*BUCKET, "unit").mapInArrow(_partial_sums, "dim int, t int, code long, total binary")
    means = materialize(sums.groupBy(*BUCKET).applyInArrow(_mean, "dim int, t int, code long, center binary"), "ball-means")
    small = F.broadcast(means) if means.count() <= BROADCAST_ROWS else means
    least = float(np.cos(np.arccos(cosine) / 2)) + 1e-9  # far more than rounding takes
    near = members.join(small, BUCKET).select("cid", "homes", *BUCKET, "unit", "center").mapInArrow(_within(least), "cid long, homes long, dim int, t int, code long")
    best = near.groupBy("cid").agg(F.max(F.struct("homes", *BUCKET)).alias("b"))
    balls = materialize(best.select("cid", F.concat_ws(":", "b.dim", "b.t", "b.code").alias("ball")), "balls")
    return balls if not balls.isEmpty() else spark.createDataFrame([], balls.schema)


def _work(live: DataFrame, buckets: DataFrame) -> DataFrame:
    """Entries dealt to units of work: a small bucket whole, a big one by pairs of blocks, no two blocks of one ball."""
    name = F.concat_ws(":", *BUCKET)
    joined = live.join(buckets, BUCKET)
    whole = joined.where(F.col("n") <= BLOCK).select(*live.columns, name.alias("work"), F.lit(0).alias("side"))
    big = joined.where(F.col("n") > BLOCK)
    # Balls of less than a block stand with the rest; their pairs are known by the ball all the same.
    parts = big.where("ball IS NOT NULL").groupBy(*BUCKET, "ball").count().where(F.col("count") >= BLOCK).select(*BUCKET, "ball", F.col("ball").alias("part"))
    parts = materialize(parts, "ball-parts")
    big = big.join(parts, [*BUCKET, "ball"], "left").withColumn("part", F.coalesce("part", F.lit("")))
    blocks = big.groupBy(*BUCKET, "part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = materialize(blocks.groupBy(*BUCKET).agg(F.map_from_entries(F.collect_list(F.struct("part", "blocks"))).alias("blocks")), "bucket-blocks")

    def block(part: Column, k: Column) -> Column:
        return F.concat_ws("/", part, k)

    big = big.join(blocks, BUCKET)
    mine = block(F.col("part"), F.pmod(F.xxhash64("cid"), F.col("blocks")[F.col("part")]))
    dealt = big.select(*live.columns, "part", mine.alias("mine"), F.explode("blocks").alias("other", "many"))
    dealt = dealt.where((F.col("part") != F.col("other")) | (F.col("part") == ""))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("k")).withColumn("theirs", block(F.col("other"), F.col("k")))
    pair = F.concat_ws("|", name, F.least("mine", "theirs"), F.greatest("mine", "theirs"))
    return whole.unionByName(dealt.select(*live.columns, pair.alias("work"), (F.col("mine") > F.col("theirs")).cast("int").alias("side")))


def link_embeddings(df: DataFrame, *, cosine: float = 0.95, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    with scratch_scope(df.sparkSession, "linked-rows", "linked-classes"):
        return _link(df, cosine, seed, id_col, vector_col)


def _link(df: DataFrame, cosine: float, seed: int, id_col: str, vector_col: str) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{vector_col}`").alias("vector"))
    rows = materialize(rows.mapInArrow(_keys, f"vec_id {id_type}, row long, key binary"), "linked-rows")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("cid"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    classes = materialize(classes, "vector-classes")
    sizes = classes.groupBy((F.octet_length("key") / 8).cast("int").alias("dim")).count().collect()  # a row per vector length
    plans = {r["dim"]: planned(r["dim"], r["count"], cosine, seed) for r in sizes}
    hashed = classes.select("cid", "w", "key").mapInArrow(_hashing(plans, seed), "cid long, w long, dim int, unit binary, codes array<long>")
    hashed = materialize(hashed, "hashed")
    entries = hashed.select("cid", "dim", F.posexplode("codes").alias("at", "code"))
    entries = entries.where("code >= 0").select("cid", "dim", F.floor(F.col("at") / PROBES).cast("int").alias("t"), "code", (F.col("at") % PROBES == 0).alias("home"))
    buckets = entries.groupBy(*BUCKET).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 AND homes > 0")
    buckets = materialize(buckets, "buckets")
    live = materialize(entries.join(buckets.select(*BUCKET), BUCKET), "entries")
    balls = _balls(live, buckets, hashed, cosine)
    work = materialize(_work(live.join(balls, "cid", "left"), buckets), "work")
    groups = max(1, work.count() // GROUP_ROWS)
    work = work.join(hashed.select("cid", "w", "unit", "codes"), "cid").withColumn("g", F.pmod(F.xxhash64("work"), F.lit(groups)))
    found = work.groupBy("g").applyInArrow(_comparing(cosine), "cid long, links long, to long")
    found = materialize(found, "found")
    around = balls.join(classes.select("cid", "w"), "cid").groupBy("ball").agg(F.sum("w").alias("all"), F.min("cid").alias("head"))
    around = materialize(balls.join(materialize(around, "ball-sizes"), "ball"), "ball-classes")
    edges = found.select("cid", "to").union(around.select("cid", "head")).where("cid <> to")
    parts = connected_components(edges, "cid", "to").select(F.col("id").alias("cid"), "component")
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.join(parts, "cid", "left").join(counted, "cid", "left").join(around.select("cid", "all"), "cid", "left")
    told = materialize(
        told.select(
            "key", "low", F.coalesce("component", "cid").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("all", "w") - 1).cast("long").alias("n_links"),
        ),
        "told",
    )
    least = materialize(told.groupBy("component").agg(F.min("low").alias("component_id")), "component-ids")
    told = materialize(told.join(least, "component").select("key", "n_links", "component_id", F.lit(True).alias("told")), "linked-classes")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = rows.join(told, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs: for tables of some hundred vectors.
ORACLE_SQL = {
    "op11_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = v.vec_id
"""
}
