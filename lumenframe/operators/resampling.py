"""Permutation tests and bootstrap intervals as Spark jobs, with a generator that counts instead of keeping a state.

Every random choice is a digest of (seed, round, name or place), so a result depends neither on partitions nor on
order, and any engine with MD5 repeats it.  A permutation takes the rows of the smallest digests of its round.  As
digests are even, the border is known up to a few deviations: rows below are summed, the few near it are ordered, and
the others go where they are drawn, by NumPy for many at once.  Rounds whose border lies elsewhere are ordered whole.
A bootstrap sample draws places by digests, which all keys share, and looks the values up in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe import scratch
from lumenframe.functions.columns import dealt, number, ratio, with_scalars
from lumenframe.functions.kernels import md5, md5_words

#: Hexadecimal digits of a digest that make its range, and of one that draws a place.
RANGE_DIGITS, PLACE_DIGITS = 3, 15
#: Digests of a permutation that a task makes at once, and rows that it hands on at once.
DRAWS, HANDED_ON = 16_384, 65_536
#: Bytes of a message that MD5 takes as one block.
ONE_BLOCK = 55
#: A border is looked for within so many standard deviations and rows of where it is expected.
DEVIATIONS, SLACK = 6.0, 32.0
#: Values are looked up in blocks of so many; all are broadcast up to so many (8 bytes each), beyond it draws are shuffled to their blocks.
BLOCK_VALUES, BROADCAST_ROWS = 4096, 4_000_000
#: Keys that share a draw's row.
KEYS_TOGETHER = 16
#: Differences that agree in so many decimals are ties.
DECIMALS = 9


def _check(rounds: int, confidence: float = 0.5) -> None:
    if rounds < 100 or not 0 < confidence < 1:
        raise ValueError("needs at least 100 rounds and a confidence in (0, 1)")


def _digest(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _rounds(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__round")


def _bound(share: Column) -> Column:
    """A digest's first 32 bits at that share of all digests."""
    return F.greatest(F.lit(0), F.least(F.lit(2**32 - 1), (share * 2.0**32).cast("long")))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one behind the other, and each one's length."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _draws(batch: pa.RecordBatch, rounds: int, seed: int, together: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As columns, per round: the count and sum of each key's rows below its border, and the rows near it, with their digests."""
    batch = batch.take(np.argsort(batch.column("__key").to_numpy(), kind="stable"))
    key, n_a, low, high, x = (batch.column(c).to_numpy() for c in ("__key", "n_a", "__low", "__high", "__x"))
    low, high, n = low.astype(np.uint32), high.astype(np.uint32), len(key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tails = batch.column("__tail").cast(pa.large_binary())
    step = max(1, together // n)
    for ahead, ids in itertools.groupby(range(rounds), lambda k: len(f"{seed}:{k}")):
        ids = np.array(list(ids), np.int32)
        heads = [f"{seed}:{k}".encode() for k in ids]
        starting = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16)[:, : -(-ahead // 4)]
        longer = pc.greater(pc.binary_length(tails), ONE_BLOCK - ahead)
        apart = np.flatnonzero(longer.to_numpy(zero_copy_only=False))
        words = [np.tile(w, step) if w.any() else 0 for w in md5_words(*_bytes(pc.if_else(longer, b"", tails)), ahead)]
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            size = len(some) * n
            message = [w if isinstance(w, int) else w[:size] for w in words]
            for i, head in enumerate(starting[at : at + step].T):
                message[i] = np.repeat(head, n) | message[i]
            digest = md5(message, size)
            if len(apart):
                texts = tails.take(pa.array(apart)).to_pylist()
                own = b"".join(hashlib.md5(head + text).digest() for head in heads[at : at + step] for text in texts)
                digest.reshape(4, -1, n)[:, :, apart] = np.moveaxis(np.frombuffer(own, "<u4").reshape(len(some), len(apart), 4), 2, 0)
            digest = digest.byteswap()  # as numbers, in the order of bytes
            first = digest[0].reshape(-1, n)
            below = first < low
            counts = np.add.reduceat(below, starts, axis=1, dtype=np.int64)
            sums = np.add.reduceat(np.where(below, x, 0.0), starts, axis=1)
            k, of = np.nonzero(counts)
            none = np.zeros(len(k), np.int64)
            yield key[starts[of]], some[k], n_a[starts[of]], none, none, sums[k, of], counts[k, of], none == 0
            spot = np.flatnonzero((first <= high) & ~below)
            k, of = np.divmod(spot, n)
            one, two, three, four = (w[spot].astype(np.uint64) for w in digest)
            longs = [((a << np.uint64(32) | b) ^ np.uint64(1 << 63)).view(np.int64) for a, b in ((one, two), (three, four))]  # in the order of signed numbers
            yield key[of], some[k], n_a[of], *longs, x[of], np.ones(len(k), np.int64), np.zeros(len(k), bool)


def _handed_on(rounds: int, seed: int, together: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the columns of ``_draws`` of all batches, in batches of about ``most`` rows."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        *columns, below = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, mask=below if i in (3, 4) else None) for i, c in enumerate(columns)], ["__key", "__round", "n_a", "__h", "__h2", "__x", "__n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                for columns in _draws(batch.slice(at, together), rounds, seed, together):
                    held.append(columns)
                    count += len(columns[0])
                    if count >= most:
                        yield rows(held)
                        held, count = [], 0
        if held:
            yield rows(held)

    return run


def _sums_near(rows: DataFrame, keys: list[str], facts: DataFrame, rounds: int, seed: int) -> DataFrame:
    """keys, round and the sum of the rows drawn, of the rounds whose border lies where it is expected."""
    n = F.col("n_a") + F.col("n_b")
    share = F.col("n_a") / n
    reach = (DEVIATIONS * F.sqrt(n * share * (1 - share)) + SLACK) / n
    bounds = facts.where("n_a > 0 AND n_b > 0").select(*keys, "__key", "n_a", _bound(share - reach).alias("__low"), _bound(share + reach).alias("__high"))
    bounded = with_scalars(rows, keys, bounds).where("n_a IS NOT NULL")
    tail = F.coalesce(F.concat(F.lit(":"), F.col("__name")), F.lit("")).cast("binary")  # what follows seed and round
    bounded = dealt(bounded.select("__key", "n_a", "__low", "__high", "__x", tail.alias("__tail")))
    drawn = bounded.mapInArrow(_handed_on(rounds, seed, DRAWS, HANDED_ON), "__key long, __round int, n_a long, __h long, __h2 long, __x double, __n long")
    ordered = Window.partitionBy("__round", "__key").orderBy("__h", "__h2", "__x").rowsBetween(Window.unboundedPreceding, 0)  # those below have no digest and come first
    before = F.sum("__n").over(ordered) - F.col("__n")
    taken = drawn.withColumn("__take", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("n_a") - before)))
    whole = F.col("__take") == F.col("__n")
    sums = taken.groupBy("__round", "__key").agg(F.sum(F.when(whole, F.col("__x"))).alias("__sum_a"), F.sum("__take").alias("__taken"), F.first("n_a").alias("n_a"), F.bool_and(F.col("__h").isNotNull() | whole).alias("__found"))
    sums = sums.where("__found AND __taken = n_a").drop("n_a")
    return (sums.join(facts.select("__key", *keys), "__key") if keys else sums).select(*keys, "__round", "__sum_a")


def _sums_ordered(rows: DataFrame, keys: list[str], facts: DataFrame, rounds: DataFrame, seed: int) -> DataFrame:
    """The same for the given rounds (keys, round), each ordered whole."""
    asked = with_scalars(rounds, keys, facts.select(*keys, "n_a"))
    asked = asked.select(*[F.col(k).alias(f"__{k}") for k in keys], "__round", "n_a")
    drawn = rows.join(asked, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else rows.crossJoin(F.broadcast(asked))  # no more than all rounds
    rank = F.row_number().over(Window.partitionBy(*keys, "__round").orderBy("__h", "__name", "__x"))
    drawn = drawn.withColumn("__h", _digest(seed, F.col("__round"), F.col("__name"))).withColumn("__rank", rank)
    return drawn.where("__rank <= n_a").groupBy(*keys, "__round").agg(F.sum("__x").alias("__sum_a"))


def permutation_pvalues(df: DataFrame, value: str, is_a: Column, name: str, *, n_permutations: int = 10_000, seed: int = 0, keys: list[str] = []) -> DataFrame:
    """Two-sided test of a difference in means between the rows where ``is_a`` holds and the others, per key.

    Returns keys, n_a, n_b, mean_a, mean_b, p_value (NaN if a side is empty); ``name`` tells the rows of a key apart.
    Null, NaN and infinite values are left out.  The sums of all rounds are a scratch table.
    """
    _check(n_permutations)
    rows = df.select(*keys, number(value).alias("__x"), is_a.alias("__a"), F.col(name).cast("string").alias("__name")).where("__x IS NOT NULL")
    facts = rows.groupBy(*keys).agg(
        F.count_if("__a").alias("n_a"), F.count_if(~F.col("__a")).alias("n_b"),
        F.avg(F.when(F.col("__a"), F.col("__x"))).alias("mean_a"), F.avg(F.when(~F.col("__a"), F.col("__x"))).alias("mean_b"), F.sum("__x").alias("__all"),
    )
    facts = scratch.table(facts.withColumn("__key", F.monotonically_increasing_id()), "permuted-groups")
    sums = scratch.table(_sums_near(rows, keys, facts, n_permutations, seed), "permuted-sums")
    every = facts.where("n_a > 0 AND n_b > 0").select(*keys, _rounds(n_permutations))
    found = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__round").alias("__found"))
    missed = every.join(found, [F.col("__round") == F.col("__found"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]], "left_anti")
    if not missed.isEmpty():
        sums = sums.unionByName(_sums_ordered(rows, keys, facts, missed, seed))
    difference = F.abs(ratio(F.col("__sum_a"), F.col("n_a")) - ratio(F.col("__all") - F.col("__sum_a"), F.col("n_b")))
    extreme = F.round(difference, DECIMALS) >= F.round(F.abs(F.col("mean_a") - F.col("mean_b")), DECIMALS)
    counted = with_scalars(sums, keys, facts).groupBy(*keys).agg(F.count_if(extreme).alias("__extreme"))
    p = (F.coalesce("__extreme", F.lit(0)) + 1) / F.lit(n_permutations + 1)
    out = with_scalars(facts, keys, counted)
    return out.select(*keys, "n_a", "n_b", "mean_a", "mean_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), p).otherwise(F.lit(float("nan"))).alias("p_value"))


def _placed(rows: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """Each row's value, its key's number, rows before that key and size, and the place (from 0) of its name's digest among the key's; ordered in ranges."""
    rows = rows.withColumn("__h", _digest(F.col("__name"))).withColumn("__range", F.substring("__h", 1, RANGE_DIGITS))
    held = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n") if keys else F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    held = with_scalars(held.select(*keys, "__range", before.alias("__before")), keys, facts.select(*keys, "__key", "__base", "n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__h", "__name", "__x")) - 1
    return with_scalars(rows.withColumn("__rank", rank), [*keys, "__range"], held).select("__key", "__base", "n", "__x", (F.col("__before") + F.col("__rank")).alias("__place"))


def bootstrap_intervals(df: DataFrame, value: str, name: str, *, n_bootstrap: int = 5000, confidence: float = 0.95, seed: int = 0, keys: list[str] = []) -> DataFrame:
    """Percentile interval of the mean, per key: keys, n, mean, ci_low, ci_high; other values as for permutations.

    Keys and places are scratch tables.  A draw depends on its round and place alone, so keys share its digest.
    """
    _check(n_bootstrap, confidence)
    rows = df.select(*keys, number(value).alias("__x"), F.col(name).cast("string").alias("__name")).where("__x IS NOT NULL")
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    by = Window.orderBy(*keys or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, 0)  # a row per key
    facts = scratch.table(facts.select("*", (F.count("*").over(by) - 1).alias("__key"), (F.sum("n").over(by) - F.col("n")).alias("__base")), "sampled-groups")
    placed = scratch.table(_placed(rows, keys, facts), "sampled-places")
    spot = F.col("__base") + F.col("__place")  # among the values of all keys
    blocks = placed.select(F.expr(f"(__base + __place) DIV {BLOCK_VALUES}").alias("__block"), F.struct(spot.alias("at"), F.col("__x").alias("x")).alias("__v"))
    blocks = blocks.groupBy("__block").agg(F.transform(F.sort_array(F.collect_list("__v")), lambda v: v["x"]).alias("__values"))
    if placed.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    places = placed.groupBy("__place", F.expr(f"__key DIV {KEYS_TOGETHER}").alias("__some")).agg(F.collect_list(F.struct("__key", "__base", "n")).alias("__keys"))
    digest = F.conv(F.substring(_digest(seed, F.col("__round"), F.col("__place")), 1, PLACE_DIGITS), 16, 10).cast("long")
    draws = dealt(places).select("__place", "__keys", _rounds(n_bootstrap)).select("__round", digest.alias("__draw"), "__keys")
    draws = draws.select("__round", "__draw", F.explode("__keys").alias("__of")).select("__round", F.col("__of.__key").alias("__key"), (F.col("__of.__base") + F.col("__draw") % F.col("__of.n")).alias("__at"))
    draws = draws.select("__round", "__key", F.expr(f"__at DIV {BLOCK_VALUES}").alias("__block"), (F.col("__at") % BLOCK_VALUES).cast("int").alias("__in"))
    means = draws.join(blocks, "__block").groupBy("__key", "__round").agg(F.avg(F.get("__values", F.col("__in"))).alias("__mean"))
    tail = (1 - confidence) / 2
    ends = means.groupBy("__key").agg(F.percentile("__mean", tail).alias("ci_low"), F.percentile("__mean", 1 - tail).alias("ci_high"))
    return facts.join(ends, "__key", "left").select(*keys, "n", "mean", "ci_low", "ci_high")
