"""Operator 3, n-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word shingles: those that many documents have last,
both kinds in the order of the hash.  Two sets with similarity of at least ``p`` share a token of their prefixes,
the first ``n - ceil(p n) + 1`` tokens, so only sets of nearly all frequent tokens have such in their prefixes.

* Tokens that few documents have in their prefixes are indexed singly.
* Where all shared prefix tokens are frequent, the prefix is extended to the whole set and combinations of
  tokens are indexed instead: the tokens of a set fall into more than ``d + 1`` classes by their hash, ``d`` being
  the largest symmetric difference that the similarity allows at that size, so in one class at least both sets
  have the same combination.  Classes without a token are left out where one with tokens is sure to agree.
  The k tokens of a combination are thus those of a class, not every k of a prefix: at 80 % and 500 tokens, two
  of the 102 tokens of a prefix extended by one give 5151 keys a set, the classes 260.
* Equal sets are one class from the start.  Candidates that parity sketches don't rule out are verified with
  the whole sets.
* Sets that share a combination with many others form a cluster.  Each is first compared with a few hubs, which
  links most of a cluster of copies.  Only sets outside a cluster's largest component then meet the rest of it,
  in blocks of bounded size, by their sketches: first as many pairs as connect a block, then pairs of sets that
  no link connects yet.  So what grows with the square of a cluster is what its hubs left apart.

Defined results: null texts and texts without words have the empty set and link with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat an id each get their
row, whose component is the least id reached by its own text; other columns are not read; a row with a null id takes part through
equal sets of rows that have one, and else has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm._common import documents, materialize, scratch_scope, unused
from lumenframe.llm._memory import claim, sliced
from lumenframe.llm._pieces import _Index
from lumenframe.llm.components import connected_components

#: A prefix token of more documents is frequent; a combination of more sets is verified in blocks.
FREQUENT, HOT = 32, 48
#: Rows of one 8-byte key that may be broadcast (about 64 MB as a hash table); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Hubs that a set of a cluster is compared with, before the blocks.
HUBS = 3
#: Sets and tokens of one verification block at most (a larger set is a block of its own).
BLOCK_SETS, BLOCK_TOKENS = 256, 400_000
#: Frequent tokens that are ordered last, at most (sent to each task); any others stay in the order of the hash.
MAX_FREQUENT = 1_000_000
#: Characters of text whose tokens are counted in one group, and tokens that a task collects before it sends them.
COUNTED_CHARS, COUNTED_TOKENS = 8_000_000, 200_000
#: Bytes that the cache of hashed words holds of one, besides its characters, about, and of all (a hash is made quickly).
WORD_BYTES, WORDS_BYTES = 150, 48 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _Words:
    """Hashes of words, each distinct one hashed once per Python worker."""

    def __init__(self) -> None:
        self.index, self.hashes, self.held = _Index(), np.empty(0, np.uint64), 0

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z and the six white-space characters alone
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = self.index.pending
        if new:
            n = len(self.index)
            if n > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty(max(n, 2 * len(self.hashes)) - len(self.hashes), np.uint64)])
            self.hashes[n - len(new) : n] = [xxhash.xxh3_64_intdigest(w) for w in new]
            self.held += WORD_BYTES * len(new) + sum(map(len, new))
            new.clear()
        out = self.hashes[at]
        if self.held > WORDS_BYTES:
            self.__init__()
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * _M3
    return x ^ x >> np.uint64(29)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = claim("words", _Words).of(text or "")
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k if k < words else 0))
    for i in range(k):
        h = mixed(h * _M1 + w[i : len(w) - k + 1 + i] * _M2)
    return np.unique(h)


def token_codes(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Group and 32 bits of each token: what tokens are counted by."""
    return (tokens >> np.uint64(32)) % np.uint64(groups) << np.uint64(32) | tokens & np.uint64(0xFFFFFFFF)


def frequent_tokens(df: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Sorted codes of the tokens that more than ``FREQUENT`` rows have, and the number of groups that codes are made with.

    A rare token whose code is also another's can count as frequent; any order that holds for all sets is right.
    """
    chars = df.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    groups = max(64, -(-chars // COUNTED_CHARS))
    most = FREQUENT + 1

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            codes, times = np.unique(token_codes(np.concatenate(held), groups), return_counts=True)
            codes = np.repeat(codes, np.minimum(times, most))  # more needn't be told apart
            group = (codes >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(group, np.arange(groups + 1))
            low = codes.astype(np.uint32)
            used = np.flatnonzero(edge[1:] > edge[:-1])
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([low[edge[g] : edge[g + 1]].tobytes() for g in used], pa.binary())], ["group", "low"])

        held, many = [], 0
        for batch in sliced(batches):
            for text in batch.column("text"):
                held.append(shingles(text.as_py(), words))
                many += len(held[-1])
                if many >= COUNTED_TOKENS:
                    yield packed()
                    held, many = [], 0
        if many:
            yield packed()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        low, times = np.unique(np.frombuffer(b"".join(pdf["low"]), np.uint32), return_counts=True)
        often = times >= most
        return pd.DataFrame({"code": int(pdf["group"].iloc[0]) << 32 | low[often].astype(np.int64), "times": times[often]})

    counted = df.select("text").mapInArrow(collect, "group long, low binary").groupBy("group").applyInPandas(count, "code long, times long")
    codes = counted.orderBy(F.desc("times"), "code").limit(MAX_FREQUENT).select("code").toPandas()["code"]
    return np.sort(codes.to_numpy(np.uint64)), groups


def rare_first(tokens: np.ndarray, frequent: tuple[np.ndarray, int]) -> np.ndarray:
    codes, groups = frequent
    if not len(codes):
        return tokens
    own = token_codes(tokens, groups)
    often = codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] == own
    return np.concatenate([tokens[~often], tokens[often]])


def prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - -(-percent * n // 100) + 1] if n else tokens


def combinations(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the token combinations of a set, for its own size class and the next."""
    n = len(tokens)
    if not n:
        return tokens
    width = np.log(100 / percent) * 1.0001  # sizes that can be similar are one class apart at most
    own = int(np.log(n) / width)
    spread, out = mixed(tokens * _M1), []
    for size_class in (own, own + 1):
        largest = int(np.exp((size_class + 1) * width)) + 1
        apart = 2 * largest * (100 - percent) // (100 + percent)
        parts = apart + 3 + apart // 6  # about as many more as stay empty
        part = (tokens % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread[order])])  # sums wrap around
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(part, minlength=parts))])
        label = np.arange(parts, dtype=np.uint64) * _M2 + np.uint64(size_class)
        keys, full = mixed(mixed(label) + total[edge[1:]] - total[edge[:-1]]), edge[1:] > edge[:-1]
        # At least parts - apart of them agree: more than are empty, so one that agrees has tokens.
        out.append(keys[full] if parts - apart - int((~full).sum()) >= 1 else keys)
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hash classes, one or two bits a token: two sketches differ in no more bits than the sets in tokens."""
    bits = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((mixed(tokens ^ _M2) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets; the longer sketch is folded to the shorter one's length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def signatures(df: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, int]) -> DataFrame:
    """doc_id, n, digest of the set, cls (its first 8 bytes), prefix tokens and a parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(np.frombuffer(b"".join(d[:8] for d in digests), "<i8")),
                    _longs([prefix(rare_first(s, frequent), percent) for s in sets]),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "digest", "cls", "prefix", "sketch"],
            )

    schema = "doc_id long, n int, digest binary, cls long, prefix array<long>, sketch binary"
    return df.select("doc_id", "text").mapInArrow(run, schema)


def _own_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """cls and sets, from (cls, digest, text); texts of another digest (of a repeated id) are left out."""
    for batch in sliced(batches):
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        own = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column("digest").to_pylist())]
        yield batch.column("cls").filter(pa.array(own, pa.bool_())), [s for s, x in zip(sets, own) if x]


def token_sets(df: DataFrame, words: int) -> DataFrame:
    """cls, n and the tokens, from (cls, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, sets in _own_sets(batches, words):
            columns = [cls, pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "tokens"])

    return df.select("cls", "digest", "text").mapInArrow(run, "cls long, n int, tokens binary")


def combination_keys(df: DataFrame, words: int, percent: int) -> DataFrame:
    """cls, n and the combinations, from (cls, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, sets in _own_sets(batches, words):
            columns = [cls, pa.array([len(s) for s in sets], pa.int32()), _longs([combinations(s, percent) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "keys"])

    return df.select("cls", "digest", "text").mapInArrow(run, "cls long, n int, keys array<long>")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _limited(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df``, marked for broadcast if it is small enough."""
    small = df.count() <= BROADCAST_ROWS
    return (F.broadcast(df) if small else df), small


def _bucket_pairs(postings: DataFrame, key: str, percent: int) -> DataFrame:
    """Distinct pairs of classes under one key whose sizes can be similar; keys have few classes."""
    x, y = (postings.select(key, F.col("cls").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    fits = (F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return x.join(y, key).where(fits).select("a", "b")


def candidates(sig: DataFrame, percent: int, keys_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and postings (key, cls, n) of the combinations that are verified in blocks.

    ``keys_of`` gives (cls, n, keys) of the classes (cls) that combinations are needed of.
    """
    tokens = sig.select(F.explode("prefix").alias("token"), "cls", "n")
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    spread = materialize(spread.where("lo <> hi").select("token", "df"), "prefix-tokens")
    postings = materialize(tokens.join(_limited(spread)[0], "token"), "prefix-postings")
    rare = postings.where(F.col("df") <= FREQUENT).select("token", "cls", "n").distinct()
    pairs = _bucket_pairs(rare, "token", percent)

    dense = materialize(postings.where(F.col("df") > FREQUENT).select("cls").distinct(), "frequent-classes")
    keys = materialize(keys_of(dense), "combination-keys")
    keys = keys.select(F.explode("keys").alias("key"), "cls", "n")
    spread = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    spread = materialize(spread.where("lo <> hi").select("key"), "combinations")
    keys = materialize(keys.join(_limited(spread)[0], "key", "left_semi").distinct(), "combination-postings")
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("classes")), "combination-sizes")
    hot, _ = _limited(materialize(sizes.where(F.col("classes") > HOT).select("key"), "hot-combinations"))
    pairs = pairs.union(_bucket_pairs(keys.join(hot, "key", "left_anti"), "key", percent)).distinct()
    return materialize(pairs, "pairs"), materialize(keys.join(hot, "key", "left_semi"), "hot-postings")


def _joined(pairs: DataFrame, values: DataFrame, column: str, keep: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) for whose values ``keep`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([keep(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    with_b = pairs.join(values.select(F.col("cls").alias("b"), F.col(column).alias("y")), "b")
    both = with_b.join(values.select(F.col("cls").alias("a"), F.col(column).alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sketches don't rule out: no similar pair is lost."""
    sized = sketches.select("cls", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), F.col("sketch")).alias("sized"))

    def keep(x: bytes, y: bytes) -> bool:
        together = int.from_bytes(x[:8], "big") + int.from_bytes(y[:8], "big")
        return sketch_difference(x[8:], y[8:]) * (100 + percent) <= together * (100 - percent)

    return _joined(pairs, sized, "sized", keep)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar."""

    def keep(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = shared(a, b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    return _joined(pairs, sets, "tokens", keep)


def near_in_blocks(sketches: list[bytes], sizes: np.ndarray, labels: np.ndarray, first: int, percent: int, forest: bool) -> list[tuple[int, int]]:
    """Pairs that their sketches don't rule out, of the first ``first`` sets with the others (of all if ``first`` is 0),
    with different labels; with ``forest``, only as many, the likeliest first, as connect what all of them connect."""
    lengths = np.array([len(x) for x in sketches])
    rows = np.arange(first or len(sketches))
    columns = np.arange(first, len(sketches))
    found, distance = [], []
    for la in np.unique(lengths[rows]):
        for lb in np.unique(lengths[columns]):
            x, y = rows[lengths[rows] == la], columns[lengths[columns] == lb]
            a, b = (np.frombuffer(b"".join(sketches[i] for i in side), np.uint64).reshape(len(side), -1) for side in (x, y))
            while a.shape[1] > b.shape[1]:
                a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            while b.shape[1] > a.shape[1]:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            apart = np.zeros((len(x), len(y)), np.int64)
            for k in range(a.shape[1]):
                apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
            na, nb = sizes[x][:, None], sizes[y][None, :]
            keep = (apart * (100 + percent) <= (na + nb) * (100 - percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (labels[x][:, None] != labels[y][None, :])
            if not first:
                keep &= x[:, None] < y[None, :]
            i, j = np.nonzero(keep)
            found.append(np.stack([x[i], y[j]], axis=1))
            distance.append(apart[i, j] / (sizes[x[i]] + sizes[y[j]]))
    pairs = np.concatenate(found)
    if not forest:
        return [tuple(p) for p in pairs.tolist()]
    first_of: dict[int, int] = {}
    root = [first_of.setdefault(label, i) for i, label in enumerate(labels.tolist())]  # what has one label is connected

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs[np.argsort(np.concatenate(distance), kind="stable")].tolist():
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            out.append((i, j))
    return out


def hub_pairs(hot: DataFrame) -> DataFrame:
    """(a, b, keys): each set b of the hot postings with the least set of each combination that it has, and how often."""
    hubs, _ = _limited(materialize(hot.groupBy("key").agg(F.min("cls").alias("a")), "hubs"))
    pairs = hot.join(hubs, "key").where("a <> cls").groupBy("a", F.col("cls").alias("b")).agg(F.count("*").alias("keys"))
    return materialize(pairs, "hub-pairs")


def nearest_hubs(pairs: DataFrame) -> DataFrame:
    """The few hubs (a) of each set (b) that it shares most combinations with."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("keys"), "a"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("a", "b")


def blocks(members: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets (component, id, n, label, block) of the clusters that ``labels`` (id, component) leave in parts, and the
    block pairs to look at: those with a set outside its cluster's largest part."""
    own = members.join(labels.select("id", F.col("component").alias("found")), "id", "left")
    own = materialize(own.select("component", "id", "n", F.coalesce("found", "id").alias("label")), "labelled")
    parts = own.groupBy("component", "label").agg(F.count("*").alias("sets"))
    largest = parts.groupBy("component").agg(F.max_by("label", F.struct("sets", "label")).alias("largest"), F.count("*").alias("parts"))
    largest, _ = _limited(materialize(largest.where("parts > 1").select("component", "largest"), "largest-parts"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))  # equal sizes are ranked in parts, not in one task
    own = own.join(largest, "component").withColumn("inside", F.col("label") == F.col("largest")).withColumn("part", part)
    # Outside sets first, then in the order of size: blocks hold so many sets and tokens at most; ranks come from counts.
    keys = ["component", "inside", "n", "part"]
    sizes = own.groupBy(*keys).agg(F.count("*").alias("many"))
    upto = Window.partitionBy("component").orderBy("inside", "n", "part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("base", F.sum("many").over(upto) - F.col("many")).withColumn("tokens", F.sum(F.col("many") * F.col("n")).over(upto) - F.col("many") * F.col("n"))
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1
    number = F.floor((F.col("base") + F.col("spot")) / BLOCK_SETS) + F.floor((F.col("tokens") + F.col("spot") * F.col("n")) / BLOCK_TOKENS)
    placed = own.withColumn("spot", spot).join(materialize(sizes, "block-sizes"), keys)
    placed = materialize(placed.select("component", "id", "n", "label", "inside", number.alias("block")), "blocks")
    ranges = placed.groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("inside").alias("inside"))
    left, right = ranges.alias("l"), ranges.alias("r")
    fits = (F.col("l.block") <= F.col("r.block")) & (100 * F.col("l.hi") >= percent * F.col("r.lo")) & (100 * F.col("r.hi") >= percent * F.col("l.lo"))
    tasks = left.where("NOT inside").alias("l").join(right, F.col("l.component") == F.col("r.component")).where(fits)
    tasks = tasks.select(F.col("l.component").alias("component"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    return placed, materialize(tasks, "block-pairs")


def block_candidates(placed: DataFrame, tasks: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidates (a, b) of the block pairs, between sets of different labels: all, or as many as connect them."""
    own = placed.join(sketches.select(F.col("cls").alias("id"), "sketch"), "id").select("component", "block", "id", "n", "label", "sketch")
    sides = tasks.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "id"], kind="stable")
        first = 0 if pdf["i"].iloc[0] == pdf["j"].iloc[0] else int((pdf["block"] == pdf["i"]).sum())
        ids = pdf["id"].to_numpy()
        found = near_in_blocks(pdf["sketch"].tolist(), pdf["n"].to_numpy(np.int64), pdf["label"].to_numpy(), first, percent, forest)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]}, dtype=np.int64)

    return sides.join(own, ["component", "block"]).groupBy("component", "i", "j").applyInPandas(run, "a long, b long").distinct()


def similarity_components(df: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, for links of Jaccard similarity ``percent`` / 100 or more."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with scratch_scope(df.sparkSession, "signatures", "named-classes"):
        every = materialize(signatures(source, words, percent, frequent_tokens(source, words)), "signatures")
        named = materialize(_named_classes(source, every.where("n > 0"), words, percent), "named-classes")
    rows = every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.join(named, "digest", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def _named_classes(source: DataFrame, sig: DataFrame, words: int, percent: int) -> DataFrame:
    """(digest, component_id) of the classes of equal sets."""
    classes = materialize(sig.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("cls").alias("cls"), F.first("n").alias("n")), "classes")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """cls, digest and text of some classes."""
        wanted = classes.join(wanted, "cls").select(F.col("rep").alias("doc_id"), "cls", "digest")
        return source.join(_limited(materialize(wanted, f"wanted-{name}"))[0], "doc_id").select("cls", "digest", "text")

    pairs, hot = candidates(sig, percent, lambda dense: combination_keys(texts_of(dense, "frequent"), words, percent))
    # Sketches first: whole sets are then needed of few classes.
    ends = lambda p: p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls")))
    paired = ends(pairs).union(hot.select("cls")).distinct()
    paired = _limited(materialize(classes.join(paired, "cls").select("digest", F.col("rep").alias("doc_id")), "paired"))[0]
    sketches = sig.join(paired, ["digest", "doc_id"], "left_semi").select("cls", "n", "sketch").dropDuplicates(["cls", "sketch"])
    sketches = materialize(sketches, "sketches")

    def checked(candidates: DataFrame, name: str) -> DataFrame:
        """The similar ones of some candidates, by the whole sets."""
        candidates = materialize(candidates, f"near-pairs-{name}")
        sets = materialize(token_sets(texts_of(ends(candidates).distinct(), name), words), f"token-sets-{name}")
        return materialize(similar(candidates, sets, percent), f"links-{name}")

    hubs = hub_pairs(hot)
    reached = connected_components(checked(near(pairs.union(nearest_hubs(hubs)).distinct(), sketches, percent), "first"))
    if not hot.isEmpty():
        # Clusters: classes connected by hot combinations.
        members = connected_components(hubs.select("a", "b")).join(hot.groupBy(F.col("cls").alias("id")).agg(F.first("n").alias("n")), "id")
        members = materialize(members.select("component", "id", "n"), "members")
        for name, forest in (("forests", True), ("rest", False)):
            placed, tasks = blocks(members, reached, percent)
            links = checked(block_candidates(placed, tasks, sketches, percent, forest), name)
            if not links.isEmpty():
                reached = connected_components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
    # Class names to the least document id of the component.
    named = classes.join(reached, classes.cls == reached.id, "left").select("digest", "rep", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("digest", "component_id")


def drop_near_copies(df: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """One document of each component stays, that with the smallest id; all columns stay."""
    found = similarity_components(df, id_col=id_col, **options)
    # An id that repeats is dropped only if none of its texts stays.
    (name,) = unused(df, "gone")
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select(F.col("doc_id").alias(name))
    return df.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir), words=3, percent=90)


ORACLE_SQL: dict[str, str] = {}
