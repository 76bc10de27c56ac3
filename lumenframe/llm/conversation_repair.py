"""Operator 13, conversation structure repair: Dijkstra on the lattice of (turns read, grammar state).

A conversation's roles must read ``(s?(ua)+)?`` in initials.  Edits cost: Keep 0, Rerole 2, Delete 3, Insert 2, and 1
more for a truncated turn that stays; a blank or duplicate turn must go.  The lattice is never built: nodes are made
as the search pops them in the order of (cost, audit), the audit being the initials of the edits so far, and it stops
at the first accepting end node popped.  Two audits of equal cost at a node are never one the other's beginning (they
hold equally many edits of read turns, and each insertion costs), so that the least audit of a node stays the least.

Turns are sorted over the cluster by conversation and turn and cut into runs of bounded size.  A conversation that is
one run is searched at once.  A longer one, or one that lies over a border of partitions, is searched in each of its
runs from every state to every state; these tables compose in order, and the path of each run is read back from them.
So a hot conversation is sorted, searched and rewritten by many tasks; its digest alone is one stream over its runs.

Defined results: a null role or text is one space, and so has a role outside the grammar, or is blank; equal turns
of a conversation come in the order of role and text; a null conversation id is a conversation like others; repeated
rows are duplicates of one another; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import materialize, scratch_scope

#: Turns and characters of one run, about.
RUN_TURNS, RUN_CHARS = 1000, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Next state by role initial: 0 at the start, 1 behind the system turn, 2 behind a user's, 3 behind an assistant's.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
SPEAKERS = {"u": "user", "a": "assistant"}
_BLANK = r"[\x20\x09-\x0D]"
_SUMMARY = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def cheapest(initials: list[str], faults: str, entry: int = 0, every_exit: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) by exit state; ``faults`` has b, d, t or ``.`` per turn.  Without ``every_exit``, of the best accepting end alone."""
    heap, done, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(initials):
            found[state] = cost, audit
            if not every_exit and state in ACCEPTING:
                return {state: (cost, audit)}
        for speaker in SPEAKERS:
            if speaker in GRAMMAR[state]:
                heapq.heappush(heap, (cost + INSERT, audit + "I", at, GRAMMAR[state][speaker]))
        if at == len(initials):
            continue
        heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
        if faults[at] in "bd":
            continue
        stays = cost + TRUNCATED * (faults[at] == "t")
        if initials[at] in GRAMMAR[state]:
            heapq.heappush(heap, (stays + KEEP, audit + "K", at + 1, GRAMMAR[state][initials[at]]))
        for speaker in SPEAKERS:
            if speaker in GRAMMAR[state]:
                heapq.heappush(heap, (stays + REROLE, audit + "R", at + 1, GRAMMAR[state][speaker]))
    return found


def applied(roles: list[str], texts: list[str], audit: str, state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit leaves, from the state its first edit finds."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        speaker = roles[at][:1] if edit == "K" else next(s for s in GRAMMAR[state] if s in SPEAKERS)
        if edit == "I":
            yield edit, SPEAKERS[speaker], ""
        else:
            yield edit, roles[at] if edit == "K" else SPEAKERS[speaker], texts[at]
            at += 1
        state = GRAMMAR[state][speaker]


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with turns dropped, emptied, cut, repeated and re-roled by their ids' checksum."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select(
        "conv_id",
        "turn",
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Turns numbered, with ``fault``: b (blank), d (role and text seen before), t (truncated) or ``.``."""
    keyed = turns.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = materialize(keyed, "turns", "zstd")
    key = ["conv_id", "role", "digest"]
    first = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first")).where("n > 1")
    first = materialize(first.select(*key, F.col("first.row").alias("first")), "first-turns")
    same = [keyed[c].eqNullSafe(first[c]) for c in key]
    joined = keyed.join(first, same, "left").select(keyed["*"], "first")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "b").when(F.col("first") != F.col("row"), "d").when(~F.col("text").rlike(rf"[.!?]{_BLANK}*\z"), "t").otherwise(".")
    return joined.select("conv_id", "turn", "role", "text", "row", fault.alias("fault"))


def _paths(roles: list[str], faults: str, whole: bool) -> tuple[list[int], list[int], list[int], list[str]]:
    initials = [r[:1] for r in roles]
    out = [(entry, leave, cost, audit) for entry in ((0,) if whole else range(4)) for leave, (cost, audit) in cheapest(initials, faults, entry, not whole).items()]
    return tuple(map(list, zip(*out)))  # type: ignore[return-value]


def _runs(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, chars, first, held = 0, 0, True, []

        def close(last: bool) -> pa.RecordBatch:
            nonlocal number, chars, first, held
            conv, turns, roles, texts, faults = zip(*held)
            # A run at a border of the partition, or one that was cut, may go on elsewhere.
            whole = not first and not last
            entries, leaves, costs, audits = _paths(list(roles), "".join(faults), whole)
            row = [conv[0], part, number, whole, list(turns), list(roles), list(texts), "".join(faults), entries, leaves, costs, audits]
            number, chars, held = number + 1, 0, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if held and (held[-1][0] != row[0]):
                    yield close(False)
                    first = False
                elif held and (len(held) >= RUN_TURNS or chars >= RUN_CHARS):
                    yield close(True)
                    first = True
                held.append(row)
                chars += len(row[3])
        if held:
            yield close(True)

    return run


def _composed(table: pa.Table) -> pa.Table:
    """Runs of one conversation: the entry state and audit of each on the cheapest path through all of them."""
    runs = table.sort_by([("part", "ascending"), ("run", "ascending")]).to_pylist()
    ends: dict[int, tuple[int, str]] = {0: (0, "")}
    back: list[dict[int, int]] = []
    for r in runs:
        now: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for k, (entry, leave) in enumerate(zip(r["entries"], r["leaves"])):
            if entry in ends:
                total = ends[entry][0] + r["costs"][k], ends[entry][1] + r["audits"][k]
                if leave not in now or total < now[leave]:
                    now[leave], came[leave] = total, k
        ends = now
        back.append(came)
    state = min((s for s in ACCEPTING if s in ends), key=lambda s: ends[s])
    out = []
    for r, came in zip(reversed(runs), reversed(back)):
        k = came[state]
        state = r["entries"][k]
        out.append((r["part"], r["run"], state, r["costs"][k], r["audits"][k]))
    columns = list(zip(*out))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "run", "entry", "cost", "audit"), columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()))})


def repair(turns: DataFrame) -> DataFrame:
    """Runs of consecutive turns (conv_id, part, run: their order) with the edits chosen.

    Columns: ``whole`` (all of its conversation), turns, roles, texts, faults, entry (grammar state before), cost, audit.
    """
    id_type = turns.schema["conv_id"].dataType
    faulty = _faults(turns.select("conv_id", F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]))
    order = ["conv_id", "turn", "role", "text", "row"]
    ordered = materialize(faulty, "faulty-turns", "zstd").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = pa.int64() if id_type.simpleString() == "bigint" else pa.int32() if id_type.simpleString() == "int" else pa.string()
    texts = pa.list_(pa.string())
    numbers = pa.list_(pa.int64())
    schema = pa.schema(
        [("conv_id", kind), ("part", pa.int32()), ("run", pa.int64()), ("whole", pa.bool_()), ("turns", numbers), ("roles", texts), ("texts", texts),
         ("faults", pa.string()), ("entries", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("costs", numbers), ("audits", texts)]
    )
    told = (
        f"conv_id {id_type.simpleString()}, part int, run long, whole boolean, turns array<long>, roles array<string>, texts array<string>, "
        "faults string, entries array<int>, leaves array<int>, costs array<long>, audits array<string>"
    )
    runs = materialize(ordered.mapInArrow(_runs(schema), told), "runs", "zstd")
    columns = ["conv_id", "part", "run", "whole", "turns", "roles", "texts", "faults"]
    whole = runs.where("whole").select(*columns, F.lit(0).alias("entry"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    cut = runs.where("NOT whole")
    paths = cut.select("conv_id", "part", "run", "entries", "leaves", "costs", "audits").groupBy("conv_id")
    paths = materialize(paths.applyInArrow(_composed, "part int, run long, entry int, cost long, audit string"), "composed")
    return whole.unionByName(cut.select(*columns).join(paths, ["part", "run"]).select(*columns, "entry", "cost", "audit"))


def repaired_turns(runs: DataFrame) -> DataFrame:
    """Per turn left: conv_id, part, run, place (their order), edit, role, text."""
    id_type = runs.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = list(applied(r["roles"], r["texts"], r["audit"], r["entry"]))
                if left:
                    edit, role, text = zip(*left)
                    n = len(left)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["conv_id"]] * n, batch.schema.field("conv_id").type), pa.array([r["part"]] * n, pa.int32()), pa.array([r["run"]] * n, pa.int64()),
                         pa.array(range(n), pa.int32()), pa.array(edit), pa.array(role), pa.array(text)],
                        ["conv_id", "part", "run", "place", "edit", "role", "text"],
                    )

    return runs.mapInArrow(run, f"conv_id {id_type}, part int, run long, place int, edit string, role string, text string")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of runs that come in order; of a conversation, only its counts and audit are held."""
    held, kind = None, None

    def fresh(conv: object) -> dict:
        return dict(conv=conv, low=None, last=None, distinct=0, b=0, d=0, t=0, illegal=0, cost=0, audit=[], initial=None, sha=hashlib.sha256(), lines=False)

    def told(h: dict) -> tuple:
        gaps = 0 if h["low"] is None else h["last"] - h["low"] + 1 - h["distinct"]
        return h["conv"], gaps, h["b"], h["d"], h["t"], h["illegal"], h["cost"], "".join(h["audit"]), h["sha"].hexdigest()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if held is not None and held["conv"] != r["conv_id"]:
                out.append(told(held))
                held = None
            held = held or fresh(r["conv_id"])
            for turn, role, fault in zip(r["turns"], r["roles"], r["faults"]):
                if turn is not None and turn != held["last"]:
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["last"], held["distinct"] = turn, held["distinct"] + 1
                if fault != ".":
                    held[fault] += 1
                if held["initial"] is not None:
                    held["illegal"] += held["initial"] + role[:1] not in LEGAL
                held["initial"] = role[:1]
            held["cost"] += r["cost"]
            held["audit"].append(r["audit"])
            for _, role, text in applied(r["roles"], r["texts"], r["audit"], r["entry"]):
                held["sha"].update((("\n" if held["lines"] else "") + f"{role}:{text}").encode())
                held["lines"] = True
        if out:
            yield table(out)
    if held is not None:
        yield table([told(held)])


def summarize(runs: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    schema = _SUMMARY.format(id=runs.schema["conv_id"].dataType.simpleString())
    cut = runs.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")
    return runs.where("whole").mapInArrow(_summaries, schema).unionByName(cut.mapInArrow(_summaries, schema))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    with scratch_scope(spark, "repaired"):
        told = materialize(summarize(repair(damaged(rows))), "repaired")
    every = rows.select("conv_id").distinct()
    joined = every.join(told, every.conv_id.eqNullSafe(told.conv_id), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return joined.select(every.conv_id, *zero, F.coalesce("audit", F.lit("")).alias("audit"), empty)


ORACLE_SQL: dict[str, str] = {}
