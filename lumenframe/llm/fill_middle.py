"""Operator 12, fill-in-middle transformation: a parallel automaton scan finds units and cuts, also in giant documents.

A deterministic automaton over classes of characters recognises units (lines) and the marks that must not occur.  A
chunk of a text is scanned without knowing the state it starts in: it tells, for every start state, the state it ends
in and how many units begin in it.  Such functions compose associatively; composing a document's chunks in order
resolves the state and the number of units in front of each of them.  A cut after the k-th unit lies in the one chunk
whose units include the next one's start; only these chunks are scanned again to select its position.

Texts of at most ``CHUNK_CHARS`` are one chunk, for which all of that is one pass over their batch; longer ones are
dealt out as a table of chunks.  Either way gives the same result.

Defined results: a null text counts as empty, and an empty one is plain; a null id draws as the empty string;
repeated rows each get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm._common import documents, materialize
from lumenframe.llm._memory import sliced

#: Code points of one chunk.
CHUNK_CHARS = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OPEN = "<"
SHARES = (100, 50)
_ROW = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Automaton:
    """``step[state, class]`` is the next state; a unit begins with a character read in one of the ``begins`` states."""

    step: np.ndarray
    begins: np.ndarray
    found: np.ndarray
    letters: str

    @cached_property
    def table(self) -> np.ndarray:
        """Class of each code point below 128; all others are of class 0."""
        out = np.zeros(128, np.intp)
        for k, letter in enumerate(self.letters, 1):
            out[ord(letter)] = k
        return out

    def classes(self, text: str) -> np.ndarray:
        """Classes of a chunk's characters, those of a mark only where it may have begun: behind ``<``, or before the chunk."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.where(points < 128, self.table[np.minimum(points, 127)], 0)
        begun = out == self.letters.index(OPEN) + 1
        inner = np.ones(len(out), bool)
        inner[2:] = begun[1:-1] | begun[:-2]
        return np.where((out <= 1) | begun | inner, out, 0)

    def runs(self, classes: np.ndarray) -> list[tuple[int, int]]:
        """(class, length) of what the automaton can tell apart: a run of class 0 is one step, however long."""
        special = np.flatnonzero(classes)
        edges = np.concatenate([[-1], special, [len(classes)]])
        out = []
        for gap, at in zip(np.diff(edges) - 1, edges[1:]):
            if gap:
                out.append((0, int(gap)))
            if at < len(classes):
                out.append((int(classes[at]), 1))
        return out

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The transition function of a chunk: end state and units begun, by start state."""
        state = np.arange(len(self.step))
        count = np.zeros(len(self.step), np.int64)
        for kind, length in self.runs(self.classes(text)):
            # A run of ordinary characters begins one unit at most, and its second step changes nothing any more.
            count += self.begins[state]
            state = self.step[state, kind]
            if kind == 0 and length > 1:
                state = self.step[state, 0]
        return state, count

    def starts(self, text: str, state: int) -> np.ndarray:
        """Where units begin in a chunk that is entered in ``state``."""
        out, at = [], 0
        for kind, length in self.runs(self.classes(text)):
            if self.begins[state]:
                out.append(at)
            state, at = int(self.step[state, kind]), at + length
            if kind == 0 and length > 1:
                state = int(self.step[state, 0])
        return np.array(out, np.int64)


def line_automaton() -> Automaton:
    """Lines ``[^\\n]*\\n|[^\\n]+``, and one of ``<P>``, ``<S>``, ``<M>`` anywhere.

    A state is 4 * (inside a line) + progress of a mark (nothing, ``<``, ``<`` and its letter, found).
    """
    letters = "\n<PSM>"
    step = np.zeros((8, 1 + len(letters)), np.int64)
    for inside in (0, 1):
        for mark in range(4):
            for kind in range(1 + len(letters)):
                letter = letters[kind - 1] if kind else ""
                if mark == 3 or (mark == 2 and letter == ">"):
                    new = 3
                elif mark == 1 and letter in ("P", "S", "M"):
                    new = 2
                else:
                    new = int(letter == "<")
                step[4 * inside + mark, kind] = 4 * (letter != "\n") + new
    return Automaton(step, np.arange(8) < 4, np.arange(8) % 4 == 3, letters)


LINES = line_automaton()


def _draws(row_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 digits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def form_of(empty: bool, marked: bool, h3: int, h4: int, shares: tuple[int, int]) -> str:
    if empty or marked or h3 % 100 >= shares[0]:
        return "plain"
    return "spm" if h4 % 100 < shares[1] else "psm"


def arranged(text: str, form: str, a: int, b: int) -> str:
    """The text in its form; the middle is ``text[a:b]``."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def _short(shares: tuple[int, int]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
                starts = LINES.starts(text, 0)
                n = len(starts)
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                form = form_of(not n, marked, h3, h4, shares)
                ends = np.append(starts, len(text))
                a, b = sorted((int(ends[h1 % (n + 1)]), int(ends[h2 % (n + 1)])))
                rows.append((n, form, *((None, None) if form == "plain" else (a, b - a)), arranged(text, form, a, b)))
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            for k in range(0, len(text), CHUNK_CHARS):
                piece = text[k : k + CHUNK_CHARS]
                yield pa.RecordBatch.from_pydict({"row": [row], "chunk": [k // CHUNK_CHARS], "piece": [piece]})


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [LINES.scan(piece) for piece in batch.column("piece").to_pylist()]
        ends, counts = (pa.array([f[k].tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), ends, counts], ["row", "chunk", "ends", "counts"])


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of the unit ``k`` (from 0, of those that begin in the chunk), within the document."""
    for batch in batches:
        at = [
            chunk * CHUNK_CHARS + int(LINES.starts(piece, state)[k])
            for chunk, piece, state, k in zip(*(batch.column(c).to_pylist() for c in ("chunk", "piece", "state", "k")))
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cut"), pa.array(at, pa.int64())], ["row", "cut", "position"])


def _long(docs: DataFrame, shares: tuple[int, int]) -> DataFrame:
    """Documents of several chunks: functions of chunks, composed in order, then cuts in the chunks that hold them."""
    heads = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "giants")
    chunks = materialize(heads.select("row", "text").mapInArrow(_chunks, "row long, chunk long, piece string"), "giant-chunks")
    scans = chunks.mapInArrow(_scans, "row long, chunk long, ends array<long>, counts array<long>")
    # A function is a few numbers, and a document has at most as many as a string has chunks.
    gathered = scans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends", "counts"))).alias("fs"))
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("units"), F.array().cast("array<struct<chunk:long,state:long,units:long>>").alias("seen"))
    composed = F.aggregate(
        "fs",
        start,
        lambda s, f: F.struct(
            F.element_at(f["ends"], (s["state"] + 1).cast("int")).alias("state"),
            (s["units"] + F.element_at(f["counts"], (s["state"] + 1).cast("int"))).alias("units"),
            F.concat(s["seen"], F.array(F.struct(f["chunk"].alias("chunk"), s["state"].alias("state"), s["units"].alias("units")))).alias("seen"),
        ),
    )
    composed = materialize(gathered.select("row", composed.alias("c")), "giant-functions")
    units = heads.join(composed.select("row", F.col("c.state").alias("end"), F.col("c.units").alias("n")), "row")
    marked = F.element_at(F.array(*[F.lit(bool(x)) for x in LINES.found]), (F.col("end") + 1).cast("int"))
    plain = marked | (F.col("h3") % 100 >= shares[0])
    form = F.when(plain, "plain").when(F.col("h4") % 100 < shares[1], "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    units = units.select("row", "doc_id", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    units = materialize(units, "giant-units")
    # The chunk in which the unit behind the cut begins; none if the cut is behind the last unit.
    wanted = units.where("form <> 'plain'").select("row", "n", F.posexplode(F.array("a", "b")).alias("cut", "after")).where("after < n")
    places = composed.select("row", F.explode("c.seen").alias("s"), F.col("c.units").alias("all")).select("row", "s.*")
    ends = F.lead("units").over(Window.partitionBy("row").orderBy("chunk"))
    places = places.withColumn("next", ends)
    held = places.join(wanted, "row").where("units <= after AND (next IS NULL OR after < next)")
    held = held.select("row", "chunk", "state", "cut", (F.col("after") - F.col("units")).alias("k"))
    positions = chunks.join(held, ["row", "chunk"]).select("row", "chunk", "piece", "state", "cut", "k").mapInArrow(_selected, "row long, cut int, position long")
    positions = positions.groupBy("row").agg(F.max(F.when(F.col("cut") == 0, F.col("position"))).alias("pa"), F.max(F.when(F.col("cut") == 1, F.col("position"))).alias("pb"))
    told = units.join(positions, "row", "left").join(heads.select("row", "text"), "row")
    size = F.char_length("text")
    a, b = F.coalesce("pa", size).cast("long"), F.coalesce("pb", size).cast("long")
    told = told.select("*", a.alias("cut_a"), b.alias("cut_b"))
    prefix, middle, suffix = F.expr("left(text, cut_a)"), F.expr("substring(text, cut_a + 1, cut_b - cut_a)"), F.expr("substring(text, cut_b + 1)")
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    shown = F.col("form") != "plain"
    return told.select("doc_id", "n", "form", F.when(shown, F.col("cut_a")).alias("prefix_chars"), F.when(shown, F.col("cut_b") - F.col("cut_a")).alias("middle_chars"), output.alias("output"))


def fill_middle(df: DataFrame, *, seed: int = 7, shares: tuple[int, int] = SHARES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars and the output.

    ``shares``: per cent of texts that are transformed, and of these that have the suffix first.
    """
    row_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(row_id.alias("doc_id"), text.alias("text"), *_draws(row_id, seed))
    schema = _ROW.format(id=df.schema[id_col].dataType.simpleString())
    # Code points are at most bytes, so that the scan of short texts needs no count of them.
    size = F.when(F.octet_length("text") <= CHUNK_CHARS, F.lit(0)).otherwise(F.char_length("text"))
    short = docs.where(size <= CHUNK_CHARS).mapInArrow(_short(shares), schema)
    return short.unionByName(_long(docs.where(size > CHUNK_CHARS), shares))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the first of each mark is the one that was put there."""
    body = F.substr(output, F.lit(4))
    one = F.substring_index(body, SUFFIX, 1)
    psm_rest = F.substr(body, F.char_length(one) + F.lit(4))
    psm_suffix = F.substring_index(psm_rest, MIDDLE, 1)
    psm = F.concat(one, F.substr(psm_rest, F.char_length(psm_suffix) + F.lit(4)), psm_suffix)
    suffix = F.substring_index(body, PREFIX, 1)
    spm_rest = F.substr(body, F.char_length(suffix) + F.lit(4))
    prefix = F.substring_index(spm_rest, MIDDLE, 1)
    spm = F.concat(prefix, F.substr(spm_rest, F.char_length(prefix) + F.lit(4)), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = {
    "op12_fill_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, len(parts) - CAST(parts[len(parts)] = '' AS INT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
         CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS upto
  FROM c
), q AS (
  SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(text, length(upto) + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM q
"""
}
