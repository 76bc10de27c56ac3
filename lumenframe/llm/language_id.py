"""Operator 5, language ID: family first, then one-versus-one linear support vector machines within it.

A text is the frequencies of the hashed 1- to 4-grams of its words.  A linear machine per family separates
it from the others (none is needed for one family); within the family predicted, a machine per pair of its
languages votes.  All are fitted on a bounded, stratified sample of labelled rows; every row is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without a language are
predicted but not learned from; with no labelled row at all everything is ``und``; repeated rows each get
their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents
from lumenframe.llm._memory import sliced
from lumenframe.llm._words import scorer

#: Families of languages by their two-letter codes.  A code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "ar he mt",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BINS = 1 << 13
#: Labelled rows that the machines are fitted on, about: of each language, and in all (which bounds the driver's memory).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 400, 4000
_LETTER = re.compile(r"[^\W\d_]")


def grams(word: str) -> list[int]:
    """Bins of the 1- to 4-grams of a word within its bounds."""
    text = f"\x02{word}\x03"
    return [zlib.crc32(text[i : i + k].encode()) % BINS for k in (1, 2, 3, 4) for i in range(len(text) - k + 1)]


@dataclass
class Model:
    """Linear machines: weights over bins and a bias, by what they separate."""

    families: list[str]
    languages: dict[str, list[str]]
    machines: list[tuple[str, str]]  # (family, "") against the others, or a pair of languages
    weights: np.ndarray  # bins x machines
    bias: np.ndarray

    def key(self) -> str:
        return hashlib.sha256(self.weights.tobytes() + repr(self.machines).encode()).hexdigest()

    def part(self, word: str) -> np.ndarray:
        """A word's part of the margins, and its grams."""
        bins = grams(word)
        return np.append(self.weights[bins].sum(axis=0), len(bins))

    def predict(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias
        chance = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))
        column = {m: k for k, m in enumerate(self.machines)}
        if len(self.families) == 1:
            family, score = np.zeros(len(sums), np.int64), np.ones(len(sums))
        elif len(self.families) == 2:
            first = chance[:, column[self.families[0], ""]]
            family, score = (first < 0.5).astype(np.int64), np.maximum(first, 1 - first)
        else:
            each = chance[:, [column[f, ""] for f in self.families]]
            family, score = each.argmax(axis=1), each.max(axis=1)
        out = np.empty(len(sums), object)
        score = score.copy()
        for k, name in enumerate(self.families):
            mine, codes = family == k, self.languages[name]
            votes = np.zeros((int(mine.sum()), len(codes)))
            for a, b in combinations(range(len(codes)), 2):
                p = chance[mine, column[codes[a], codes[b]]]
                votes[:, a] += (p >= 0.5) + p / 1e3  # votes first, their margins break ties
                votes[:, b] += (p < 0.5) + (1 - p) / 1e3
            best = votes.argmax(axis=1)
            out[mine] = np.array(codes, object)[best]
            if len(codes) > 1:
                score[mine] *= np.minimum(1, votes[np.arange(len(best)), best] / (len(codes) - 1 + (len(codes) - 1) / 1e3))
        return out.tolist(), np.clip(score, 0, 1)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (2 * float((x * x).sum(axis=1).mean() + 1) + penalty)
    w = np.zeros(x.shape[1] + 1)
    look, old = w.copy(), w.copy()
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look[:-1].astype(x.dtype) + look[-1]))
        pull = share * slack * y
        w = look + rate * 2 * np.append(pull.astype(x.dtype) @ x - penalty * look[:-1] / 2, pull.sum())
        look, old = w + k / (k + 3) * (w - old), w
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """All machines, from gram frequencies."""
    codes = sorted(set(langs))
    family_of = {c: FAMILY_OF.get(c.lower(), c) for c in codes}
    families = sorted(set(family_of.values()))
    languages = {f: [c for c in codes if family_of[c] == f] for f in families}
    mean = x.mean(axis=0)
    z = x - mean
    unit = (1 / (np.sqrt((z * z).mean(axis=0)) + 1e-4) / np.sqrt(x.shape[1])).astype(x.dtype)
    z *= unit
    lang, family = np.array(langs), np.array([family_of[c] for c in langs])
    machines: list[tuple[str, str]] = []
    found: list[tuple[np.ndarray, float]] = []
    for f in families if len(families) > 2 else families[:-1]:
        machines.append((f, ""))
        found.append(fit_machine(z, np.where(family == f, 1.0, -1.0)))
    for f in families:
        for a, b in combinations(languages[f], 2):
            rows = (lang == a) | (lang == b)
            machines.append((a, b))
            found.append(fit_machine(z[rows], np.where(lang[rows] == a, 1.0, -1.0)))
    weights = np.stack([w * unit for w, _ in found], axis=1) if found else np.zeros((x.shape[1], 0))
    bias = np.array([b for _, b in found]) - mean @ weights
    return Model(families, languages, machines, weights, bias)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on about ``per_language`` rows of each language of (doc_id, text, lang), chosen by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(2, SAMPLE_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bins, values = [], []
            for text in batch.column("text").to_pylist():
                total = np.zeros(BINS)
                for word, n in Counter(text.lower().split()).items():
                    np.add.at(total, grams(word), n)
                at = np.flatnonzero(total)
                bins.append(at)
                values.append(total[at] / max(1, total.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(bins, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "bins", "values"]
            )

    rows = sample.select("text", "lang").mapInArrow(count, "lang string, bins array<int>, values array<float>").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("lang", kind="stable")
    langs, x = rows["lang"].tolist(), np.zeros((len(rows), BINS), np.float32)
    for k, (bins, values) in enumerate(zip(rows["bins"], rows["values"])):
        x[k, bins] = values
    del rows
    return fit(x, langs)


def predict_language(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score.  Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            known = [model is not None and t is not None and bool(_LETTER.search(t)) for t in texts]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if any(known):
                sums = scorer(model.key(), len(model.machines) + 1, model.part, lower=True).sums([t for t, k in zip(texts, known) if k])
                at = np.flatnonzero(known)
                found, scores[at] = model.predict(sums)
                for i, lang in zip(at.tolist(), found):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % parts, F.lit(0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


ORACLE_SQL: dict[str, str] = {}
