"""Operator 6, toxicity: weak supervision by many voters, a generative label model, a linear classifier.

Voters look at a text's words.  Lexicon voters are mined from labelled rows: word stems whose rate among toxic
rows is far above that among others, one voter per group of stems, besides a small fixed lexicon per language;
pattern voters look for insults in disguise (signs for letters), stretched or spelled out, for shouting, for
bursts of signs and for several strikes; one voter speaks for clean texts, where no lexicon strikes.  Voters that
strike labelled toxic rows hardly more often than others are left out.

The label model is generative: a latent label, voters that depend on it and, where they are correlated given
the label, on one other voter each (a tree of the strongest dependencies).  It starts from the voters' majority
and estimates the label's prior, each voter's accuracy and the dependencies by expectation maximisation over
the votes alone.  A logistic classifier over stem counts and votes is then trained on the model's posterior
labels, and scores every row.

Defined results: a null or empty text gets the classifier's bias; labels that are null are not used, and
of repeated labels of one id the larger counts; with no labelled toxic row every score is 0; an empty table
gives an empty result; repeated rows each get their row; other columns pass untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import documents, materialize
from lumenframe.llm._memory import sliced
from lumenframe.llm._words import WordScorer, added, scorer
from lumenframe.llm.language_id import fold

#: Labelled rows of each label, about, that voters are mined from and the models fitted on.
SAMPLE_PER_LABEL = 4000
#: Lexicon voters at most (more groups of stems share the last one), beginnings that are stems, times that a stem counts.
MAX_LEXICONS, STEM_LENGTHS, TIMES = 24, (4, 5, 6, 7), 8
#: Common insults of four languages.
SEEDS = {
    "en": "idiot moron stupid loser pathetic disgusting worthless scum trash clown",
    "de": "idiot trottel dumm abschaum widerlich wertlos depp",
    "fr": "idiot imbécile stupide minable ordure dégoûtant",
    "es": "idiota imbécil estúpido basura patético asqueroso",
}
#: Signs that stand for letters in disguised words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Times that a stem's rate among toxic rows is above that among others (with half a row more).
PURITY = 60
#: Weight of the toxic rows among all in the classifier's loss.
TOXIC_SHARE = 0.3
#: Times that a voter has to strike toxic rows more often than others to be heard.
HEARD = 2
#: Single letters in a row that spell a word; strikes of lexicons that count as several.
SPELLED, SEVERAL = 4, 3
#: Signs that stand before or after words without disguising them.
_AROUND = ".,;:!?…\"'()[]«»“”„-*#$%&"
_SUBWORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"\b(?:[^\W\d_][.\-*_]){3,}[^\W\d_]\b")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_BURST = re.compile(r"[!?]{2,}")
_PATTERNS = ("disguised", "spaced", "stretched", "burst")


def stems(word: str) -> set[str]:
    """Features of a blank-delimited word in lower case: its letter runs, whole and by their beginnings."""
    out = set()
    for part in _SUBWORD.findall(word):
        out.add(f"{part}$")
        out.update(part[:k] for k in STEM_LENGTHS if len(part) >= k)
    return out


def stem_times(text: str, known: Set[str]) -> Counter:
    """How many words of a text have each of the known stems."""
    out: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        for stem in stems(word) & known:
            out[stem] += n
    return out


def bare(word: str) -> str:
    """The letters of a word in disguise: lookalikes turned into letters, stretches cut short, other signs left out."""
    return _STRETCHED.sub(r"\1", "".join(filter(str.isalpha, word.translate(LOOKALIKES))))


def _heads(known: Iterable[str]) -> set[str]:
    """First letters of stems: a letter run that begins otherwise has none of them."""
    return {stem.rstrip("$")[: min(STEM_LENGTHS)] for stem in known}


class Voters:
    """Lexicon and pattern voters; each looks at words, and a text's votes follow from its words' flags."""

    def __init__(self, groups: list[list[str]]) -> None:
        self.groups = groups
        lexicons = [set(g) for g in groups] + [{f"{w}$" for w in words.split()} for words in SEEDS.values()]
        self.bits: dict[str, int] = {}
        for k, lexicon in enumerate(lexicons):
            for stem in lexicon:
                self.bits[stem] = self.bits.get(stem, 0) | 1 << k
        self.heads = _heads(self.bits)
        self.many = len(lexicons) + len(_PATTERNS)
        self.disguised, self.spaced, self.stretched, self.burst, self.single = (1 << len(lexicons) + k for k in range(5))
        self.strikes = 2 * self.disguised - 1  # any lexicon, in disguise or not
        #: Votes of a text: a voter of each flag, then several strikes, shouting, spelled out, clean.
        self.names = [f"lexicon {k}" for k in range(len(groups))] + [f"seeds {k}" for k in SEEDS] + list(_PATTERNS) + ["several", "shouting", "spelled", "clean"]

    def strike(self, runs: list[str]) -> int:
        """Flags of the lexicons that have a stem of these letter runs."""
        out = 0
        for run in runs:
            if run[: min(STEM_LENGTHS)] in self.heads:
                for stem in stems(run):
                    out |= self.bits.get(stem, 0)
        return out

    def part(self, word: str) -> tuple[float, float, float, int]:
        """Strikes, capitals and letters of a word, and its flags."""
        low = word.lower()
        plain = low.isalpha()
        out = self.strike([low] if plain else _SUBWORD.findall(low))
        stretched = _STRETCHED.search(low) is not None
        if stretched or not (plain or low.strip(_AROUND).isalpha()):
            if not out and self.strike([bare(low)]):
                out |= self.disguised
            if _SPACED.search(low):
                out |= self.spaced
        if stretched:
            out |= self.stretched
        if not plain and _BURST.search(word):
            out |= self.burst
        if plain and len(word) == 1:
            out |= self.single
        capitals = 0 if word == low else sum(map(str.isupper, word))
        return float(out & self.strikes > 0), float(capitals), float(len(word) if plain else sum(map(str.isalpha, word))), out

    def ballots(self, flags: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Votes of texts (1: toxic, -1: clean, 0: abstains) from the flags and summed parts of their words."""
        either = added(flags, counts, np.bitwise_or)
        out = np.zeros((len(counts), len(self.names)), np.int8)
        for k in range(self.many):
            out[:, k] = either >> np.uint64(k) & np.uint64(1)
        strikes, capitals, letters = parts.T
        out[:, -4] = strikes >= SEVERAL
        out[:, -3] = (letters > 20) & (capitals > 0.6 * letters)
        single = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags & np.uint64(self.single) > 0)])
        if len(flags) >= SPELLED:
            owner = np.repeat(np.arange(len(counts)), counts)
            run = (single[SPELLED:] - single[:-SPELLED] == SPELLED) & (owner[SPELLED - 1 :] == owner[: len(owner) - SPELLED + 1])
            out[owner[: len(run)][run], -2] = 1
        out[:, -1] = -((either & np.uint64(self.strikes)) == 0).astype(np.int8)
        return out


@dataclass
class Model:
    """A classifier over stems and votes."""

    weights: dict[str, float]
    groups: list[list[str]]
    votes: list[float]
    bias: float
    voters: Voters = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.voters = Voters(self.groups)
        self.heads = _heads(self.weights)

    def __reduce__(self) -> tuple:
        return Model, (self.weights, self.groups, self.votes, self.bias)

    @cached_property
    def name(self) -> str:
        return hashlib.sha256(repr((sorted(self.weights.items()), self.groups, self.votes, self.bias)).encode()).hexdigest()

    def part(self, word: str) -> tuple[float, ...]:
        """Summed weights of a word's stems, and what the voters say of it."""
        found = {s for run in _SUBWORD.findall(word.lower()) if run[: min(STEM_LENGTHS)] in self.heads for s in stems(run)}
        return sum(self.weights.get(s, 0.0) for s in found), *self.voters.part(word)

    def scores(self, texts: list[str]) -> np.ndarray:
        table = scorer(self.name, 4, self.part, flagged=True)
        at, counts = table.words(texts)
        sums = added(table.values[at], counts, np.add)
        ballots = self.voters.ballots(table.bits[at], counts, sums[:, 1:])
        # A stem counts ``TIMES`` times at most, as in the fit; only texts of more words with stems can exceed that.
        stemmed = added((table.values[at][:, :1] > 0).astype(np.int64), counts, np.add)[:, 0]
        for k in np.flatnonzero(stemmed > TIMES):
            seen = stem_times(texts[k], self.weights.keys())
            sums[k, 0] = sum(self.weights[s] * min(n, TIMES) for s, n in seen.items())
        raw = sums[:, 0] + ballots[:, :-1] @ np.array(self.votes) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def mine(sample: DataFrame) -> list[str]:
    """Stems of toxic rows, from (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set((text or "").lower().split())
                found[toxic > 0].update(set().union(*map(stems, words)))
        for bad in (1, 0):
            names = list(found[bad])
            times, none = pa.array([found[bad][s] for s in names], pa.int64()), pa.array([0] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *([times, none] if bad else [none, times])], ["stem", "bad", "good"])

    rows = sample.select("text", "toxic").mapInArrow(count, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.sum((F.col("toxic") <= 0).cast("long")).alias("good")).first()
    bad, good = sizes["bad"] or 0, max(1, sizes["good"] or 0)
    rows = materialize(rows.where(F.col("bad") >= max(3, bad // 200)), "toxicity-stems")
    pure = rows.where((F.col("good") + 0.5) * bad * PURITY <= F.col("bad") * good)
    return [r["stem"] for r in pure.orderBy(F.desc("bad"), "stem").collect()]  # each in a share of the bounded sample


def lexicons(mined: list[str]) -> list[list[str]]:
    """Groups of stems that begin alike, the strongest first; what is left over shares the last one."""
    groups: dict[str, list[str]] = {}
    for stem in mined:
        groups.setdefault(stem[:4], []).append(stem)
    out = list(groups.values())
    if len(out) > MAX_LEXICONS:
        out = [*out[: MAX_LEXICONS - 1], sum(out[MAX_LEXICONS - 1 :], [])]
    return out


def heard(ballots: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The ballots without the strikes of voters that hardly tell labelled toxic rows from others."""
    strikes = ballots > 0
    rates = [strikes[rows].sum(axis=0) / max(1, rows.sum()) for rows in (toxic, ~toxic)]
    return np.where(strikes & (rates[0] < HEARD * rates[1]), 0, ballots)


@dataclass
class LabelModel:
    posterior: np.ndarray  # chance of the toxic label, by row
    prior: float
    accuracy: np.ndarray  # by voter: chance that a vote cast is right
    parent: list[int]  # by voter: the voter that it depends on, or -1


#: Belief, before any vote is seen, that voters seldom strike at a clean text, as a share of the rows (which is what
#: keeps the latent label from standing for anything else that votes have in common), and of how they vote on toxic
#: ones, in rows; least dependency (nats) that is modelled.
CLEAN_BELIEF, TOXIC_BELIEF, DEPENDENCY = 0.2, 4.0, 0.002


def label_model(ballots: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over ballots (rows x voters of -1, 0, 1), from their majority."""
    rows, inverse, times = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    inverse, m = inverse.ravel(), ballots.shape[1]
    one = (rows[:, :, None] == np.array([-1, 0, 1])).astype(np.float64)
    flat = one.reshape(len(rows), 3 * m)
    against = (ballots < 0).any(axis=0)  # voters for clean texts
    belief = np.where(against[:, None], [[0.9, 0.1, 0.0]], [[0.0, 0.99, 0.01]]), np.where(against[:, None], [[0.05, 0.95, 0.0]], [[0.0, 0.8, 0.2]])
    strength = (CLEAN_BELIEF * times.sum(), TOXIC_BELIEF)
    total = rows.sum(axis=1)
    posterior = np.where(total > 0, 0.9, np.where(total < 0, 0.05, 0.2))
    parent, prior = [-1] * m, 0.1
    for _ in range(rounds):
        chances, single = [], []
        for k, chance in enumerate((1 - posterior, posterior)):
            weight = times * chance
            single.append((one * weight[:, None, None]).sum(axis=0) + strength[k] * belief[k] + 1e-3)  # voters x votes
            chances.append((flat.T @ (flat * weight[:, None])).reshape(m, 3, m, 3))
        parent = dependencies(chances, times.sum())
        evidence = np.log(prior / (1 - prior))
        for k, sign in ((0, -1), (1, 1)):
            alone = single[k] / single[k].sum(axis=1, keepdims=True)
            for j, p in enumerate(parent):
                if p < 0:
                    table = np.log(alone[j])[None, :].repeat(3, axis=0)
                else:  # votes of j given those of p, drawn to those of j alone where p's vote is seldom seen
                    n = chances[k][p, :, j, :] + strength[k] * alone[j]
                    table = np.log(n / n.sum(axis=1, keepdims=True))
                evidence = evidence + sign * table[rows[:, max(p, 0)] + 1, rows[:, j] + 1]
        posterior = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        prior = float(np.clip((times * posterior).sum() / times.sum(), 0.005, 0.9))
    right = np.where(against, single[0][:, 0], single[1][:, 2])
    cast = np.where(against, single[0][:, 0] + single[1][:, 0], single[0][:, 2] + single[1][:, 2])
    return LabelModel(posterior[inverse], prior, right / cast, parent)


def dependencies(pairs: list[np.ndarray], rows: int) -> list[int]:
    """The strongest tree of voters by their mutual information given the label; weak links are left out."""
    m = pairs[0].shape[0]
    information = np.zeros((m, m))
    for table in pairs:
        n = max(table[0, :, 0, :].sum(), 1e-9)
        both = table / n
        own = np.einsum("iaia->ia", both)
        expected = own[:, :, None, None] * own[None, None, :, :]
        information += n / rows * np.where(both > 0, both * np.log(np.maximum(both, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(axis=(1, 3))
    parent, best, inside = [-1] * m, information[0].copy(), np.zeros(m, bool)
    inside[0], source = True, np.zeros(m, np.int64)
    for _ in range(m - 1):
        j = int(np.where(inside, -1, best).argmax())
        if best[j] > DEPENDENCY:
            parent[j] = int(source[j])
        inside[j] = True
        closer = (information[j] > best) & ~inside
        best[closer], source[closer] = information[j][closer], j
    return parent


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    w = np.zeros(x.shape[1] + 1)
    look, old = w.copy(), w.copy()
    weight = weight / weight.sum()
    rate = 1 / (0.25 * float(weight @ ((x * x).sum(axis=1) + 1)) + penalty)
    for k in range(steps):
        error = weight * (y - 1 / (1 + np.exp(-np.clip(x @ look[:-1] + look[-1], -30, 30))))
        w = look + rate * np.append(error @ x - penalty * look[:-1], error.sum())
        w[:-1] = np.maximum(w[:-1], 0)  # stems and strikes never speak for a clean text
        look, old = w + k / (k + 3) * (w - old), w
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Fit on about ``per_label`` rows of each label of (doc_id, text) and (doc_id, toxic), chosen by a hash of the id."""
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1_000_000
    chosen = labels.where(draw < share[F.col("toxic")])  # about 2 x per_label ids: small by construction
    rows = df.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row of a repeated id
    sample = materialize(rows.select("doc_id", "text", "toxic"), "toxicity-sample")
    mined = mine(sample)
    groups = lexicons(mined)
    names = {s: k for k, s in enumerate(mined)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(groups)
        table = WordScorer(3, voters.part, flagged=True)
        for batch in sliced(batches):
            texts, stem, times = [t or "" for t in batch.column("text").to_pylist()], [], []
            at, counts = table.words(texts)
            ballots = voters.ballots(table.bits[at], counts, added(table.values[at], counts, np.add))
            for text in texts:
                seen = stem_times(text, names.keys())
                stem.append([names[f] for f in seen])
                times.append(list(seen.values()))
            ints = pa.list_(pa.int32())
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(ballots.tolist(), ints), pa.array(stem, ints), pa.array(times, ints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "ballot", "stem", "times"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(look, "doc_id long, toxic int, ballot array<int>, stem array<int>, times array<int>").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    ballots = np.array(rows["ballot"].tolist(), np.int64).reshape(len(rows), -1)
    ballots = heard(ballots, rows["toxic"].to_numpy() > 0)
    posterior = label_model(ballots).posterior
    x = np.zeros((len(rows), len(mined)))
    for k, (stem, times) in enumerate(zip(rows["stem"], rows["times"])):
        x[k, stem] = np.minimum(times, TIMES)
    toxic = posterior > 0.5
    weight = np.where(toxic, TOXIC_SHARE / max(1, toxic.sum()), (1 - TOXIC_SHARE) / max(1, (~toxic).sum()))
    w, bias = fit_logistic(np.concatenate([x, ballots[:, :-1]], axis=1), posterior, weight)
    return Model({s: float(v) for s, v in zip(mined, w) if v > 1e-6}, groups, w[len(mined) :].tolist(), bias)


def score_toxicity(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score.  Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score = np.zeros(len(texts)) if model is None else model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from: one row an id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2))
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


THRESHOLD = 0.3


def drop_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that the classifier doesn't reject; all columns stay."""
    model = train(df.select("doc_id", "text"), training_labels(labels))
    if model is None:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            score = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(score < THRESHOLD))

    return df.mapInArrow(run, df.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.select("doc_id", "text"), training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE_SQL: dict[str, str] = {}
