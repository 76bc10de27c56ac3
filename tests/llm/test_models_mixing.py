"""Language ID, toxicity, mixing and sharding: held-out accuracy, brute force and laws."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import language_id, mixing, sharding, toxicity

VOICES = {"en": "the ing tion ed of ther", "de": "der ung sch ein ich keit", "fr": "le eau que ment aux oi", "es": "el ción os ado mente que"}


def prose(rng, lang, n=60):
    parts = VOICES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(rng.choices(list(VOICES), k=240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 3 <> 0"))
    out = {r["doc_id"]: r for r in language_id.predict_language(df, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "x" * 100_000), (4, "eau que")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict_language(odd, model).orderBy("doc_id").collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == 5 and got[3][1] != "und"
    assert language_id.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict_language(odd, None).collect()} == {"und"}
    alone = language_id.train(df.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in language_id.predict_language(df, alone).collect()} == {"fr"}


def test_families_come_first():
    rng, x = np.random.default_rng(0), []
    langs = ["en", "de", "ja", "fr", "es", "ru"] * 20
    for k, _ in enumerate(langs):
        v = rng.random(64) * 0.1
        v[k % 6 * 10 : k % 6 * 10 + 5] += 1
        x.append(v / v.sum())
    model = language_id.fit(np.array(x, np.float32), langs)
    assert model.families == ["germanic", "ja", "romance", "slavic"] and ("de", "en") in model.machines and ("de", "fr") not in model.machines


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        lang, bad = rng.choice(list(VOICES)), int(rng.random() < 0.25)
        words = prose(rng, lang).split()
        if bad:
            words[rng.randrange(60)] = {"en": "grubber,", "de": "zorkig" + rng.choice(["e", "en"]), "fr": "vilbax", "es": "chupro"}[lang]
        rows.append((i, " ".join(words)))
        labels.append((i, bad if i % 17 else None))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(marks))
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(i, y) for i, y in labels if y is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= 0.3) == bool(y) for i, y in held]) > 0.95
    left = toxicity.drop_toxic(docs.withColumn("extra", F.lit(1)), marks)
    assert left.columns == ["doc_id", "text", "extra"] and 250 < left.count() < 340
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "grubber " * 9000)], "doc_id long, text string")
    got = toxicity.score_toxicity(odd, model).orderBy("score").collect()
    assert got[0]["score"] == got[1]["score"] < 0.3 < got[2]["score"]
    assert toxicity.train(docs, toxicity.training_labels(marks.where("toxic = 0"))) is None
    assert toxicity.score_toxicity(odd, None).agg(F.max("score")).first()[0] == 0


def test_a_stem_counts_as_often_in_scores_as_in_the_fit():
    model = toxicity.Model({"grub": 0.2, "grubb": 0.1, "zork": 0.4}, [["zork"]], [0.0] * 12, -4.0)
    texts = ["grubs " * n + end for n in (0, 1, 7, 8, 9, 40) for end in ("", "zorka grubber", "Zork, " * 30)]
    for text, score in zip(texts, model.scores(texts)):
        times = {s: min(8, sum(s in toxicity.stems(w.lower()) for w in text.split())) for s in model.weights}
        assert abs(score - 1 / (1 + np.exp(4.0 - sum(model.weights[s] * n for s, n in times.items())))) < 1e-12


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.3
    draw = rng.random((2000, 3))
    good, weak, other = np.where(y[:, None], draw < [0.9, 0.6, 0.7], draw < [0.02, 0.12, 0.04]).T
    ballots = np.stack([good, weak, weak, weak, other], axis=1).astype(int)
    found = toxicity.label_model(ballots)
    right = np.mean((found.posterior > 0.5) == y)
    assert right > 0.85 > np.mean((ballots.sum(axis=1) >= 3) == y)
    linked = {frozenset((j, p)) for j, p in enumerate(found.parent) if p >= 0}
    assert sum(pair <= {1, 2, 3} for pair in linked) == 2  # the voters that repeat one another hang together


def test_label_model_against_plain_loops(monkeypatch):
    """Without dependencies the model is naive Bayes: one round by hand after another."""
    monkeypatch.setattr(toxicity, "DEPENDENCY", np.inf)
    ballots = np.array([[1, 1, 0], [1, 0, 0], [0, 0, -1], [0, 1, 0], [0, 0, -1], [0, 0, -1], [1, 1, 0]])
    posterior = [0.9 if sum(b) > 0 else 0.05 if sum(b) < 0 else 0.2 for b in ballots.tolist()]
    prior = 0.1
    for _ in range(3):
        tables = []
        for toxic in (0, 1):
            strength = toxicity.TOXIC_BELIEF if toxic else toxicity.CLEAN_BELIEF * len(ballots)
            table = []
            for j in range(3):
                against = (ballots[:, j] < 0).any()
                belief = ([0.05, 0.95, 0.0] if against else [0.0, 0.8, 0.2]) if toxic else ([0.9, 0.1, 0.0] if against else [0.0, 0.99, 0.01])
                n = [sum((p if toxic else 1 - p) for b, p in zip(ballots[:, j], posterior) if b == v) + strength * belief[v + 1] + 1e-3 for v in (-1, 0, 1)]
                table.append([x / sum(n) for x in n])
            tables.append(table)
        posterior = []
        for b in ballots.tolist():
            odds = prior / (1 - prior) * np.prod([tables[1][j][v + 1] / tables[0][j][v + 1] for j, v in enumerate(b)])
            posterior.append(odds / (1 + odds))
        prior = min(0.9, max(0.005, np.mean(posterior)))
    found = toxicity.label_model(ballots, rounds=3)
    assert np.allclose(found.posterior, posterior) and abs(found.prior - prior) < 1e-9


def test_pattern_voters():
    voters = toxicity.Voters([["grubber$"]])
    said = lambda text: {n for n, v in zip(voters.names, ballot(voters, text)) if v}
    assert said("you grubber") == {"lexicon 0"} and said("gr\u00fcbber fine") == {"clean"}
    assert "disguised" in said("you gr*bber g-r-u-b-b-e-r") and "spaced" in said("g-r-u-b-b-e-r")
    assert "disguised" in said("1d10t") and said("idiot") == {"seeds en", "seeds de", "seeds fr"}
    assert {"stretched", "burst"} <= said("soooo what!!") and "several" in said("idiot idiot idiot")
    assert "shouting" in said("WHAT IS THIS THING HERE NOW") and "spelled" in said("b a d z x") and "spelled" not in said("a b c")
    assert said("") == {"clean"}


def ballot(voters, text):
    table = toxicity.WordScorer(3, voters.part, flagged=True)
    at, counts = table.words(["x y z", text])
    return voters.ballots(table.bits[at], counts, toxicity.added(table.values[at], counts, np.add))[1]


def water(budget, nodes):
    """Brute-force filling: (weight, capacity) -> shares."""
    share, open_ = [0.0] * len(nodes), {i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        total = sum(nodes[i][0] for i in open_)
        step = min(budget / total, min((nodes[i][1] - share[i]) / nodes[i][0] for i in open_))
        for i in open_:
            share[i] += step * nodes[i][0]
        budget -= step * total
        open_ = {i for i in open_ if nodes[i][1] - share[i] > 1e-9}
    return share


def test_budgets_against_brute_force(spark):
    rng = random.Random(4)
    leaves = [(f"d{d}", f"l{k}", f"s{s}", rng.randint(1, 900), 5) for d in range(3) for k in range(rng.randint(1, 3)) for s in range(rng.randint(1, 4))]
    leaves += [("d3", "l0", "s0", 900, 5), ("d4", "l0", "s0", 70, 5), ("d4", "l1", "s0", 5000, 5)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    weights = [(1, "d0", None, None, 3.0), (2, "d1", "l0", None, 2.5), (3, "d0", "l0", "s0", 4.0), (1, "d2", None, None, 0.5)]
    weights += [(3, "d3", "l0", "s0", 0.0), (2, "d4", "l1", None, 0.0)]  # what they can't take goes to other domains
    given = {tuple(x for x in w[1:4] if x): w[4] for w in weights}
    wt = spark.createDataFrame(weights, "level int, domain string, lang string, source string, weight double")

    def capacity(path, epochs):
        """What can be spent below a node: only children of positive weight count."""
        if len(path) == 3:
            return next(x[3] for x in leaves if x[:3] == path) * epochs
        kids = {x[: len(path) + 1] for x in leaves if x[: len(path)] == path}
        return sum(capacity(kid, epochs) for kid in kids if given.get(kid, 1.0) > 0)

    for share, epochs in ((0.3, 1), (0.4, 1), (0.9, 3)):
        total = int(sum(x[3] for x in leaves) * share)

        def divide(path, budget):
            depth = len(path)
            if depth == 3:
                return {path: budget}
            kids = sorted({x[: depth + 1] for x in leaves if x[:depth] == path})
            caps = [capacity(kid, epochs) for kid in kids]
            out = {}
            for kid, part in zip(kids, water(budget, [(given.get(kid, 1.0), c) for kid, c in zip(kids, caps)])):
                out |= divide(kid, part)
            return out

        want = divide((), float(total))
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(table, wt, F.lit(total), epochs).collect()}
        assert all(abs(got.get(k, 0) - v) <= 1 for k, v in want.items())


def test_mixture_takes_whole_epochs_and_a_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, "w " * (i % 7), ["en", "de", None][i % 3], f"src{i % 2}", "x", i) for i in range(90)] + [(90, None, "en", None, "x", 0), (90, None, "en", None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget string, Tie int")
    for fraction, epochs in ((0.5, 1), (2.2, 3)):
        out = mixing.mix(df, budget_fraction=fraction, max_epochs=epochs).toPandas()
        assert len(out) == len(rows)
        for _, leaf in out.groupby(["domain", "lang", "source"], dropna=False):
            used = int((leaf["copies"] * leaf["n_tokens"]).sum())
            assert used <= leaf["budget"].iloc[0] or used == 0
            left = leaf[~leaf["in_partial"]]
            if len(left) and leaf["budget"].iloc[0] > 0:
                assert leaf["budget"].iloc[0] - used < max(7, leaf["n_tokens"].max() + 1)
    clash = df.select("doc_id", "text", "lang", "source", F.lit(5).alias("copies"), F.lit(6).alias("row_number"), F.lit(7).alias("Row"))
    assert mixing.select_mixture(clash).columns == clash.columns
    assert {tuple(r)[4:] for r in mixing.select_mixture(clash).collect()} == {(5, 6, 7)}
    assert mixing.mix(df.limit(0)).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_are_taken_as_often_as_planned(spark):
    rows = [(7, "a b c d", "en", "src1")] * 3 + [(8, "e f", "en", "src2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for fraction, epochs in ((0.6, 1), (1.0, 1), (1.9, 2)):
        options = {"budget_fraction": fraction, "max_epochs": epochs}
        plan = mixing.mix(df, **options).toPandas()
        left = mixing.select_mixture(df, **options).toPandas()
        assert len(left) == plan["copies"].sum() and sum(len(t.split()) for t in left["text"]) <= 14 * fraction


def test_registered_mixture_repeats_small_leaves(spark, tables):
    out = mixing.op9_mixing(spark, tables).toPandas()
    assert out["copies"].max() > 1 and (out["copies"] == 0).any() and out["full_epochs"].max() <= mixing.MAX_EPOCHS


def test_sharding(spark):
    texts = [None, "", "é", "same", "same", "y" * 70_000] * 40
    df = spark.createDataFrame([(i if i else None, t, 9, "k") for i, t in enumerate(texts)], "doc_id long, text string, part int, shard string").repartition(5)
    out = sharding.shard_rows(df, shards=7).toPandas()
    sizes = Counter(out["shard"])
    assert len(out) == 240 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for r in out.dropna(subset=["doc_id"]).itertuples():
        raw = (texts[int(r.doc_id)] or "").encode()
        assert (r.size if isinstance(r.size, int) else r[2]) == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard_rows(df.limit(0)).count() == 0


def test_matrix_margins_and_law():
    rows = [5, 0, 17, 3]
    m = sharding.communication_matrix(rows, 4, 1)
    assert m.sum(axis=1).tolist() == rows and sorted(m.sum(axis=0).tolist()) == [6, 6, 6, 7]
    many = np.array([sharding.communication_matrix([4, 4], 2, s)[0, 0] for s in range(2000)])
    want = np.array([1, 16, 36, 16, 1]) / 70  # hypergeometric
    assert np.abs(np.bincount(many, minlength=5) / 2000 - want).max() < 0.04
    left = np.array([3, 2, 1])
    assert sharding._conditional(np.random.default_rng(0), left, 6).tolist() == [3, 2, 1]
    assert (sharding._conditional(np.random.default_rng(0), left, 2) <= left).all()
