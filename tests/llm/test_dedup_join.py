"""Exact dedup, n-gram Jaccard join and components against brute force."""

import os
import random
from collections import Counter
from itertools import combinations

import numpy as np

from lumenframe.llm import exact_dedup, jaccard_join
from lumenframe.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp int, Digest string, row int, keep_id int"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0, "clash", 0, 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def near_texts(seed=5, families=6, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    out = [None, "", "  \n", "one", "one two", "ONE\ttwo", "one two three", " ".join(rng.choice(words) for _ in range(9000))]
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 200]))] + shared * rng.randint(0, 1)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def got(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(df, **options).collect()}


def test_join_against_brute_force(spark, monkeypatch):
    texts = near_texts()
    for k, percent in ((3, 90), (5, 80)):
        assert got(table(spark, texts), words=k, percent=percent) == brute(texts, k, percent)


def test_join_with_everything_frequent_and_hot(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    texts = near_texts(seed=8, families=3, copies=14)
    assert got(table(spark, texts), words=3, percent=90) == brute(texts, 3, 90)


def test_clusters_that_hubs_leave_apart(spark, monkeypatch):
    """Chains: each set is similar to its neighbours alone, all share their combinations' keys by force of small limits."""
    for name, value in (("FREQUENT", 2), ("HOT", 2), ("BLOCK_SETS", 3), ("HUBS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    words = [f"w{i}" for i in range(160)]
    texts = [" ".join(words[k * 3 : k * 3 + 60]) for k in range(30)] + [" ".join(reversed(words[k * 2 : k * 2 + 70])) for k in range(20)]
    for percent in (80, 90):
        assert got(table(spark, texts), words=3, percent=percent) == brute(texts, 3, percent)


def test_scratch_tables_go(spark, tmp_path):
    from lumenframe.llm import _common

    root = _common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    assert got(table(spark, near_texts(families=2)), words=3, percent=90)
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before if not n.startswith(".")} <= {"signatures", "named-classes"}


def test_join_edges(spark):
    assert jaccard_join.similarity_components(table(spark, [])).count() == 0
    out = [(r["doc_id"], r["component_id"]) for r in jaccard_join.similarity_components(table(spark, ["a b c d e f"] * 3, [4, 4, 2]), words=3, percent=90).collect()]
    assert sorted(out) == [(2, 2), (4, 2), (4, 2)]
    nameless = table(spark, ["a b c d", "A b c d", "q r s t", None], [None, 3, None, None])
    out = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.similarity_components(nameless).collect())
    assert out == Counter({(None, 3): 1, (3, 3): 1, (None, None): 2})
    assert jaccard_join.drop_near_copies(table(spark, ["a b c d e f", "a b c d e f", "z"], [1, 2, 2])).count() == 3
    kept = jaccard_join.drop_near_copies(table(spark, ["a b c d e f", "a b c d e f", "z"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == table(spark, []).columns


def test_sketches_never_rule_out_a_pair():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        assert jaccard_join.sketch_difference(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_frequent_tokens_come_last(spark):
    rng = random.Random(7)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [" ".join([common, *(f"u{rng.randrange(10**6)}" for _ in range(60))]) for _ in range(jaccard_join.FREQUENT + 1)] + [None, "c0 c1"]
    sets = [jaccard_join.shingles(t, 3) for t in texts]
    df = Counter(np.concatenate(sets).tolist())
    often = np.array([t for t, n in df.items() if n > jaccard_join.FREQUENT], np.uint64)
    found = jaccard_join.frequent_tokens(table(spark, texts), 3)
    assert len(often) == 28 and set(found[0].tolist()) == set(jaccard_join.token_codes(often, found[1]).tolist())
    for s in sets[: jaccard_join.FREQUENT + 1]:
        assert np.isin(jaccard_join.prefix(s, 80), often).any()  # in the order of the hash alone
        ordered = jaccard_join.rare_first(s, found)
        assert sorted(ordered.tolist()) == s.tolist() and not np.isin(jaccard_join.prefix(ordered, 80), often).any()
    assert len(jaccard_join.frequent_tokens(table(spark, []), 3)[0]) == 0


def test_combinations_of_unrelated_sets_differ():
    rng = np.random.default_rng(6)
    for n in (20, 60, 300):
        keys = Counter(np.concatenate([jaccard_join.combinations(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), 80) for _ in range(200)]).tolist())
        assert max(keys.values()) == 1


def test_combinations_of_similar_sets_meet():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        for n in [*range(1, 60), 200, 700]:
            for _ in range(20):
                both = int(rng.integers(-(-percent * n // 100), n + 1))  # of n tokens in the union
                every = rng.integers(0, 2**63, n, dtype=np.uint64)
                cut = int(rng.integers(both, n + 1))
                a, b = np.unique(every[:cut]), np.unique(np.concatenate([every[:both], every[cut:]]))
                assert np.isin(jaccard_join.combinations(a, percent), jaccard_join.combinations(b, percent)).any()


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 12), (7, 8), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (12, 40)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**dict.fromkeys((3, 5, 9, 12, 40), 3), 7: 7, 8: 7, **dict.fromkeys(range(20, 26), 20)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_merge_losslessly():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 2**64, 50, dtype=np.uint64) for _ in range(3)]
    parts.append(np.concatenate([parts[0][:20], parts[1][:5], parts[0][:3]]))
    want, blocks = Counter(np.concatenate(parts).tolist()), {}
    for p in parts:
        for block, *rest in exact_dedup.build_blocks(p, 6):
            blocks.setdefault(block, []).append(tuple(rest))
    have = Counter()
    for block, held in blocks.items():
        keys, counts = exact_dedup.merge_blocks(held, block, 6)
        have.update(dict(zip(keys.tolist(), counts.tolist())))
    assert have == want


def test_exact_dedup(spark, monkeypatch):
    texts = ["a  b", "a\tb", " a b", None, "", "A b", "x" * 90_000, "x" * 90_000, "a b"]
    ids = [9, 4, 1, 7, 3, 2, 11, 10, 4]
    df = table(spark, texts, ids)
    for limit in (2_000_000, -1):  # broadcast and shuffle
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
        rows = exact_dedup.exact_dedup(df).collect()
        out = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
        assert out == Counter({(9, 4, 3, False): 1, (4, 4, 3, True): 1, (4, 4, 3, False): 1, (1, 1, 1, True): 1, (7, 3, 2, False): 1, (3, 3, 2, True): 1, (2, 2, 1, True): 1, (11, 10, 2, False): 1, (10, 10, 2, True): 1})
    clash = df.selectExpr("doc_id", "text", "1 AS __sha", "2 AS __sha2", "3 AS row_number", "4 AS __keep_id", "5 AS gone", "6 AS doc_row")
    assert {tuple(r)[2:] for r in exact_dedup.drop_exact_copies(clash).collect()} == {(1, 2, 3, 4, 5, 6)}
    assert jaccard_join.drop_near_copies(clash).columns == clash.columns
    left = exact_dedup.drop_exact_copies(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 10] and left.columns == df.columns
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    lone = exact_dedup.exact_dedup(table(spark, ["q", "q", "r"], [None, None, None])).collect()
    assert sum(r["kept"] for r in lone) == 2
