"""Permutation tests and bootstrap intervals against plain Python with the same digests."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import groups, resampling
from lumenframe.plans import queries


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, name string, a boolean, v double")


def shuffled_rows(spark, run):
    """Rows that all stages of ``run`` write to shuffles."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_permutations_by_smallest_digests(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, f"r{i}", bool(i % 3), float(x)) for k, n in (("one", 40), (None, 9), ("all a", 3)) for i, x in enumerate(rng.normal(size=n).round(2) + (k == "one") * np.arange(n) % 3)]
    rows += [("one", "nan", True, float("nan")), ("one", "null", False, None)]
    rows = [(k, n, True if k == "all a" else a, v) for k, n, a, v in rows]
    for slack in (32, 0, -1):  # borders found among all rows, within some rounds, and never
        monkeypatch.setattr(resampling, "SLACK", slack)
        monkeypatch.setattr(resampling, "DEVIATIONS", 6 if slack > 0 else 1 + slack)
        out = {r["k"]: r for r in resampling.permutation_pvalues(table(spark, rows).repartition(5), "v", F.col("a"), "name", n_permutations=150, seed=4, keys=["k"]).collect()}
        for key in ("one", None):
            own = [(n, a, v) for k, n, a, v in rows if k == key and v is not None and v == v]
            n_a = sum(a for _, a, _ in own)
            gap = lambda side: abs(np.mean(side[:n_a]) - np.mean(side[n_a:]))
            seen = gap([v for _, _, v in sorted(own, key=lambda x: not x[1])])
            draws = [gap([v for n, _, v in sorted(own, key=lambda x: (digest(4, k, x[0]), x[0]))]) for k in range(150)]
            assert out[key]["p_value"] == pytest.approx((sum(d >= seen - 1e-9 for d in draws) + 1) / 151), key
            assert out[key]["n_a"] == n_a and out[key]["n_a"] + out[key]["n_b"] == len(own)
        assert np.isnan(out["all a"]["p_value"])
    with pytest.raises(ValueError):
        resampling.permutation_pvalues(table(spark, rows), "v", F.col("a"), "name", n_permutations=99)


def test_draws_of_permutations_stay_where_they_are_made(spark):
    """only rows near a round's border are shuffled; ranges of all draws took an executor's memory."""
    rows = spark.range(20_000).select((F.col("id") % 2 == 0).alias("a"), F.col("id").cast("string").alias("name"), (F.col("id") % 7).cast("double").alias("v"))
    out = []
    assert shuffled_rows(spark, lambda: out.append(resampling.permutation_pvalues(rows, "v", F.col("a"), "name", n_permutations=100).first())) < 20_000 * 100 / 8
    assert out[0]["n_a"] == out[0]["n_b"] == 10_000 and 0 < out[0]["p_value"] <= 1


@pytest.mark.parametrize("draws", [7, 200])
def test_digests_of_odd_names(spark, monkeypatch, draws):
    """Names of several blocks, empty, null and beyond ASCII, of keys that share a batch, by the digests of any engine."""
    monkeypatch.setattr(resampling, "HANDED_ON", 50)
    monkeypatch.setattr(resampling, "DRAWS", draws)
    seed = 12345678901
    names = [None, "", "\u00e4\u00f6", *("x" * n + str(n) for n in (30, 36, 37, 38, 44, 99, 100, 101, 102, 163, 300))]
    rows = [(k, n, bool((i + len(k)) % 2), float(i * i % 11 + i)) for k in ("a", "bb") for i, n in enumerate(names * (1 if k == "a" else 2))]
    monkeypatch.setattr(resampling, "SLACK", 1.0)
    monkeypatch.setattr(resampling, "DEVIATIONS", 2.0)
    out = {r["k"]: r for r in resampling.permutation_pvalues(table(spark, rows).repartition(2), "v", F.col("a"), "name", n_permutations=130, seed=seed, keys=["k"]).collect()}
    for key in ("a", "bb"):
        own = [(n, a, v) for k, n, a, v in rows if k == key]
        n_a = sum(a for _, a, _ in own)
        gap = lambda side: abs(np.mean(side[:n_a]) - np.mean(side[n_a:]))
        seen = gap([v for _, _, v in sorted(own, key=lambda x: not x[1])])
        draws_of = [gap([v for _, v in sorted((digest(seed, k, *([n] if n is not None else [])), v) for n, _, v in own)]) for k in range(130)]
        assert out[key]["p_value"] == pytest.approx((sum(d >= seen - 1e-9 for d in draws_of) + 1) / 131), key


def test_rows_alike_in_name_and_value_are_counted(spark):
    rows = table(spark, [("k", f"r{i % 5}", i < 9, float(i % 5)) for i in range(20)])
    got = {resampling.permutation_pvalues(rows.repartition(n), "v", F.col("a"), "name", n_permutations=120).first()["p_value"] for n in (1, 6)}
    rounds = [sorted((digest(0, k, f"r{i % 5}"), i % 5) for i in range(20)) for k in range(120)]
    gap = lambda side: abs(np.mean(side[:9]) - np.mean(side[9:]))
    seen = gap([i % 5 for i in range(20)])
    assert got == {(sum(gap([v for _, v in r]) >= seen - 1e-9 for r in rounds) + 1) / 121}


def test_draws_of_bootstraps_stay_where_they_are_made(spark):
    """values are looked up in blocks where the draws are made, and keys share the draws' digests."""
    rows = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("string").alias("name"), F.sqrt("id").alias("v"))
    out = []
    assert shuffled_rows(spark, lambda: out.extend(resampling.bootstrap_intervals(rows, "v", "name", n_bootstrap=100, keys=["k"]).collect())) < 30_000 * 100 / 8
    assert len(out) == 3 and all(r["n"] == 10_000 and r["ci_low"] < r["mean"] < r["ci_high"] for r in out)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_bootstrap_by_digests_of_places(spark, monkeypatch, broadcast):
    monkeypatch.setattr(resampling, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(resampling, "RANGE_DIGITS", 1)
    monkeypatch.setattr(resampling, "BLOCK_VALUES", 8)  # blocks hold values of several keys
    monkeypatch.setattr(resampling, "KEYS_TOGETHER", 2)
    rng = np.random.default_rng(2)
    rows = [(k, f"r{i}", True, float(x)) for k, n in (("one", 33), (None, 1), ("two", 7)) for i, x in enumerate(rng.normal(size=n))]
    rows.append(("two", "inf", True, float("inf")))
    out = {r["k"]: r for r in resampling.bootstrap_intervals(table(spark, rows).repartition(4), "v", "name", n_bootstrap=120, confidence=0.9, seed=5, keys=["k"]).collect()}
    for key in ("one", None, "two"):
        x = [v for _, _, v in sorted((digest(n), n, v) for k, n, _, v in rows if k == key and np.isfinite(v))]
        means = [np.mean([x[int(digest(5, b, j)[:15], 16) % len(x)] for j in range(len(x))]) for b in range(120)]
        assert out[key]["ci_low"] == pytest.approx(np.quantile(means, 0.05)) and out[key]["ci_high"] == pytest.approx(np.quantile(means, 0.95))
        assert out[key]["n"] == len(x) and out[key]["mean"] == pytest.approx(np.mean(x))


def test_whole_effects(spark):
    rows = [(f"r{i}", "AB"[i % 2], float(i % 2 * 10 + i % 5)) for i in range(24)]
    df = spark.createDataFrame(rows, "replicate string, condition string, v double")
    far = groups.replicate_effect_summary(df, "v", "condition", "A", "B", n_bootstrap=200, n_permutations=400).first()
    assert far["p_value"] == pytest.approx(1 / 401) and far["ci_a_low"] < far["mean_a"] < far["ci_a_high"] < far["ci_b_low"]
    near = groups.compare_two_groups(df.withColumn("v", df["v"] % 10), "v", "condition", "A", "B", n_permutations=200).first()
    assert near["p_value"] > 0.2 and near["n_a"] == near["n_b"] == 12


def test_query_of_two_groups_draws_all_rounds(spark, tmp_path, monkeypatch):
    """200 rounds of 10,000 left a fiftieth of the work."""
    lines = [(s, s, flag, 1.0, float(100 * s + 7 * i + (40 * s * s % 300 if flag == "A" else 0)), 0.0) for s in range(9) for flag in "ANR" for i in (-1, 1)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, compare = [], groups.compare_two_groups
    monkeypatch.setattr(groups, "compare_two_groups", lambda *args, **named: made.append(compare(*args, **named)) or made[-1])
    assert queries.queries()["compare_two_groups"](spark, str(tmp_path)).first()["p_in_range"]
    own = [("A", 100.0 * s + 40 * s * s % 300) for s in range(9)] + [("R", 100.0 * s) for s in range(9)]
    named = [(f"{g}/{x}/{1 + own[:i].count((g, x))}", x) for i, (g, x) in enumerate(own)]
    gap = lambda side: abs(np.mean(side[:9]) - np.mean(side[9:]))
    draws = [gap([x for _, x in sorted(named, key=lambda r: digest(0, k, r[0]))]) for k in range(10_000)]
    assert made[0].first()["p_value"] == pytest.approx((sum(d >= gap([x for _, x in named]) - 1e-9 for d in draws) + 1) / 10_001)
