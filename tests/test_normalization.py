import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import normalization as n


def one(df):
    return df.first().asDict()


def test_constant_series_has_zero_robust_z(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert [r["x_robust_z"] for r in n.robust_zscore_column(df, "x").collect()] == [0, 0, 0]
    assert [r["x_robust_z"] for r in n.robust_zscore_self(spark.createDataFrame([(1.0,)] * 3, "x double"), "x").collect()] == [0, 0, 0]


def test_adaptive_qc_keeps_flags_and_adds_outliers(spark):
    rows = [("TOO_DARK", 100.0, 10.0), ("", 101.0, 60.0), ("", 99.0, 61.0), ("", 100.5, 59.0), ("", 900.0, 60.5)]
    out = n.adaptive_dataset_qc(spark.createDataFrame(rows, "flags string, focus_score double, brightness_mean double")).collect()
    flags = {r["focus_score"]: r["flags"] for r in out}
    assert flags[100.0] == "TOO_DARK; ADAPTIVE_OUTLIER" and flags[900.0] == "ADAPTIVE_OUTLIER" and flags[101.0] == ""


def test_adaptive_qc_without_metrics_or_with_nan(spark):
    out = n.adaptive_dataset_qc(spark.createDataFrame([("a",)], "flags string")).first()
    assert out["adaptive_score"] == 0 and out["flags"] == "a"
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (3.0,)], "focus_score double")
    assert all(r["adaptive_score"] < 3 for r in n.adaptive_dataset_qc(df).collect())


def test_controls(spark):
    df = spark.createDataFrame([("control", 10.0), ("control", 20.0), ("treated", 15.0)], "condition string, signal double")
    assert n.normalize_to_controls_ratio(df, "signal", "condition", "control").where("condition = 'treated'").first()["signal_normalized"] == 1
    assert n.percent_control(df, "signal", "condition", "control").where("condition = 'treated'").first()["signal_percent_control"] == 100
    with pytest.raises(Exception, match="baseline"):
        n.normalize_to_controls_ratio(df, "signal", "condition", "missing").collect()
    with pytest.raises(ValueError):
        n.normalize_to_controls_ratio(df, "nothing", "condition", "control")
    z = {r["signal"]: r["signal_robust_z"] for r in n.normalize_to_controls_robust(df, "signal", group_column="condition", control_value="control").collect()}
    assert z[15.0] == 0 and z[20.0] > 0


def test_constant_reference_uses_one(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (2.0, 1), (2.0, 1), (2.0, 1)], "x double, ref int")
    out = n.robust_zscore_reference(df, "x", F.col("ref") == 1, output="z").where("ref = 0").orderBy("x").collect()
    assert [r["z"] for r in out] == [-1, 0, 1]


def test_assay_quality(spark):
    rows = [("n", v) for v in (10.0, 11.0, 9.0)] + [("p", v) for v in (100.0, 101.0, 99.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    a, b = F.col("g") == "n", F.col("g") == "p"
    assert one(n.z_prime(df, "v", a, b))["z_prime"] == pytest.approx(14 / 15)
    rows = [("c", v) for v in (1.0, 2.0, 3.0)] + [("t", v) for v in (5.0, 6.0, 7.0)]
    assert one(n.ssmd(spark.createDataFrame(rows, "g string, v double"), "v", F.col("g") == "c", F.col("g") == "t"))["ssmd"] == pytest.approx(4)
    z = spark.createDataFrame([(0.7,), (0.2,), (-0.1,)], "z_prime double")
    assert [r["status"] for r in n.assay_qc_decision(z).orderBy(F.desc("z_prime")).collect()] == ["PASS", "MARGINAL", "FAIL"]
    with pytest.raises(Exception, match="finite"):
        n.assay_qc_decision(spark.createDataFrame([(float("nan"),)], "z_prime double")).collect()
    with pytest.raises(ValueError):
        n.classify_z_prime(F.lit(1.0), excellent=0.1, marginal=0.5)


def test_plate_effects(spark):
    df = spark.createDataFrame([("A01", 10.0), ("A02", 11.0), ("B02", 20.0), ("B03", 19.0), ("H12", 9.0)], "well string, signal double")
    out = one(n.plate_edge_effect_ratio(df, "signal"))
    assert (out["edge_median"], out["interior_median"]) == (10, 19.5) and out["edge_interior_ratio"] < 1
    grid = spark.createDataFrame([("A", 1, 20.0), ("B", 2, 10.0), ("C", 3, 10.0), ("D", 4, 10.0)], "well_row string, well_col int, signal double")
    out = one(n.plate_edge_effect_robust(grid, "signal"))
    assert out["edge_median"] > out["interior_median"] and out["edge_n"] == 1 and out["robust_effect"] == 10
    plate = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 11.0), ("B", 1, 20.0), ("B", 2, 21.0)], "row string, column int, value double")
    assert all(math.isfinite(r["value_b_score"]) for r in n.b_score(plate, "value").collect())
    assert one(n.plate_uniformity(plate, "value"))["n"] == 4


def test_plan_has_no_python(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("focus_score"))
    plan = n.adaptive_dataset_qc(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
