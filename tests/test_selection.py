import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import normalization
from lumenframe.operators.selection import select_medians


@pytest.mark.parametrize("n", [1, 2, 7, 400, 2001])
@pytest.mark.parametrize("kind", ["even", "ties", "wide"])
def test_equals_the_median_of_all_values(spark, n, kind):
    draw = random.Random(n)
    value = {"even": draw.random, "ties": lambda: float(draw.choice([1, 1, 1, 2, 5])), "wide": lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300)}[kind]
    rows = [(value(), value() if i % 3 else None) for i in range(n)]
    out = select_medians(spark.createDataFrame(rows, "a double, b double").repartition(5), {"a": F.col("a"), "b": F.col("b")}, accuracy=50).first()
    b = [x for _, x in rows if x is not None]
    assert out["a"] == pytest.approx(statistics.median([x for x, _ in rows]), rel=1e-14)
    assert out["b"] is None if not b else out["b"] == pytest.approx(statistics.median(b), rel=1e-14)


def test_keys_nulls_and_empty_tables(spark):
    draw = random.Random(5)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "cold", draw.gauss(0, 9)) for i in range(3000)] + [("none", None)]
    out = {r["k"]: r["m"] for r in select_medians(spark.createDataFrame(rows, "k string, v double"), {"m": F.col("v")}, ["k"], accuracy=100).collect()}
    for key in (None, "hot", "cold"):
        assert out[key] == pytest.approx(statistics.median(v for k, v in rows if k == key), rel=1e-14)
    assert select_medians(spark.createDataFrame([], "v double"), {"m": F.col("v")}).collect()[0]["m"] is None
    with pytest.raises(ValueError):
        select_medians(spark.range(1), {"id": F.col("id")}, ["id"])


def test_no_task_holds_the_distinct_values(spark):
    """The value counts are partial sums between the bounds; no exact percentile is in the plan."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("focus_score"))
    out = select_medians(df, {"m": F.col("focus_score")}, accuracy=1000)
    assert out.first()["m"] == statistics.median(i * 7919 % 100_003 for i in range(100_000))
    for plan in (normalization.adaptive_dataset_qc(df), normalization.plate_qc_summary(df, ["focus_score"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median(" not in text and "percentile(" not in text and "percentile_approx" in text
