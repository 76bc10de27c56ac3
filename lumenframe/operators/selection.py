"""Exact medians by selection: no task holds the distinct values of a group.

A quantile sketch, whose size doesn't grow with the rows, gives bounds around the middle rank of each group.  A second
pass counts what lies below them and keeps the distinct values between them, about ``8 / ACCURACY`` of all, whose sort
spills.  The rank is then looked up among those, so the result is exact whatever the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.columns import with_scalars

#: Entries of a sketch; its ranks are off by at most rows / ACCURACY, and the bounds are four times that apart from the middle.
ACCURACY = 10_000


def select_medians(df: DataFrame, values: dict[str, Column], keys: list[str] = [], *, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, names): the exact median of each named column of doubles over a key's rows.

    Nulls don't count; a column without values has a null.  Without keys there is one row, also of an empty table.
    Null is a key of its own.  Ties are kept as counts.  A sketch that breaks its bound raises instead of giving another value.
    """
    names = list(values)
    if not names or set(names) & set(keys):
        raise ValueError("medians need names of their own")
    each = F.array(*[F.struct(F.lit(k).alias("__i"), values[n].cast("double").alias("__v")) for k, n in enumerate(names)])
    rows = df.select(*keys, F.explode(each).alias("__e")).select(*keys, "__e.__i", "__e.__v").where("__v IS NOT NULL")
    group = [*keys, "__i"]
    margin = min(0.5, 4 / accuracy)
    sketch = F.percentile_approx("__v", [0.5 - margin, 0.5 + margin], F.lit(accuracy))
    bounds = rows.groupBy(*group).agg(F.count("*").alias("__n"), sketch.alias("__q"))
    few = F.col("__n") <= accuracy
    bounds = bounds.select(*group, "__n", F.when(~few, F.col("__q")[0]).alias("__lo"), F.when(~few, F.col("__q")[1]).alias("__hi"))
    known = with_scalars(rows, group, bounds if keys else F.broadcast(bounds))  # without keys as many rows as names
    inside = known.where("__hi IS NULL OR __v <= __hi").withColumn("__v", F.when(F.coalesce(F.col("__v") >= F.col("__lo"), F.lit(True)), F.col("__v")))
    counts = inside.groupBy(*group, "__n", "__v").agg(F.count("*").alias("__c"))  # null: all rows below the bounds
    upto = F.sum("__c").over(Window.partitionBy(*group).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("__upto", upto)
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    pick = lambda rank: F.min_by("__v", F.when(F.col("__upto") > rank, F.col("__upto")))
    found = ranked.groupBy(*group).agg(pick(low).alias("__a"), pick(high).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    broken = F.raise_error(F.lit("a quantile sketch broke its bound")).cast("double")
    middle = F.when(a.isNull() | b.isNull(), broken).when(a == b, a).otherwise(a * 0.5 + b * 0.5)
    found = found.select(*group, middle.alias("__m"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == k, F.col("__m"))).alias(n) for k, n in enumerate(names)])


def medians(df: DataFrame, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """Exact medians: of keys in one aggregation, of a whole table by selection."""
    if not keys:
        return select_medians(df, values)
    return df.groupBy(*keys).agg(*[F.median(v).alias(n) for n, v in values.items()])


def median_mad(df: DataFrame, value: Column, keys: list[str], where: Column | None = None) -> DataFrame:
    """Per key: __median, __mad, __std_samp, __std_pop, __n of ``value`` over the rows where ``where`` holds."""
    base = (df if where is None else df.where(where)).select(*keys, value.alias("__v"))
    moments = [F.stddev_samp("__v").alias("__std_samp"), F.stddev_pop("__v").alias("__std_pop"), F.count("__v").alias("__n")]
    off = {"__mad": F.abs(F.col("__v") - F.col("__median"))}
    if not keys:
        first = medians(base, {"__median": F.col("__v")}, keys)
        return base.agg(*moments).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(medians(with_scalars(base, keys, first), off, keys)))
    first = base.groupBy(*keys).agg(F.median("__v").alias("__median"), *moments)
    return with_scalars(first, keys, medians(with_scalars(base, keys, first.select(*keys, "__median")), off, keys))
