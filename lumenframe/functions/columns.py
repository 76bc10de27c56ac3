"""Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consistency factors of the median absolute deviation, in the two forms in use.
MAD_FACTOR, MAD_SCALE = 0.6745, 1.4826


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def number(column: str | Column) -> Column:
    """A value as double; text that is no number, NaN and infinities become null."""
    c = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """``a / b``; null (or ``default``) where ``b`` is 0 or null."""
    q = F.when(b != 0, a / b)
    return q if default is None else F.coalesce(q, F.lit(default))


def over(keys: Iterable[str]) -> object:
    return Window.partitionBy(*keys)


def with_scalars(df: DataFrame, keys: list[str], stats: DataFrame) -> DataFrame:
    """Attach one row of aggregates per key, or the single row if there are no keys."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # one row
    renamed = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly (by keys, if given) over the cluster, whatever their bytes: what follows takes long for each."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
