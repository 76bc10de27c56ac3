"""Helpers shared by the training-data operators: scratch tables and partition bookkeeping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Where it is unset, a session that runs in one process gets a folder of its own; on a cluster that is an error,
    as a folder of one machine would be missed on the others.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-lumen-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written within the open scopes, (name, path), innermost last.
_SCOPES: list[list[tuple[str, str]]] = []


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _SCOPES:
        _SCOPES[-1].append((name, path))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete the tables materialised within at the end, but those of the names given; these fall to the scope around."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name, path in _SCOPES.pop():
            if name not in keep:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _SCOPES:
                _SCOPES[-1].append((name, path))


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table with a number for each row, and that column's name; the numbers hold however often it is read."""
    (row,) = unused(df, "row_number")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row


def only_rows(df: DataFrame, row: str, chosen: DataFrame) -> DataFrame:
    """The rows of a table of :func:`numbered` whose number is in the one column of ``chosen``, without that number."""
    return df.join(chosen.toDF(row), row, "left_semi").drop(row)


def running_offsets(totals: DataFrame, key: str, total: str, out: str) -> DataFrame:
    """Exclusive running sum of ``total`` in the order of ``key``: one row per partition, never per document."""
    return totals.select(
        key,
        (F.expr(f"sum({total}) OVER (ORDER BY {key} ROWS UNBOUNDED PRECEDING)") - F.col(total)).alias(out),
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that no column of ``df`` carries (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
