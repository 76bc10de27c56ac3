"""Connected components of undirected links by alternating large and small stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._common import materialize, scratch_scope


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): least v of each u; a table of its own, so that a join with it can split a u of many pairs."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked id and the smallest id that it reaches."""
    with scratch_scope(links.sparkSession, "components"):
        edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
        edges = materialize(edges, "links")
        signature = None
        while True:
            # Large star: each greater neighbour is linked to the smallest id of the neighbourhood.
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = _minima(both).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = materialize(large, "large-star")
            # Small star: each id and its lesser neighbours are linked to the smallest of them.
            least = _minima(large)
            small = large.join(least, "u")
            small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
            edges = materialize(small, "small-star")
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if signature == (now["n"], now["h"]):
                found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
                return materialize(found.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
            signature = (now["n"], now["h"])
