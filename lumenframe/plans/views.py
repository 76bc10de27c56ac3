"""Domain views over the star-schema tables: what plays the part of images, plates, tracks and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate wells: lineitem by supplier (row) and part (column)."""
    row = F.expr("chr(65 + CAST(l_suppkey % 8 AS INT))")
    col = (1 + F.col("l_partkey") % 12).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        row.alias("well_row"), col.alias("well_col"), F.concat(row, F.lpad(col.cast("string"), 2, "0")).alias("well"), F.col("l_returnflag").alias("condition"), F.col("l_suppkey").alias("replicate"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("signal"), F.col("l_discount").alias("discount"),
    )


WELLS_SQL = """wells AS (SELECT chr(65 + CAST(l_suppkey % 8 AS INT)) AS well_row, CAST(1 + l_partkey % 12 AS INT) AS well_col,
  chr(65 + CAST(l_suppkey % 8 AS INT)) || lpad(CAST(1 + l_partkey % 12 AS VARCHAR), 2, '0') AS well, l_returnflag AS condition, l_suppkey AS replicate,
  l_quantity AS quantity, l_extendedprice AS signal, l_discount AS discount FROM lineitem)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image results: events with their value and the number in their properties."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks: users over days; of a day's events the first stands for it."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min(F.to_date("ts")).alias("day0"))
    rows = e.crossJoin(F.broadcast(start)).select(
        F.col("user_id").alias("track_id"), F.datediff(F.to_date("ts"), F.col("day0")).alias("frame"), "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type"
    )
    one = rows.groupBy("track_id", "frame").agg(F.min_by(F.struct("x", "y", "event_id", "event_type"), F.col("event_id")).alias("s"))
    return one.select("track_id", "frame", "s.*", (F.col("track_id") % 40 + 1).cast("int").alias("label"))


TRACKS_SQL = """tr AS (SELECT track_id, frame, x, y, event_id, event_type, CAST(track_id % 40 + 1 AS INT) AS label FROM (
  SELECT user_id AS track_id, CAST(date_diff('day', min(CAST(ts AS DATE)) OVER (), CAST(ts AS DATE)) AS INT) AS frame, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_id, event_type FROM events)
  QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY event_id) = 1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: embeddings as grey values, long form."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    return e.select("image_id", F.floor(F.col("pos") / WIDTH).cast("int").alias("y"), (F.col("pos") % WIDTH).alias("x"), F.round(F.col("e").cast("double") * 100 + 100, 3).alias("v"))


PIXELS_SQL = """px AS (SELECT image_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, round(CAST(e AS DOUBLE) * 100 + 100, 3) AS v FROM (
  SELECT vec_id AS image_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""
