"""Track, event and lineage tables: windows and aggregates over them, and mask-overlap events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.columns import ratio, require

EVENT_COLUMNS = {"parent_label": "int", "child_labels": "array<int>", "parent_labels": "array<int>", "child_label": "int"}


def summarize_tracks(tracks: DataFrame, *, axes: tuple[str, ...] = ("x", "y"), pixel_size: float = 1.0, frame_interval: float = 1.0, keys: list[str] = []) -> DataFrame:
    """Per track: frames, start, end, path, net distance, speeds, straightness, mean confidence, largest gap and step.

    ``axes`` are positions; for volumes pass the three axes in physical units and ``pixel_size`` 1."""
    require(tracks, *keys, "track_id", "frame", *axes)
    track = Window.partitionBy(*keys, "track_id").orderBy("frame")
    step = F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(track), 2) for a in axes), F.lit(0.0))) * pixel_size
    gap = F.col("frame") - F.lag("frame").over(track)
    rows = tracks.where(F.col("track_id").isNotNull()).withColumn("__step", step).withColumn("__gap", gap)
    first, last = ([getattr(F, f)(F.col(a), F.col("frame")) for a in axes] for f in ("min_by", "max_by"))
    net = F.sqrt(sum((F.pow(z - a, 2) for a, z in zip(first, last)), F.lit(0.0))) * pixel_size
    confidence = F.avg("confidence") if "confidence" in tracks.columns else F.lit(None).cast("double")
    out = rows.groupBy(*keys, "track_id").agg(
        F.count("*").alias("n_frames"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_length"),
        net.alias("net_displacement"), F.coalesce(F.avg("__step"), F.lit(0.0)).alias("mean_step"), F.coalesce(F.max("__step"), F.lit(0.0)).alias("max_step"),
        confidence.alias("mean_confidence"), F.coalesce(F.max("__gap") - 1, F.lit(0)).alias("max_gap"),
    )
    out = out.withColumn("duration", (F.col("end_frame") - F.col("start_frame")) * frame_interval).withColumn("mean_speed", F.col("mean_step") / frame_interval)
    return out.withColumn("max_speed", F.col("max_step") / frame_interval).withColumn("straightness", ratio(F.col("net_displacement"), F.col("path_length"), 0.0))


def overlap_map(labels: DataFrame, *, min_overlap: float = 0.2, keys: list[str] = []) -> DataFrame:
    """(frame, previous, current, forward, backward) of labels of consecutive frames, at least ``min_overlap`` of either.

    ``labels`` is long: keys, frame, y, x (and z), label > 0.  Overlap is a pixel equi-join of frame - 1 with frame."""
    where = [c for c in ("z", "y", "x") if c in labels.columns]
    live = labels.where("label > 0").select(*keys, "frame", *where, F.col("label").cast("int").alias("label"))
    before = live.withColumn("frame", F.col("frame") + 1).withColumnRenamed("label", "previous")
    both = before.join(live.withColumnRenamed("label", "current"), [*keys, "frame", *where])
    pairs = both.groupBy(*keys, "frame", "previous", "current").agg(F.count("*").alias("shared"))
    size = live.groupBy(*keys, "frame", "label").agg(F.count("*").alias("size"))
    old = size.select(*keys, (F.col("frame") + 1).alias("frame"), F.col("label").alias("previous"), F.col("size").alias("old_size"))
    new = size.select(*keys, "frame", F.col("label").alias("current"), F.col("size").alias("new_size"))
    out = pairs.join(old, [*keys, "frame", "previous"]).join(new, [*keys, "frame", "current"])
    out = out.select(*keys, "frame", "previous", "current", (F.col("shared") / F.col("old_size")).alias("forward"), (F.col("shared") / F.col("new_size")).alias("backward"))
    return out.where(F.greatest("forward", "backward") >= min_overlap)


def detect_events(labels: DataFrame, *, min_overlap: float = 0.2, keys: list[str] = []) -> DataFrame:
    """Splits, merges, appearances and disappearances of all consecutive frames.

    A label without an overlapping partner appears or disappears (the intent of the events' names)."""
    pairs = overlap_map(labels, min_overlap=min_overlap, keys=keys)
    forward, backward = pairs.where(F.col("forward") >= min_overlap), pairs.where(F.col("backward") >= min_overlap)
    children = forward.groupBy(*keys, "frame", F.col("previous").alias("parent_label")).agg(F.array_sort(F.collect_set("current")).alias("child_labels"))
    parents = backward.groupBy(*keys, "frame", F.col("current").alias("child_label")).agg(F.array_sort(F.collect_set("previous")).alias("parent_labels"))
    splits = children.where(F.size("child_labels") >= 2).select(*keys, "frame", F.lit("split").alias("event"), F.size("child_labels").alias("degree"), "parent_label", "child_labels")
    merges = parents.where(F.size("parent_labels") >= 2).select(*keys, "frame", F.lit("merge").alias("event"), F.size("parent_labels").alias("degree"), "parent_labels", "child_label")
    seen = labels.where("label > 0").select(*keys, "frame", F.col("label").cast("int").alias("label")).distinct()
    # Only transitions: both frames of a pair are within the series.
    bounds = labels.groupBy(*keys).agg(F.min("frame").alias("__lo"), F.max("frame").alias("__hi"))
    ranged = seen.join(bounds, keys) if keys else seen.crossJoin(F.broadcast(bounds))  # without keys, one row
    fresh = ranged.where("frame > __lo").select(*keys, "frame", F.col("label").alias("child_label"))
    gone = ranged.where("frame < __hi").select(*keys, (F.col("frame") + 1).alias("frame"), F.col("label").alias("parent_label"))
    born = fresh.join(parents, [*keys, "frame", "child_label"], "left_anti").select("*", F.lit("appearance").alias("event"), F.lit(0).alias("degree"))
    died = gone.join(children, [*keys, "frame", "parent_label"], "left_anti").select("*", F.lit("disappearance").alias("event"), F.lit(0).alias("degree"))
    out = splits
    for more in (merges, born, died):
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*keys, "frame", "event", "degree", *[F.col(c).cast(t) for c, t in EVENT_COLUMNS.items()])


def classify_divisions(events: DataFrame, *, min_children: int = 2) -> DataFrame:
    return events.where("event = 'split'").withColumn("is_division", F.col("degree") >= min_children)


def lineage_table(tracks: DataFrame, events: DataFrame | None = None, *, keys: list[str] = []) -> DataFrame:
    """Observation nodes; children of a split get the parent's track (of several, that of the largest parent label)."""
    require(tracks, *keys, "track_id", "frame", "label")
    nodes = tracks.select(*keys, "track_id", "frame", "label")
    if events is None:
        return nodes.select("*", F.lit(None).cast("long").alias("parent_track_id"), F.lit("observation").alias("relationship"))
    kids = events.where("event = 'split'").select(*keys, "frame", "parent_label", F.explode("child_labels").alias("label"))
    parent = nodes.groupBy(*keys, (F.col("frame") + 1).alias("frame"), F.col("label").alias("parent_label")).agg(F.min("track_id").cast("long").alias("parent_track_id"))
    named = kids.join(parent, [*keys, "frame", "parent_label"])
    last = named.groupBy(*keys, "frame", "label").agg(F.max_by("parent_track_id", F.struct("parent_label", "parent_track_id")).alias("parent_track_id"))
    out = nodes.join(last, [*keys, "frame", "label"], "left")
    return out.select(*keys, "track_id", "frame", "label", "parent_track_id", F.when(F.col("parent_track_id").isNotNull(), "division_child").otherwise("observation").alias("relationship"))


def summarize_lineages(lineage: DataFrame, *, keys: list[str] = []) -> DataFrame:
    return lineage.groupBy(*keys, "track_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_frames"), (F.max("frame") - F.min("frame") + 1).alias("duration"),
        F.bool_or(F.col("relationship") == "division_child").alias("is_child"), F.array_sort(F.collect_set("parent_track_id")).alias("parents"),
    )


def lineage_event_summary(events: DataFrame, *, n_frames: int | None = None) -> DataFrame:
    """Events in all and by kind, and events per transition; zeros if there are none."""
    kinds = ("split", "merge", "appearance", "disappearance")
    counts = [F.count_if(F.col("event") == k).alias(f"{k}_count") for k in kinds]
    transitions = 1 if n_frames is None else max(n_frames - 1, 1)
    return events.agg(F.count("*").alias("event_count"), *counts).withColumn("events_per_transition", F.col("event_count") / transitions)


def division_consistency(events: DataFrame, *, min_children: int = 2) -> DataFrame:
    degree = F.coalesce("degree", F.size("child_labels")) if "child_labels" in events.columns else F.col("degree")
    splits = F.count_if(F.col("event") == "split")
    good = F.count_if((F.col("event") == "split") & (degree >= min_children))
    return events.agg(splits.alias("split_count"), good.alias("consistent_count")).withColumn("consistency_rate", ratio(F.col("consistent_count"), F.col("split_count"), 1.0))


def lineage_quality_summary(tracks: DataFrame, *, keys: list[str] = []) -> DataFrame:
    """Tracks, observations, fragmented tracks, mean length and completeness (observed over spanned frames)."""
    require(tracks, *keys, "track_id", "frame")
    one = tracks.groupBy(*keys, "track_id").agg(F.countDistinct("frame").alias("n"), (F.max(F.col("frame").cast("long")) - F.min(F.col("frame").cast("long")) + 1).alias("span"))
    return one.groupBy(*keys).agg(
        F.count("*").alias("track_count"), F.sum("n").alias("observation_count"), F.count_if(F.col("n") < F.col("span")).alias("fragmented_tracks"),
        F.avg("n").alias("mean_track_length"), ratio(F.sum("n"), F.sum("span")).alias("completeness"),
    )


def track_fragmentation(tracks: DataFrame, *, track: str = "track_id", object_column: str = "object_id") -> DataFrame:
    per = tracks.where(F.col(track).isNotNull() & F.col(object_column).isNotNull()).groupBy(object_column).agg(F.countDistinct(track).alias("n"))
    return per.agg(F.count("*").alias("object_count"), F.count_if(F.col("n") > 1).alias("fragmented_objects"), ratio(F.count_if(F.col("n") > 1), F.count("*"), 0.0).alias("fragmentation_rate"))


def track_gap_rate(tracks: DataFrame, *, track: str = "track_id", frame: str = "frame") -> DataFrame:
    """Gaps between the distinct sorted frames of tracks, in all and by transition."""
    rows = tracks.select(track, frame).dropna().dropDuplicates()
    jump = F.col(frame) - F.lag(frame).over(Window.partitionBy(track).orderBy(frame))
    out = rows.withColumn("__jump", jump).agg(
        F.countDistinct(track).alias("track_count"), F.count("__jump").alias("transition_count"), F.count_if(F.col("__jump") > 1).alias("gap_count"), F.coalesce(F.sum(F.col("__jump") - 1), F.lit(0)).alias("missing_frames")
    )
    return out.withColumn("gap_rate", ratio(F.col("gap_count"), F.col("transition_count"), 0.0))


def track_purity(pairs: DataFrame, reference: str | Column = "reference", predicted: str | Column = "predicted") -> DataFrame:
    """Sum over predicted tracks of their largest overlap with one reference, over all rows."""
    rows = pairs.select(F.col(reference).alias("r") if isinstance(reference, str) else reference.alias("r"), F.col(predicted).alias("p") if isinstance(predicted, str) else predicted.alias("p")).dropna()
    best = rows.groupBy("p", "r").count().groupBy("p").agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.agg(F.sum("n").alias("n"), ratio(F.sum("best"), F.sum("n"), 0.0).alias("purity"))
