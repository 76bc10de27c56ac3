"""Segmentation against ground truth, backend benchmarks, volumes and stacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.functions.columns import with_scalars
from lumenframe.operators.pixels import pixel_metrics
from lumenframe.operators.segmentation import Segmenter, label_pixels, segment_images
from lumenframe.operators.tracking import centroids, match_instances
from lumenframe.sources.images import STACK_AXES

METRICS = ("iou", "dice", "precision", "recall", "instance_precision", "instance_recall", "instance_f1", "absolute_count_error")


def paired_segmentation_metrics(pred: DataFrame, truth: DataFrame, key: str, *, max_distance: float = 20.0) -> DataFrame:
    """Pixel and instance metrics per key of two long label tables (key, y, x, label), under names of their own."""
    where = [c for c in ("z", "y", "x") if c in truth.columns]
    both = pred.select(key, *where, F.col("label").alias("p")).join(truth.select(key, *where, F.col("label").alias("t")), [key, *where], "full_outer")
    pixel = pixel_metrics(both, F.coalesce(F.col("p") > 0, F.lit(False)), F.coalesce(F.col("t") > 0, F.lit(False)), [key])
    a, b = (centroids(x.withColumn("frame", F.lit(0)), [key], axes=tuple(where)) for x in (pred, truth))
    return with_scalars(pixel, [key], match_instances(a, b, key, axes=tuple(where), max_distance=max_distance))


def benchmark_segmentation(paired: DataFrame) -> DataFrame:
    """Means of all metrics over the pairs; what is missing or NaN is skipped."""
    return paired.agg(F.count("*").alias("pairs"), *[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(f"{m}_mean") for m in METRICS if m in paired.columns])


def benchmark_backends(images: DataFrame, truth: DataFrame, key: str, backends: list[Segmenter], *, max_distance: float = 3.0) -> DataFrame:
    """One row per image and backend: seconds, error and the metrics against ``truth`` (key, y, x, label)."""
    runs = segment_images(images, key, backends).withColumn("run", F.concat_ws("|", F.col("member"), F.col(key).cast("string")))
    pred = label_pixels(runs, "run").select("run", "y", "x", "label")
    names = runs.select("run", key, F.col("member").alias("backend"), F.col("seconds").alias("elapsed_seconds"), "error")
    wanted = names.where("error IS NULL").select("run", key).join(truth, key).select("run", "y", "x", "label")
    return names.join(paired_segmentation_metrics(pred, wanted, "run", max_distance=max_distance), "run", "left").drop("run")


def threshold_runs(images: DataFrame, key: str, thresholds: list[float]) -> DataFrame:
    """Object count and foreground share of each image at each fixed threshold (key, threshold, object_count, foreground_fraction)."""
    kind = f"`{key}` {dict(images.dtypes)[key]}"
    distinct = sorted(set(map(float, thresholds)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                image = np.frombuffer(row.data, np.dtype(row.dtype)).reshape(tuple(row.shape))
                found = [(getattr(row, key), t, int(kernels.label_components(image >= t).max(initial=0)), float((image >= t).mean())) for t in distinct]
                yield pd.DataFrame(found, columns=[key, "threshold", "object_count", "foreground_fraction"])

    return images.select(key, "shape", "dtype", "data").mapInPandas(run, f"{kind}, threshold double, object_count long, foreground_fraction double")


def segment_volumes(volumes: DataFrame, key: str, *, min_voxels: int = 20, connectivity: int = 1) -> DataFrame:
    """Labels of packed volumes (key, shape, dtype, data) in long form: key, z, y, x, label > 0."""
    kind = f"`{key}` {dict(volumes.dtypes)[key]}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                labels = kernels.segment_volume(np.frombuffer(row.data, np.dtype(row.dtype)).reshape(tuple(row.shape)), min_voxels=min_voxels, connectivity=connectivity)
                z, y, x = np.nonzero(labels)
                yield pd.DataFrame({key: [getattr(row, key)] * len(z), "z": z, "y": y, "x": x, "label": labels[z, y, x]})

    return volumes.select(key, "shape", "dtype", "data").mapInPandas(run, f"{kind}, z int, y int, x int, label int")


def canonical_axes(df: DataFrame, key: str, axes: str) -> DataFrame:
    """Long form of packed stacks (key, shape, data as 64-bit floats) with one column per axis, in the order T, Z, C, Y, X."""
    if set(axes) - set(STACK_AXES) or len(set(axes)) != len(axes):
        raise ValueError(f"unknown or repeated axes: {axes}")
    flat = df.select(key, "shape", F.posexplode("values").alias("pos", "v"))
    columns, inner = {}, F.lit(1)
    for k in range(len(axes) - 1, -1, -1):
        size = F.element_at("shape", k + 1)
        columns[axes[k]] = F.floor(F.col("pos") / inner).cast("int") % size
        inner = inner * size
    return flat.select(key, *[columns[a].alias(a.lower()) for a in STACK_AXES if a in columns], "v")
