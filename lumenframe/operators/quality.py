"""Folder quality control: decode, measure, segment, flag, and dataset-level adaptive flags."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.operators.normalization import adaptive_dataset_qc
from lumenframe.operators.segmentation import Segmenter, ThresholdSegmenter, available_backends, get_backend
from lumenframe.sources.images import decode, find_images


@dataclass(frozen=True)
class QCThresholds:
    """Absolute limits of the image flags."""

    focus_min: float = 100.0
    brightness_min: float = 25.0
    brightness_max: float = 230.0
    saturation_max_fraction: float = 0.02
    min_cell_area: int = 15
    max_cell_area_frac: float = 0.25
    cell_count_low: int = 1
    cell_count_high: int | None = None

    def validate(self) -> None:
        checks = {
            "focus_min must not be negative": self.focus_min >= 0,
            "brightness limits must satisfy 0 <= min <= max <= 255": 0 <= self.brightness_min <= self.brightness_max <= 255,
            "saturation_max_fraction must be in [0, 1]": 0 <= self.saturation_max_fraction <= 1,
            "min_cell_area must be positive": self.min_cell_area >= 1,
            "max_cell_area_frac must be in (0, 1]": 0 < self.max_cell_area_frac <= 1,
            "cell counts must satisfy 0 <= low <= high": self.cell_count_low >= 0 and (self.cell_count_high is None or self.cell_count_high >= self.cell_count_low),
        }
        for message, holds in checks.items():
            if not holds:
                raise ValueError(message)


IMAGE_RESULT = (
    "path string, filename string, file_size_kb double, sha256 string, width int, height int, channels int, dtype string, ndim int, focus_score double, brightness_mean double, brightness_std double, "
    "saturation_fraction double, contrast_std double, estimated_cells int, cell_method string, segmentation_quality double, median_cell_area double, cell_area_cv double, "
    "border_object_fraction double, foreground_fraction double, error string, loaded boolean"
)


def diagnostics(labels: np.ndarray, min_area: int, max_area_frac: float) -> dict[str, float]:
    """Object count, areas, shares of border, tiny and merged objects, and the quality score."""
    area = np.bincount(labels.ravel())[1:]
    ids, area = np.flatnonzero(area) + 1, area[area > 0]
    if not len(area):
        return {"count": 0, "foreground": 0.0, "median": 0.0, "cv": 0.0, "border": 0.0, "tiny": 1.0, "merged": 0.0, "quality": 0.0}
    edge = np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]])
    border = np.isin(ids, edge).mean()
    tiny, merged = (area < 2 * min_area).mean(), (area > 0.5 * max_area_frac * labels.size).mean()
    cv = area.std(ddof=1) / area.mean() if len(area) > 1 else 0.0
    quality = max(0.0, 100 - min(45, 30 * border) - min(30, 30 * tiny) - min(25, 25 * merged))
    return {"count": len(area), "foreground": area.sum() / labels.size, "median": float(np.median(area)), "cv": float(cv), "border": float(border), "tiny": float(tiny), "merged": float(merged), "quality": float(quality)}


def analyze_files(files: DataFrame, thresholds: QCThresholds = QCThresholds(), *, segmenter: Segmenter | None = None, adaptive_threshold: bool = False, adaptive_qc: bool = True, exclude_failed: bool = False) -> DataFrame:
    """One row per file of (path, content, length): metrics and flags, ordered by path; a file that fails is a row with its error.

    Files are read and decoded once.  With ``adaptive_qc`` the measured rows, one an image, are kept on the executors
    while the dataset's medians are taken from them.
    """
    thresholds.validate()
    plain = ThresholdSegmenter(thresholds.min_cell_area, thresholds.max_cell_area_frac, adaptive_threshold)
    first = segmenter or plain
    names = [c.split()[0] for c in IMAGE_RESULT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw, size, digest in zip(frame["path"], frame["content"], frame["file_size_kb"], frame["sha256"]):
                row: dict[str, object] = dict.fromkeys(names, 0) | {"path": path, "filename": path.rsplit("/", 1)[-1], "file_size_kb": size, "sha256": digest}
                row |= {"dtype": None, "cell_method": first.name, "error": None, "loaded": False}
                try:
                    image = decode(path, bytes(raw))
                    gray = kernels.to_gray(image)
                    error, method = None, first.name
                    try:
                        labels = first.segment(gray)
                    except Exception as e:
                        labels, error, method = plain.segment(gray), f"fallback to threshold: {e}", plain.name
                    d = diagnostics(labels, thresholds.min_cell_area, thresholds.max_cell_area_frac)
                    std = round(float(gray.std()), 4)
                    row |= {
                        "width": image.shape[1], "height": image.shape[0], "channels": 1 if image.ndim == 2 else image.shape[2], "dtype": str(image.dtype), "ndim": image.ndim,
                        "focus_score": round(kernels.focus(gray), 4), "brightness_mean": round(float(gray.mean()), 4), "brightness_std": std, "contrast_std": std,
                        "saturation_fraction": round(float(((gray <= 1) | (gray >= 254)).mean()), 6), "estimated_cells": d["count"], "cell_method": method, "segmentation_quality": round(d["quality"], 3),
                        "median_cell_area": round(d["median"], 3), "cell_area_cv": round(d["cv"], 5), "border_object_fraction": round(d["border"], 5), "foreground_fraction": d["foreground"], "error": error, "loaded": True,
                    }
                except Exception as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    wanted = files.select("path", "content", F.round(F.col("length") / 1024, 2).alias("file_size_kb"), F.sha2("content", 256).alias("sha256"))
    out = wanted.mapInPandas(run, IMAGE_RESULT)
    if adaptive_qc:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    t = thresholds
    ok = F.col("loaded")
    flags = [
        F.when(~ok, "FAILED_TO_LOAD"),
        F.when(ok & (F.col("focus_score") < t.focus_min), "BLURRY"),
        F.when(ok & (F.col("brightness_mean") < t.brightness_min), "TOO_DARK"),
        F.when(ok & (F.col("brightness_mean") > t.brightness_max), "TOO_BRIGHT"),
        F.when(ok & (F.col("saturation_fraction") > t.saturation_max_fraction), "SATURATED"),
        F.when(ok & F.col("error").isNotNull(), "SEGMENTATION_FALLBACK"),
        F.when(ok & (F.col("estimated_cells") < t.cell_count_low), "FEW_OR_NO_CELLS"),
        F.when(ok & F.lit(t.cell_count_high is not None) & (F.col("estimated_cells") > F.lit(t.cell_count_high or 0)), "TOO_MANY_CELLS"),
        F.when(ok & (F.col("segmentation_quality") < 60), "LOW_SEGMENTATION_QUALITY"),
        F.when(ok & F.col("error").isNotNull(), "SEGMENTATION_WARNING"),
    ]
    out = out.withColumn("flags", F.array_join(F.array_compact(F.array(*flags)), "; ")).drop("loaded")
    if not adaptive_qc:
        return out.orderBy("path")
    if not exclude_failed:
        return adaptive_dataset_qc(out).orderBy("path")
    # Files that failed to load have no measurements: they neither move the medians nor are judged by them.
    failed = out.where(F.col("flags").contains("FAILED_TO_LOAD"))
    return adaptive_dataset_qc(out.where(~F.col("flags").contains("FAILED_TO_LOAD"))).unionByName(failed, allowMissingColumns=True).orderBy("path")


@dataclass(frozen=True)
class BatchConfig:
    """How a batch of files is analysed: files to a task, the segmenter by name, and whether a file's error ends the batch."""

    files_per_task: int = 64
    cell_method: str = "threshold"
    adaptive_qc: bool = True
    adaptive_threshold: bool = False
    fail_fast: bool = False

    def validate(self) -> None:
        if self.files_per_task < 1:
            raise ValueError("files_per_task must be at least 1")
        if self.cell_method not in available_backends():
            raise ValueError(f"cell_method must be one of {', '.join(available_backends())}")


def analyze_batch(spark: SparkSession, paths: list[str], config: BatchConfig = BatchConfig(), thresholds: QCThresholds = QCThresholds()) -> DataFrame:
    """Analyse paths in parallel.  With ``fail_fast`` the first file that can't be read raises when rows are computed."""
    config.validate()
    files = spark.read.format("binaryFile").load(paths)
    files = files.repartition(max(1, -(-len(paths) // config.files_per_task)))
    segmenter = None if config.cell_method == "threshold" else get_backend(config.cell_method)
    out = analyze_files(files, thresholds, segmenter=segmenter, adaptive_threshold=config.adaptive_threshold, adaptive_qc=config.adaptive_qc)
    if config.fail_fast:
        failed = F.raise_error(F.concat(F.lit("failed to load "), F.col("path"), F.lit(": "), F.coalesce("error", F.lit(""))))
        out = out.withColumn("error", F.when(F.col("flags").contains("FAILED_TO_LOAD"), failed.cast("string")).otherwise(F.col("error")))
    return out


def progress(spark: SparkSession) -> dict[str, int]:
    """Tasks done, running and in all of the session's active stages."""
    status = spark.sparkContext.statusTracker()
    stages = [s for s in map(status.getStageInfo, status.getActiveStageIds()) if s]
    return {"done": sum(s.numCompletedTasks for s in stages), "running": sum(s.numActiveTasks for s in stages), "tasks": sum(s.numTasks for s in stages)}


def analyze_folder(spark: SparkSession, folder: str, thresholds: QCThresholds = QCThresholds(), **options: object) -> DataFrame:
    return analyze_files(find_images(spark, folder), thresholds, **options)


def analyze_paths(spark: SparkSession, paths: list[str], thresholds: QCThresholds = QCThresholds(), **options: object) -> DataFrame:
    return analyze_files(spark.read.format("binaryFile").load(paths), thresholds, **options)
