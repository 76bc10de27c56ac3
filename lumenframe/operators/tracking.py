"""Linking of objects over frames: one transition function, used per series in batch and in streaming."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import dealt
from lumenframe.functions.kernels import sparse_assign


@dataclass(frozen=True)
class TrackingConfig:
    """Gate in the units of the axes, gaps allowed, and smoothing of the velocity used for prediction."""

    max_distance: float = 25.0
    max_gap: int = 0
    use_velocity: bool = True
    velocity_smoothing: float = 0.5

    def validate(self) -> None:
        if self.max_distance <= 0 or self.max_gap < 0 or not 0 <= self.velocity_smoothing <= 1:
            raise ValueError("max_distance must be positive, max_gap not negative, velocity_smoothing in [0, 1]")


@dataclass
class TrackState:
    """Active tracks by track id (never by label: labels may swap): last frame, position and velocity."""

    next_id: int = 1
    active: dict[int, tuple[int, list[float], list[float]]] = field(default_factory=dict)


def advance(state: TrackState, frame: int, labels: list[int], points: np.ndarray, config: TrackingConfig) -> list[tuple]:
    """Link one frame's objects; returns (track_id, frame, label, *point, distance, gap, confidence)."""
    old = [(t, *s) for t, s in sorted(state.active.items()) if frame - s[0] - 1 <= config.max_gap]
    gaps = np.array([frame - last for _, last, _, _ in old], float)
    at = np.array([p for _, _, p, _ in old], float).reshape(len(old), points.shape[1])
    speed = np.array([v for _, _, _, v in old], float).reshape(len(old), points.shape[1])
    rows, matched = [], set()
    if len(old) and len(labels):
        seen = at + speed * gaps[:, None] if config.use_velocity else at
        limit = config.max_distance * gaps
        for r, c, distance in sparse_assign(seen, points, limit):
            track, last, before, velocity = old[r]
            step = (points[c] - np.array(before)) / gaps[r]
            a = config.velocity_smoothing
            state.active[track] = (frame, points[c].tolist(), (a * step + (1 - a) * np.array(velocity)).tolist())
            rows.append((track, frame, labels[c], *points[c].tolist(), distance, int(gaps[r]) - 1, float(max(0.0, 1 - distance / limit[r]))))
            matched.add(c)
    for c, label in enumerate(labels):
        if c not in matched:
            state.active[state.next_id] = (frame, points[c].tolist(), [0.0] * points.shape[1])
            rows.append((state.next_id, frame, label, *points[c].tolist(), 0.0, 0, 1.0))
            state.next_id += 1
    for track in [t for t, s in state.active.items() if frame - s[0] >= config.max_gap + 1]:
        del state.active[track]
    return rows


def track_columns(axes: tuple[str, ...]) -> list[str]:
    return ["track_id", "frame", "label", *axes, "distance", "gap", "confidence"]


def track_schema(axes: tuple[str, ...]) -> str:
    return "track_id long, frame int, label int, " + ", ".join(f"{a} double" for a in axes) + ", distance double, gap int, confidence double"


def centroids(labels: DataFrame, keys: list[str], *, axes: tuple[str, ...] = ("x", "y"), voxel: tuple[float, ...] | None = None) -> DataFrame:
    """Mean position of each label of each frame, in voxel units if given."""
    scale = voxel or (1.0,) * len(axes)
    return labels.where("label > 0").groupBy(*keys, "frame", "label").agg(*[(F.avg(a) * s).alias(a) for a, s in zip(axes, scale)])


def link_frames(points: DataFrame, series: str, *, axes: tuple[str, ...] = ("x", "y"), config: TrackingConfig = TrackingConfig()) -> DataFrame:
    """Tracks of every series, from centroid rows (series, frame, label, axes); series run in parallel.

    They are dealt out by their number: the rows are small, and by bytes a million of them would be one task's.
    """
    config.validate()
    kind = dict(points.dtypes)[series]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = TrackState(), []
        frame, label, at = pdf["frame"].to_numpy(), pdf["label"].to_numpy(int), pdf[list(axes)].to_numpy(float)
        order = np.lexsort((label, frame))
        for own in np.split(order, np.flatnonzero(np.diff(frame[order])) + 1):
            rows += advance(state, int(frame[own[0]]), label[own].tolist(), at[own], config)
        out = pd.DataFrame(rows, columns=track_columns(axes))
        out.insert(0, series, pdf[series].iloc[0])
        return out

    return dealt(points.select(series, "frame", "label", *axes).where("frame IS NOT NULL"), series).groupBy(series).applyInPandas(kernel, f"`{series}` {kind}, {track_schema(axes)}")


MATCH_SCHEMA = "tp long, fp long, fn long"


def match_instances(pred: DataFrame, truth: DataFrame, key: str, *, axes: tuple[str, ...] = ("x", "y"), max_distance: float = 20.0) -> DataFrame:
    """Optimal centroid matching of two centroid tables within a gate: tp, fp, fn, precision, recall, f1 and count errors."""
    kind = dict(pred.dtypes)[key]
    both = pred.select(key, F.lit(0).alias("side"), *axes).unionByName(truth.select(key, F.lit(1).alias("side"), *axes))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[pdf["side"] == s, list(axes)].to_numpy(float) for s in (0, 1))
        tp = len(sparse_assign(a, b, np.full(len(a), max_distance), max_distance + 1))
        return pd.DataFrame([(pdf[key].iloc[0], int(tp), len(a) - int(tp), len(b) - int(tp))], columns=[key, "tp", "fp", "fn"])

    m = dealt(both, key).groupBy(key).applyInPandas(kernel, f"`{key}` {kind}, {MATCH_SCHEMA}")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(1.0)
    return m.select("*", precision.alias("instance_precision"), recall.alias("instance_recall"), f1.alias("instance_f1"), F.abs(fp - fn).alias("absolute_count_error"))
