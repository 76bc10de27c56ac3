"""Segmentation of packed images in tasks, the registry of segmenters, and preprocessing kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from time import perf_counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import kernels
from lumenframe.operators.pixels import ensemble_agreement


class Segmenter(Protocol):
    """What a backend offers: a name, and labels of an 8-bit grey image."""

    name: str

    def segment(self, gray: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class ThresholdSegmenter:
    min_area: int = 15
    max_area_frac: float = 0.25
    adaptive: bool = False

    @property
    def name(self) -> str:
        return "threshold:adaptive" if self.adaptive else "threshold"

    def segment(self, gray: np.ndarray) -> np.ndarray:
        return kernels.segment_gray(gray, min_area=self.min_area, max_area_frac=self.max_area_frac, adaptive=self.adaptive)


@dataclass(frozen=True)
class NucleusSegmenter:
    min_area: int = 20
    max_area_frac: float = 0.15
    adaptive: bool = False
    name: str = "nuclei"

    def segment(self, gray: np.ndarray) -> np.ndarray:
        return kernels.segment_nuclei(gray, min_area=self.min_area, max_area_frac=self.max_area_frac, adaptive=self.adaptive)


@dataclass(frozen=True)
class CellposeSegmenter:
    """Optional neural backend; the model is loaded once per Python worker, on first use."""

    model_type: str = "cyto"
    gpu: bool | str = False  # "auto": where the executor sees a device

    @property
    def name(self) -> str:
        return f"cellpose:{self.model_type}:{'auto' if self.gpu == 'auto' else 'gpu' if self.gpu else 'cpu'}"

    def on_gpu(self) -> bool:
        if self.gpu != "auto":
            return bool(self.gpu)
        try:
            from torch import cuda
        except ImportError:
            return False
        return bool(cuda.is_available())

    def segment(self, gray: np.ndarray) -> np.ndarray:
        try:
            from cellpose import models
        except ImportError as e:
            raise RuntimeError("the cellpose package is not installed") from e
        if self not in _MODELS:
            kind = getattr(models, "CellposeModel", None) or models.Cellpose
            _MODELS[self] = kind(gpu=self.on_gpu(), model_type=self.model_type)
        return np.asarray(_MODELS[self].eval(gray)[0], np.int32)


_MODELS: dict[CellposeSegmenter, object] = {}
_FACTORIES: dict[str, Callable[..., Segmenter]] = {}


def register_backend(name: str, factory: Callable[..., Segmenter], *, overwrite: bool = False) -> None:
    if name.lower() in _FACTORIES and not overwrite:
        raise ValueError(f"backend {name!r} is registered already")
    _FACTORIES[name.lower()] = factory


def available_backends() -> tuple[str, ...]:
    return tuple(sorted(_FACTORIES))


def get_backend(name: str, **options: object) -> Segmenter:
    if name.lower() not in _FACTORIES:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(available_backends())}")
    return _FACTORIES[name.lower()](**options)


register_backend("threshold", ThresholdSegmenter)
register_backend("nuclei", NucleusSegmenter)
register_backend("cellpose", CellposeSegmenter)

LABEL_SCHEMA = "{key}, member string, idx int, height int, width int, labels array<int>, seconds double, error string"


def image_of(row: object) -> np.ndarray:
    return np.frombuffer(row.data, np.dtype(row.dtype)).reshape(tuple(row.shape))


def segment_images(images: DataFrame, key: str, backends: list[Segmenter]) -> DataFrame:
    """One row per image and backend: labels (flat), seconds and, isolated to its row, the error."""
    kind = f"`{key}` {dict(images.dtypes)[key]}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                for k, backend in enumerate(backends):
                    began, labels, error = perf_counter(), None, None
                    try:
                        labels = backend.segment(kernels.to_gray(image_of(row)))
                    except Exception as e:
                        error = str(e)
                    h, w = labels.shape if labels is not None else (0, 0)
                    flat = labels.ravel().tolist() if labels is not None else []
                    out = (getattr(row, key), backend.name, k, h, w, flat, perf_counter() - began, error)
                    yield pd.DataFrame([out], columns=[key, "member", "idx", "height", "width", "labels", "seconds", "error"])

    return images.select(key, "shape", "dtype", "data").where("data IS NOT NULL").mapInPandas(run, LABEL_SCHEMA.format(key=kind))


def label_pixels(segmented: DataFrame, key: str) -> DataFrame:
    """Long form of the labels: key, member, idx, y, x, label."""
    long = segmented.select(key, "member", "idx", "width", F.posexplode("labels").alias("pos", "label"))
    return long.select(key, "member", "idx", F.expr("CAST(pos DIV width AS INT)").alias("y"), (F.col("pos") % F.col("width")).alias("x"), "label")


def compare_backends(images: DataFrame, key: str, backends: list[Segmenter], *, min_agreement: float = 0.6) -> DataFrame:
    """Run every backend on every image and reach a consensus per image.

    An image that no backend could segment is a row whose ``warning`` has the errors; so is one without pixels."""
    runs = segment_images(images, key, backends).persist(StorageLevel.MEMORY_AND_DISK)  # segmented once, looked at twice
    agreed = ensemble_agreement(label_pixels(runs.where("error IS NULL"), key), [key], min_agreement=min_agreement)
    errors = runs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "member", "error"))), "; ").alias("__errors"), F.count_if(F.col("error").isNull()).alias("__done"))
    out = images.select(key).join(agreed, key, "left").join(errors, key, "left")
    none = F.coalesce(F.col("__done") == 0, F.lit(True))
    return out.withColumn("warning", F.when(none, F.concat(F.lit("no backend segmented the image: "), F.coalesce("__errors", F.lit("no data")))).otherwise(F.col("warning"))).drop("__errors", "__done")


def threshold_ensemble(images: DataFrame, key: str, *, min_area: int = 15, max_area_frac: float = 0.25) -> DataFrame:
    members = [ThresholdSegmenter(min_area, max_area_frac, a) for a in (False, True)]
    return compare_backends(images, key, list(members))


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "gaussian": lambda x, sigma=0.8: kernels.gaussian(x, sigma),
    "background": lambda x, sigma=15.0: kernels.gaussian(x, sigma),
    "subtract_background": lambda x, sigma=15.0: np.clip(x - kernels.gaussian(x, sigma), 0, None).astype(x.dtype),
    "top_hat": lambda x, radius=25: kernels.top_hat(x, radius),
    "rescale": kernels.rescale_to_uint8,
    "gray": kernels.to_gray,
}


def preprocess(images: DataFrame, operations: list[dict[str, object]]) -> DataFrame:
    """Apply named kernels, one after another, to packed images; shape, dtype and data are replaced."""
    for operation in operations:
        if operation.get("name") not in KERNELS:
            raise ValueError(f"unknown preprocessing operation: {operation.get('name')!r}")
    others = [c for c in images.columns if c not in ("shape", "dtype", "data")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, row in enumerate(frame.itertuples(index=False)):
                x = image_of(row)
                for operation in operations:
                    x = KERNELS[str(operation["name"])](x, **{n: v for n, v in operation.items() if n != "name"})
                one = frame.iloc[[k]][others].copy()
                one["shape"], one["dtype"], one["data"] = [list(x.shape)], [str(x.dtype)], [np.ascontiguousarray(x).tobytes()]
                yield one

    kinds = dict(images.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["shape array<int>", "dtype string", "data binary"])
    return images.where("data IS NOT NULL").mapInPandas(run, schema)


def preprocessing_manifest(operations: list[dict[str, object]]) -> dict[str, object]:
    if any(not o.get("name") for o in operations):
        raise ValueError("every operation needs a name")
    return {"operations": [dict(o) for o in operations]}
