"""Operators over long pixel tables (image keys, y, x, v): acquisition metrics, texture, masks, object features.

Pixels are exploded inside the stage that aggregates them; nothing here keeps the long form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import kernels
from lumenframe.functions.columns import MAD_SCALE, number, ratio, require, with_scalars


def explode_pixels(df: DataFrame, array: str, width: int, *, keys: list[str], depth_area: int | None = None, value: str = "v") -> DataFrame:
    """Long form of a flat array column: (keys, [z,] y, x, value)."""
    flat = df.select(*keys, F.posexplode(array).alias("pos", value))
    if depth_area:
        z, rest = F.floor(F.col("pos") / depth_area).cast("int"), F.col("pos") % depth_area
        return flat.select(*keys, z.alias("z"), F.floor(rest / width).cast("int").alias("y"), (rest % width).alias("x"), F.col(value).cast("double").alias(value))
    return flat.select(*keys, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col(value).cast("double").alias(value))


def brightness(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg("v").alias("brightness_mean"), F.stddev_pop("v").alias("brightness_std"))


def saturation_fraction(px: DataFrame, keys: list[str], low: float = 1, high: float = 254) -> DataFrame:
    return px.groupBy(*keys).agg(F.coalesce(F.avg(((F.col("v") <= low) | (F.col("v") >= high)).cast("double")), F.lit(0.0)).alias("saturation_fraction"))


def _mirrored(px: DataFrame, keys: list[str], line: str, along: str) -> tuple[Column, Column]:
    """Values before and after a pixel along an axis, mirrored at the ends without repeating the edge."""
    w = Window.partitionBy(*keys, line).orderBy(along)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return F.coalesce(before, after, F.col("v")), F.coalesce(after, before, F.col("v"))


def focus_score(px: DataFrame, keys: list[str]) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian, borders mirrored."""
    left, right = _mirrored(px, keys, "y", "x")
    up, down = _mirrored(px, keys, "x", "y")
    return px.withColumn("__h", left + right).withColumn("__u", up + down).groupBy(*keys).agg(F.var_pop(F.col("__h") + F.col("__u") - 4 * F.col("v")).alias("focus_score"))


def channel_summary(px: DataFrame, keys: list[str], *, low: float = 0.0, high: float | None = None) -> DataFrame:
    """Per key (include the channel): mean, std, min, max, p01, p99 and the shares at the limits."""
    at_high = F.lit(False) if high is None else F.col("v") >= high
    p = F.percentile("v", F.array(F.lit(0.01), F.lit(0.99)))
    out = px.groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), p.alias("__p"),
        F.avg((F.col("v") <= low).cast("double")).alias("low_saturation"), F.avg(at_high.cast("double")).alias("high_saturation"),
    )
    return out.withColumn("p01", F.col("__p")[0]).withColumn("p99", F.col("__p")[1]).drop("__p")


def colocalization(df: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """Pearson r of two values per pixel row; 0 where either has no variance."""
    still = (F.coalesce(F.stddev_pop(a), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(b), F.lit(0.0)) == 0)
    top = F.avg(a * b) - F.avg(a) * F.avg(b)
    return df.groupBy(*keys).agg(F.when(still, 0.0).otherwise(ratio(top, F.stddev_pop(a) * F.stddev_pop(b))).alias("colocalization"))


def colocated_fraction(df: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.count_if(a & b), F.count_if(a), 0.0).alias("colocated_fraction"))


def artifact_metrics(px: DataFrame, keys: list[str]) -> DataFrame:
    """Clipping on the image's own range, background percentiles, global variation and mean-profile gradients."""
    rng = px.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    norm = F.when(F.col("__hi") > F.col("__lo"), (F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    p = F.percentile("v", F.array(F.lit(0.01), F.lit(0.05)))
    mean_abs = F.avg(F.abs(F.col("v")))
    out = with_scalars(px, keys, rng).withColumn("__n", norm).groupBy(*keys).agg(
        F.avg((F.col("__n") <= 0.001).cast("double")).alias("low_clip_fraction"), F.avg((F.col("__n") >= 0.999).cast("double")).alias("high_clip_fraction"),
        F.avg((F.col("__n") >= 0.9995).cast("double")).alias("hot_pixel_fraction"),
        (F.stddev_pop("v") / F.when(mean_abs != 0, mean_abs).otherwise(1.0)).alias("global_coefficient_of_variation"), p.alias("__p"),
    )
    out = out.withColumn("background_percentile_1", F.col("__p")[0]).withColumn("background_percentile_5", F.col("__p")[1]).drop("__p")
    for axis, name in (("x", "horizontal_gradient_cv"), ("y", "vertical_gradient_cv")):
        profile = px.groupBy(*keys, axis).agg(F.avg("v").alias("__m"))
        profile = profile.withColumn("__d", F.col("__m") - F.lag("__m").over(Window.partitionBy(*keys).orderBy(axis)))
        level = F.avg(F.abs(F.col("__m")))
        cv = F.coalesce(F.stddev_pop("__d"), F.lit(0.0)) / F.when(level != 0, level).otherwise(1.0)
        out = with_scalars(out, keys, profile.groupBy(*keys).agg(cv.alias(name)))
    return out


def texture_features(px: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the 256-bin density over [0, 255], deviation, absolute gradients, edge share and percentiles."""
    bins = px.where("v >= 0 AND v <= 255").withColumn("__b", F.least(F.lit(255), F.floor(F.col("v") * 256 / 255))).groupBy(*keys, "__b").agg(F.count("*").alias("__k"))
    density = F.col("__k") / F.sum("__k").over(Window.partitionBy(*keys)) / (255 / 256)
    entropy = bins.withColumn("__d", density).groupBy(*keys).agg((-F.sum(F.col("__d") * F.log2("__d"))).alias("entropy"))
    dx = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(*keys, "y").orderBy("x")))
    dy = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(*keys, "x").orderBy("y")))
    grads = px.withColumn("__dx", dx).withColumn("__dy", dy).withColumn("__g", F.explode(F.array("__dx", "__dy")))
    grad = grads.groupBy(*keys).agg(F.coalesce(F.avg("__g"), F.lit(0.0)).alias("gradient_mean"), F.coalesce(F.stddev_pop("__g"), F.lit(0.0)).alias("gradient_std"))
    p = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    base = px.groupBy(*keys).agg(F.stddev_pop("v").alias("std"), p.alias("__p"))
    edge = with_scalars(grads, keys, base.select(*keys, "std")).groupBy(*keys).agg(
        F.coalesce(F.avg((F.col("__g") > F.greatest(F.lit(1.0), F.col("std"))).cast("double")), F.lit(0.0)).alias("edge_fraction")
    )
    out = with_scalars(with_scalars(with_scalars(base, keys, entropy), keys, grad), keys, edge)
    return out.select(*keys, "entropy", "std", "gradient_mean", "gradient_std", "edge_fraction", *[F.col("__p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def object_texture_features(px: DataFrame, keys: list[str]) -> DataFrame:
    """Per label (column ``label``): entropy, deviation, p10, p90 and central-difference gradient magnitude."""
    def slope(line: str, along: str) -> Column:
        w = Window.partitionBy(*keys, line).orderBy(along)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.coalesce((after - before) / 2, after - F.col("v"), F.col("v") - before, F.lit(0.0))

    g = px.withColumn("__gx", slope("y", "x")).withColumn("__gy", slope("x", "y")).where("label > 0").withColumn("__g", F.hypot("__gx", "__gy"))
    k = [*keys, "label"]
    bins = g.withColumn("__b", F.least(F.lit(255), F.floor(F.col("v") * 256 / 255))).groupBy(*k, "__b").agg(F.count("*").alias("__k"))
    density = F.col("__k") / F.sum("__k").over(Window.partitionBy(*k)) / (255 / 256)
    entropy = bins.withColumn("__d", density).groupBy(*k).agg((-F.sum(F.col("__d") * F.log2("__d"))).alias("entropy"))
    p = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))
    base = g.groupBy(*k).agg(F.stddev_pop("v").alias("std"), p.alias("__p"), F.avg("__g").alias("gradient_mean"), F.stddev_pop("__g").alias("gradient_std"))
    return with_scalars(base, k, entropy).select(*k, "entropy", "std", F.col("__p")[0].alias("p10"), F.col("__p")[1].alias("p90"), "gradient_mean", "gradient_std")


def detect_hot_pixels(px: DataFrame, keys: list[str], z_threshold: float = 6.0) -> DataFrame:
    """Adds ``hot``: v over median + z 1.4826 MAD; never where the MAD is 0."""
    med = px.groupBy(*keys).agg(F.median("v").alias("__m"))
    out = with_scalars(px, keys, med)
    mad = out.groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("__m"))).alias("__d"))
    out = with_scalars(out, keys, mad)
    return out.withColumn("hot", (F.col("__d") > 0) & (F.col("v") > F.col("__m") + z_threshold * MAD_SCALE * F.col("__d"))).drop("__m", "__d")


def flat_field_correct(px: DataFrame, reference: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """v times the reference's mean over max(reference, eps); ``reference`` has y, x, r.

    A pixel that the reference lacks, or a reference that isn't positive, raises when the rows are computed."""
    mean = reference.agg(F.avg("r").alias("__mean"))
    joined = px.join(reference.select("y", "x", "r"), ["y", "x"], "left").crossJoin(F.broadcast(mean))
    lacking = F.raise_error(F.lit("image and reference must have identical shapes")).cast("double")
    dark = F.raise_error(F.lit("reference must contain strictly positive values")).cast("double")
    r = F.when(F.col("r").isNull(), lacking).when(F.col("r") <= 0, dark).otherwise(F.col("r"))
    return joined.withColumn("v", F.col("v") * F.col("__mean") / F.greatest(r, F.lit(eps))).drop("r", "__mean")


def project_z(px: DataFrame, keys: list[str], method: str = "max", *, integer: bool = False) -> DataFrame:
    """Max, mean or median over z; on integer types the latter two are truncated."""
    if method not in ("max", "mean", "median"):
        raise ValueError("method must be max, mean or median")
    v = getattr(F, {"max": "max", "mean": "avg", "median": "median"}[method])("v")
    return px.groupBy(*keys, "y", "x").agg((v.cast("long").cast("double") if integer else v).alias("v"))


def select_plane(px: DataFrame, axis: str, index: int) -> DataFrame:
    """One channel or timepoint; a table without that axis has index 0 alone, and an index that no row has is an error."""
    if axis not in px.columns:
        if index:
            raise IndexError(f"no {axis} axis: only index 0")
        return px
    plane = px.where(F.col(axis) == index)
    if plane.isEmpty():
        raise IndexError(f"{axis} has no index {index}")
    return plane.drop(axis)


def chunk_ids(px: DataFrame, axis: str, chunk_size: int) -> DataFrame:
    if chunk_size < 1 or axis not in px.columns:
        raise ValueError("chunk_size must be positive and the axis there")
    return px.withColumn("chunk", F.floor(F.col(axis) / chunk_size).cast("int"))


def pixel_metrics(df: DataFrame, pred: Column, truth: Column, keys: list[str]) -> DataFrame:
    """IoU, Dice, precision and recall of two masks; nothing over nothing is 1."""
    out = df.groupBy(*keys).agg(F.count_if(pred & truth).alias("tp"), F.count_if(pred).alias("p"), F.count_if(truth).alias("t"))
    tp, p, t = (F.col(c) for c in ("tp", "p", "t"))
    return out.select(*keys, ratio(tp, p + t - tp, 1.0).alias("iou"), ratio(2 * tp, p + t, 1.0).alias("dice"), ratio(tp, p, 1.0).alias("precision"), ratio(tp, t, 1.0).alias("recall"))


def count_error(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    off, t = F.abs(F.col(predicted) - F.col(truth)), F.col(truth)
    relative = F.when(t != 0, off / t).when(F.col(predicted) == 0, 0.0).otherwise(float("inf"))
    return df.select("*", off.alias("absolute_count_error"), relative.alias("relative_count_error"))


def otsu_threshold(px: DataFrame, keys: list[str], *, bins: int = 256) -> DataFrame:
    """Otsu's threshold on values in [0, 1]: centre of the first bin of largest between-class variance; empty: 0.5."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("v") * bins)).cast("int")
    hist = px.where("v >= 0 AND v <= 1").withColumn("b", b).groupBy(*keys, "b").agg(F.count("*").cast("double").alias("n")).withColumn("c", (F.col("b") + 0.5) / bins)
    order = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = hist.withColumn("w", F.sum("n").over(order)).withColumn("m", F.sum(F.col("n") * F.col("c")).over(order)).withColumn("__w", F.sum("n").over(whole)).withColumn("__m", F.sum(F.col("n") * F.col("c")).over(whole))
    above = F.col("__w") - F.col("w")
    gap = ratio(F.col("m"), F.col("w")) - ratio(F.col("__m") - F.col("m"), above)
    hist = hist.withColumn("__s", F.coalesce(F.col("w") * above * gap * gap, F.lit(0.0)))
    found = hist.groupBy(*keys).agg(F.max_by("c", F.struct(F.round("__s", 9), -F.col("b"))).alias("otsu_threshold"))
    images = px.select(*keys).distinct()
    return with_scalars(images, keys, found).fillna(0.5, ["otsu_threshold"])


def object_features(px: DataFrame, keys: list[str]) -> DataFrame:
    """Per label: area, box, aspect, centroid and intensity (mean, population std, max)."""
    out = px.where("label > 0").groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.min("x").alias("bbox_x"), F.min("y").alias("bbox_y"), (F.max("x") - F.min("x") + 1).alias("bbox_width"), (F.max("y") - F.min("y") + 1).alias("bbox_height"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.avg("v").alias("mean_intensity"), F.stddev_pop("v").alias("std_intensity"), F.max("v").alias("max_intensity"),
    )
    return out.withColumn("aspect_ratio", F.col("bbox_width") / F.col("bbox_height"))


SHAPE_SCHEMA = "label int, perimeter double, circularity double"


def object_shapes(px: DataFrame, keys: list[str], *, parts: int = 1) -> DataFrame:
    """Per label: length of the outer border (8-connected steps) and circularity, 4 pi area over its square, in [0, 1].

    The labels of an image are traced together in one task; those of a very large image fall into ``parts`` groups.
    A lone cell has neither."""
    kinds, n = dict(px.dtypes), len(keys)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        labels, area, border = kernels.perimeters(*(pdf[c].to_numpy() for c in ("label", "y", "x")))
        shape = np.minimum(1.0, 4 * np.pi * area / np.where(border > 0, border, np.inf) ** 2)
        return pd.DataFrame({**dict(zip(keys, ([k] * len(labels) for k in key[:n]))), "label": labels, "perimeter": border, "circularity": shape})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), SHAPE_SCHEMA])
    rows = px.where("label > 0").select(*keys, F.col("label").cast("int").alias("label"), "y", "x")
    return rows.groupBy(*keys, F.pmod("label", F.lit(parts)).alias("__part")).applyInPandas(kernel, schema)


def extract_object_features(px: DataFrame, keys: list[str], *, parts: int = 1) -> DataFrame:
    """:func:`object_features` with perimeter and circularity; the pixels of an image (or of a part of its labels) meet in one task."""
    return object_features(px, keys).join(object_shapes(px, keys, parts=parts), [*keys, "label"])


def object_channel_intensity(px: DataFrame, keys: list[str]) -> DataFrame:
    """Per label and channel (columns ``label``, ``c``): mean, median, population std, max, sum."""
    named = (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop), ("max", F.max), ("sum", F.sum))
    return px.where("label > 0").groupBy(*keys, "label", "c").agg(*[f("v").alias(f"{n}_intensity") for n, f in named])


def segmentation_diagnostics(objects: DataFrame, images: DataFrame, keys: list[str], *, min_area: int = 15, max_area_frac: float = 0.25) -> DataFrame:
    """Per image: share of border, tiny and merged objects and the quality score.  ``images``: keys, height, width."""
    o = objects.join(images, keys)
    border = (F.col("bbox_x") <= 0) | (F.col("bbox_y") <= 0) | (F.col("bbox_x") + F.col("bbox_width") >= F.col("width")) | (F.col("bbox_y") + F.col("bbox_height") >= F.col("height"))
    stats = o.groupBy(*keys).agg(
        F.count("*").alias("object_count"), F.sum("area").alias("__fg"), F.median("area").alias("median_area"), F.coalesce(ratio(F.stddev_samp("area"), F.avg("area")), F.lit(0.0)).alias("area_cv"),
        F.avg(border.cast("double")).alias("border_fraction"), F.avg((F.col("area") < 2 * min_area).cast("double")).alias("tiny_object_fraction"),
        F.avg((F.col("area") > 0.5 * max_area_frac * F.col("height") * F.col("width")).cast("double")).alias("merged_object_fraction"),
    )
    out = with_scalars(images, keys, stats)
    none = F.col("object_count").isNull()
    quality = 100 - F.least(F.lit(45.0), 30 * F.col("border_fraction")) - F.least(F.lit(30.0), 30 * F.col("tiny_object_fraction")) - F.least(F.lit(25.0), 25 * F.col("merged_object_fraction"))
    return out.select(
        *keys, F.coalesce("object_count", F.lit(0)).alias("object_count"), F.coalesce(F.col("__fg") / (F.col("height") * F.col("width")), F.lit(0.0)).alias("foreground_fraction"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median_area", "area_cv", "border_fraction")], F.when(none, 1.0).otherwise(F.col("tiny_object_fraction")).alias("tiny_object_fraction"),
        F.coalesce("merged_object_fraction", F.lit(0.0)).alias("merged_object_fraction"), F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), quality)).alias("quality_score"),
    )


def nearest_neighbors(objects: DataFrame, keys: list[str], *, id_column: str = "label", axes: tuple[str, ...] = ("centroid_x", "centroid_y"), output: str = "nearest_neighbor_distance") -> DataFrame:
    """Distance to the nearest other object of the same key; a single object has none.

    Objects fall into cells of a grid that hold about two each.  What lies in the cells around an object's own is
    nearer than anything beyond them, if it is within a cell's side; the few objects for which that finds nothing
    are compared with all of their key."""
    a = objects.select(*keys, F.col(id_column).alias("__own_id"), *[number(x).alias(f"__a_{x}") for x in axes])
    extent = a.groupBy(*keys).agg(F.count("*").alias("__n"), *[f(f"__a_{x}").alias(f"__{n}_{x}") for x in axes for n, f in (("lo", F.min), ("hi", F.max))])
    side = F.greatest(*[F.col(f"__hi_{x}") - F.col(f"__lo_{x}") for x in axes], F.lit(1e-9)) / F.greatest(F.lit(1.0), F.pow(F.col("__n") / 2, F.lit(1.0 / len(axes))))
    a = with_scalars(a, keys, extent.select(*keys, *[f"__lo_{x}" for x in axes], side.alias("__side")))
    cell = {x: F.floor((F.col(f"__a_{x}") - F.col(f"__lo_{x}")) / F.col("__side")).cast("long") for x in axes}
    a = a.select(*keys, "__own_id", "__side", *[f"__a_{x}" for x in axes], *[c.alias(f"__c_{x}") for x, c in cell.items()])
    b = a.select(*keys, F.col("__own_id").alias("__other_id"), *[F.col(f"__a_{x}").alias(f"__b_{x}") for x in axes], *[f"__c_{x}" for x in axes])
    around = a
    for x in axes:
        around = around.withColumn(f"__s_{x}", F.explode(F.array(*[F.col(f"__c_{x}") + k for k in (-1, 0, 1)]))).drop(f"__c_{x}").withColumnRenamed(f"__s_{x}", f"__c_{x}")
    d = F.sqrt(sum((F.pow(F.col(f"__a_{x}") - F.col(f"__b_{x}"), 2) for x in axes), F.lit(0.0)))
    close = around.join(b, [*keys, *[f"__c_{x}" for x in axes]]).where("__own_id <> __other_id").groupBy(*keys, "__own_id").agg(F.min(d).alias("__close"), F.first("__side").alias("__side"))
    sure = close.where(F.col("__close") <= F.col("__side")).select(*keys, "__own_id", F.col("__close").alias(output))
    open_ = a.join(sure, [*keys, "__own_id"], "left_anti")
    far = open_.drop(*[f"__c_{x}" for x in axes]).join(b.drop(*[f"__c_{x}" for x in axes]), keys).where("__own_id <> __other_id").groupBy(*keys, "__own_id").agg(F.min(d).alias(output))
    return objects.join(sure.unionByName(far).withColumnRenamed("__own_id", id_column), [*keys, id_column], "left")


def add_spatial_features(objects: DataFrame, keys: list[str], *, height: int, width: int, id_column: str = "label") -> DataFrame:
    out = nearest_neighbors(objects, keys, id_column=id_column)
    density = F.count("*").over(Window.partitionBy(*keys)) / (height * width / 100_000)
    return out.withColumn("normalized_x", F.col("centroid_x") / width).withColumn("normalized_y", F.col("centroid_y") / height).withColumn("local_density_per_100k_px", density)


def summarize_spatial_features(spatial: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("nearest_neighbor_distance")
    return spatial.groupBy(*keys).agg(
        F.count("*").alias("object_count"), F.first("local_density_per_100k_px").alias("density_per_100k_px"), F.avg(d).alias("mean_nn"), F.median(d).alias("median_nn"), F.coalesce(ratio(F.stddev_samp(d), F.avg(d)), F.lit(0.0)).alias("nn_cv")
    )


def assign_nuclei_to_cells(cells: DataFrame, nuclei: DataFrame, keys: list[str], *, max_distance: float | None = None) -> DataFrame:
    """(keys, nucleus, cell): the cell under the nucleus' rounded centroid, else the nearest one; beyond the gate 0."""
    centre = nuclei.where("label > 0").groupBy(*keys, F.col("label").alias("nucleus")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    spots = centre.withColumn("y", F.rint("cy").cast("int")).withColumn("x", F.rint("cx").cast("int"))
    under = spots.join(cells.where("label > 0").select(*keys, "y", "x", F.col("label").alias("under")), [*keys, "y", "x"], "left")
    bodies = cells.where("label > 0").groupBy(*keys, F.col("label").alias("body")).agg(F.avg("y").alias("by"), F.avg("x").alias("bx"))
    lone = under.where("under IS NULL").join(bodies, keys)
    d = F.hypot(F.col("cy") - F.col("by"), F.col("cx") - F.col("bx"))
    near = lone.groupBy(*keys, "nucleus").agg(F.min_by("body", F.struct(d, F.col("body"))).alias("near"), F.min(d).alias("distance"))
    gated = F.col("near") if max_distance is None else F.when(F.col("distance") <= max_distance, F.col("near"))
    near = near.withColumn("near", gated)
    return under.join(near, [*keys, "nucleus"], "left").select(*keys, "nucleus", F.coalesce("under", "near", F.lit(0)).alias("cell"))


def compartment_features(px: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: nuclei, nucleus and cytoplasm areas and intensities.  ``px``: keys, y, x, v, cell, nucleus (0: none)."""
    owner = assigned.select(*keys, F.col("nucleus").alias("nucleus"), F.col("cell").alias("owner"))
    cell = px.where("cell > 0").groupBy(*keys, "cell").agg(
        F.count("*").alias("cell_area"), F.avg("v").alias("cell_mean"), F.count_if(F.col("nucleus") == 0).alias("cytoplasm_area"), F.avg(F.when(F.col("nucleus") == 0, F.col("v"))).alias("cytoplasm_mean")
    )
    nuc = px.where("nucleus > 0").join(owner, [*keys, "nucleus"]).where("owner > 0").groupBy(*keys, F.col("owner").alias("cell")).agg(
        F.countDistinct("nucleus").alias("nucleus_count"), F.count("*").alias("nucleus_area"), F.avg("v").alias("nucleus_mean")
    )
    out = cell.join(nuc, [*keys, "cell"], "left").fillna(0, ["nucleus_count", "nucleus_area"])
    return out.withColumn("nucleus_cell_ratio", ratio(F.col("nucleus_area"), F.col("cell_area"), 0.0)).withColumn("nucleus_cytoplasm_ratio", ratio(F.col("nucleus_mean"), F.col("cytoplasm_mean")))


def volume_features(vx: DataFrame, keys: list[str], *, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per label of (z, y, x, label): voxels, volume, centroids, box and exposed surface (array borders count)."""
    axes, faces = ("z", "y", "x"), (voxel[1] * voxel[2], voxel[0] * voxel[2], voxel[0] * voxel[1])
    area = F.lit(0.0)
    rows = vx.where("label > 0")
    for axis, face in zip(axes, faces):
        w = Window.partitionBy(*keys, "label", *[a for a in axes if a != axis]).orderBy(axis)
        open_before = F.coalesce(F.col(axis) - F.lag(axis).over(w) != 1, F.lit(True))
        open_after = F.coalesce(F.lead(axis).over(w) - F.col(axis) != 1, F.lit(True))
        rows = rows.withColumn(f"__{axis}", (open_before.cast("int") + open_after.cast("int")) * face)
        area = area + F.col(f"__{axis}")
    size = voxel[0] * voxel[1] * voxel[2]
    out = [F.count("*").alias("voxel_count"), (F.count("*") * size).alias("volume")]
    for axis, step in zip(axes, voxel):
        out += [F.avg(axis).alias(f"centroid_{axis}"), (F.avg(axis) * step).alias(f"centroid_{axis}_um"), F.min(axis).alias(f"{axis}_min"), F.max(axis).alias(f"{axis}_max")]
    return rows.groupBy(*keys, "label").agg(*out, F.sum(area).alias("surface_area"))


def validate_labels(vx: DataFrame) -> DataFrame:
    """Label volumes: columns z, y, x and whole-number labels, or a ValueError."""
    require(vx, "z", "y", "x", "label")
    if dict(vx.dtypes)["label"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("labels must be whole numbers")
    return vx


def summarize_volume(features: DataFrame, voxels_in_volume: int, keys: list[str], *, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), volumes: DataFrame | None = None) -> DataFrame:
    """Counts, volumes and densities of each key's objects.  ``volumes`` has the keys of all volumes: those without objects get zeros."""
    if len(voxel) != 3 or min(voxel) <= 0:
        raise ValueError("voxel must be three positive sizes")
    whole = voxels_in_volume * voxel[0] * voxel[1] * voxel[2]
    out = features.groupBy(*keys).agg(
        F.count("*").alias("object_count"), F.sum("volume").alias("total_volume"), F.avg("volume").alias("mean_volume"), F.median("volume").alias("median_volume"),
        (F.sum("volume") / whole).alias("volume_fraction"), (F.count("*") / (whole / 1e9)).alias("density_per_mm3"),
    )
    if volumes is None:
        return out
    return with_scalars(volumes.select(*keys).distinct(), keys, out).fillna(0, ["object_count", "total_volume", "volume_fraction", "density_per_mm3"])


def ensemble_agreement(members: DataFrame, keys: list[str], *, min_agreement: float = 0.6) -> DataFrame:
    """Consensus of segmentations of one image: (keys, member, idx, y, x, label > 0) -> counts, mean pairwise IoU, choice."""
    counts = members.groupBy(*keys, "member", "idx").agg(F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("n"))
    fg = members.where("label > 0").select(*keys, "member", "idx", "y", "x")
    size = fg.groupBy(*keys, "idx").agg(F.count("*").alias("s"))
    names = counts.select(*keys, "idx")
    pairs = names.withColumnRenamed("idx", "i").join(names.withColumnRenamed("idx", "j"), keys).where("i < j")
    both = fg.select(*keys, F.col("idx").alias("i"), "y", "x").join(fg.select(*keys, F.col("idx").alias("j"), "y", "x"), [*keys, "y", "x"]).where("i < j").groupBy(*keys, "i", "j").agg(F.count("*").alias("both"))
    for side in "ij":
        pairs = pairs.join(size.select(*keys, F.col("idx").alias(side), F.col("s").alias(f"s{side}")), [*keys, side], "left")
    pairs = pairs.join(both, [*keys, "i", "j"], "left").fillna(0, ["si", "sj", "both"])
    iou = pairs.groupBy(*keys).agg(F.avg(ratio(F.col("both"), F.col("si") + F.col("sj") - F.col("both"), 1.0)).alias("agreement_fraction"))
    med = counts.groupBy(*keys).agg(F.median("n").alias("median_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "n")))).alias("member_counts"))
    off = with_scalars(counts, keys, med).withColumn("__off", F.abs(F.col("n") - F.col("median_count")))
    pick = off.groupBy(*keys).agg(F.median("__off").alias("mad_count"), F.min_by("member", F.struct("__off", "idx")).alias("chosen"))
    out = with_scalars(with_scalars(med, keys, pick), keys, iou).fillna(1.0, ["agreement_fraction"])
    return out.withColumn("warning", F.when(F.col("agreement_fraction") < min_agreement, F.lit("segmentation members disagree")))


def threshold_sensitivity(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a segmenter, (keys, threshold, object_count, foreground_fraction), with their count CV and foreground range."""
    w = Window.partitionBy(*keys)
    cv = F.coalesce(ratio(F.stddev_samp("object_count").over(w), F.avg("object_count").over(w)), F.lit(0.0))
    return runs.dropDuplicates([*keys, "threshold"]).withColumn("count_cv", cv).withColumn("foreground_range", F.max("foreground_fraction").over(w) - F.min("foreground_fraction").over(w))
