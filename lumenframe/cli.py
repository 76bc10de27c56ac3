"""Command line: quality control of a folder of images."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.quality import QCThresholds, analyze_folder
from lumenframe.operators.reporting import write_json
from lumenframe.operators.segmentation import available_backends, get_backend
from lumenframe.shipping import ship_package


def main(argv: Sequence[str] | None = None) -> int:
    d = QCThresholds()
    p = argparse.ArgumentParser(prog="lumenframe", description=__doc__)
    p.add_argument("input", help="folder of images")
    p.add_argument("-o", "--output", help="folder for CSV")
    p.add_argument("--json", help="folder for JSON records and metadata")
    p.add_argument("--cell-method", default="threshold", choices=available_backends())
    p.add_argument("--adaptive-threshold", action="store_true")
    p.add_argument("--no-adaptive-qc", action="store_true")
    for name in ("focus_min", "brightness_min", "brightness_max", "max_cell_area_frac"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(d, name))
    for name in ("min_cell_area", "cell_count_low", "cell_count_high"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    a = p.parse_args(argv)
    limits = QCThresholds(a.focus_min, a.brightness_min, a.brightness_max, d.saturation_max_fraction, a.min_cell_area, a.max_cell_area_frac, a.cell_count_low, a.cell_count_high)
    spark = ship_package(SparkSession.builder.appName("lumenframe").getOrCreate())
    backend = None if a.cell_method == "threshold" else get_backend(a.cell_method)
    rows = analyze_folder(spark, a.input, limits, segmenter=backend, adaptive_threshold=a.adaptive_threshold, adaptive_qc=not a.no_adaptive_qc).cache()
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("flags") != "").alias("flagged"), F.count_if(F.col("flags").contains("FAILED_TO_LOAD")).alias("failed")).first()
    print(f"{counts['n']} images, {counts['flagged']} flagged, {counts['failed']} failed")
    if a.output:
        rows.write.mode("overwrite").option("header", True).csv(a.output)
    if a.json:
        write_json(rows, a.json, {"cell_method": a.cell_method})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
