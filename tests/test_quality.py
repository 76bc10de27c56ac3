import numpy as np
import pytest

from lumenframe import cli
from lumenframe.operators import quality, segmentation
from lumenframe.sources import images


def discs(n=3, size=96, level=220):
    y, x = np.mgrid[:size, :size]
    out = np.full((size, size), 40, np.uint8)
    for k in range(n):
        out[(y - 20 - 25 * k) ** 2 + (x - 30 - 12 * k) ** 2 <= 49] = level
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("images")
    (f / "b_cells.png").write_bytes(images.encode_png(discs()))
    (f / "a_empty.png").write_bytes(images.encode_png(np.zeros((64, 64), np.uint8)))
    (f / "c_broken.png").write_bytes(b"nothing")
    (f / "d.tif").write_bytes(images.encode_tiff(np.stack([discs(2)] * 2)))
    return f


def test_folder(spark, folder):
    rows = {r["filename"]: r for r in quality.analyze_folder(spark, str(folder)).collect()}
    assert list(rows) == sorted(rows)
    assert rows["b_cells.png"]["estimated_cells"] == 3 and len(rows["b_cells.png"]["sha256"]) == 64
    assert {"TOO_DARK", "FEW_OR_NO_CELLS", "LOW_SEGMENTATION_QUALITY"} <= set(rows["a_empty.png"]["flags"].split("; "))
    assert "FAILED_TO_LOAD" in rows["c_broken.png"]["flags"] and rows["c_broken.png"]["error"]
    assert rows["d.tif"]["estimated_cells"] == 2
    with pytest.raises(ValueError):
        quality.analyze_folder(spark, str(folder), quality.QCThresholds(brightness_min=240))


def test_folder_is_scanned_and_decoded_once(spark, folder):
    plan = quality.analyze_files(images.find_images(spark, str(folder)), adaptive_qc=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("FileScan binaryFile") == 1
    apart = quality.analyze_files(images.find_images(spark, str(folder)), exclude_failed=True).collect()
    assert [r["adaptive_score"] is None for r in apart] == [False, False, True, False]


def test_batches(spark, folder):
    paths = [str(folder / n) for n in ("b_cells.png", "d.tif")]
    assert quality.analyze_batch(spark, paths, quality.BatchConfig(files_per_task=1)).count() == 2
    for bad in (quality.BatchConfig(files_per_task=0), quality.BatchConfig(cell_method="magic")):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(Exception, match="failed to load"):
        quality.analyze_batch(spark, [str(folder / "c_broken.png")], quality.BatchConfig(fail_fast=True, adaptive_qc=False)).collect()
    assert set(quality.progress(spark)) == {"done", "running", "tasks"}


def test_fallback_and_backends(spark, folder):
    out = quality.analyze_paths(spark, [str(folder / "b_cells.png")], segmenter=segmentation.get_backend("cellpose"), adaptive_qc=False).first()
    assert "SEGMENTATION_FALLBACK" in out["flags"] and out["estimated_cells"] == 3
    loaded = images.load_images(images.find_images(spark, str(folder)).where("path LIKE '%cells%'"))
    agreed = segmentation.threshold_ensemble(loaded, "path").first()
    assert agreed["member_counts"]["threshold"] == 3 and agreed["chosen"]
    none = segmentation.compare_backends(loaded, "path", [segmentation.CellposeSegmenter()]).first()
    assert "no backend segmented the image" in none["warning"] and none["chosen"] is None
    assert not segmentation.CellposeSegmenter(gpu="auto").on_gpu()
    failed = segmentation.segment_images(loaded, "path", [segmentation.CellposeSegmenter()]).first()
    assert "cellpose" in failed["error"]
    with pytest.raises(ValueError):
        segmentation.get_backend("none")
    with pytest.raises(ValueError):
        segmentation.register_backend("threshold", segmentation.ThresholdSegmenter)
    smooth = segmentation.preprocess(loaded, [{"name": "gaussian", "sigma": 1.0}, {"name": "rescale"}]).first()
    assert smooth["dtype"] == "uint8" and len(smooth["data"]) == 96 * 96
    with pytest.raises(ValueError):
        segmentation.preprocess(loaded, [{"name": "magic"}])


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([str(folder), "-o", str(tmp_path / "csv"), "--json", str(tmp_path / "json")]) == 0
    assert "4 images" in capsys.readouterr().out and spark.read.json(str(tmp_path / "json" / "records")).count() == 4
