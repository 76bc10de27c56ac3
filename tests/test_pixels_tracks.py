import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import kernels as k, tiff
from lumenframe.operators import pixels, tracking, tracks
from lumenframe.sources import images
from lumenframe.streaming.tracking import link_stream


def long(spark, arrays, name="v", kind="double"):
    rows = [(i, int(y), int(x), float(v) if kind == "double" else int(v)) for i, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"image_id int, y int, x int, {name} {kind}")


def disc_image():
    y, x = np.mgrid[:100, :100]
    return np.where(((y - 25) ** 2 + (x - 25) ** 2 <= 64) | ((y - 75) ** 2 + (x - 75) ** 2 <= 81), 255, 0).astype(np.uint8)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 3), (5, 5)):
        cost = rng.random((n, m))
        got = sum(cost[r, c] for r, c in k.assign(cost))
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert got == pytest.approx(best)
    assert k.assign(np.empty((0, 3))) == []


def test_labelling_against_flood_fill():
    rng = np.random.default_rng(2)
    for connectivity in (1, 2):
        mask = rng.random((17, 23)) < 0.45
        got, seen, count = k.label_components(mask, connectivity), np.zeros(mask.shape, int), 0
        for start in np.argwhere(mask):
            if seen[tuple(start)]:
                continue
            count += 1
            stack = [tuple(start)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < 17 and 0 <= x < 23 and mask[y, x] and not seen[y, x]:
                    seen[y, x] = count
                    stack += [(y + a, x + b) for a, b in k.structure(2, connectivity)]
        assert (got == seen).all()


def test_segmentation_kernels():
    labels = k.segment_gray(disc_image())
    assert labels.max() == 2 and abs(np.bincount(labels.ravel())[1] - 197) < 40
    assert k.segment_gray(np.full((20, 20), 7, np.uint8)).max() == 0
    assert k.segment_gray(disc_image(), adaptive=True).max() >= 2
    volume = np.zeros((24, 32, 32))
    volume[4:10, 4:12, 4:12] = volume[14:20, 18:28, 18:28] = 255
    assert k.segment_volume(volume).max() == 2 and k.segment_volume(np.ones((4, 4, 4))).max() == 0
    with pytest.raises(ValueError):
        k.segment_gray(np.zeros((3, 3, 3), np.uint8))
    assert k.top_hat(disc_image(), 5).shape == (100, 100)


def test_image_metrics(spark):
    px = long(spark, {0: np.full((20, 20), 120.0), 1: np.where(np.arange(20) == 19, 255.0, 100.0)[None].repeat(20, 0)})
    bright = {r["image_id"]: r for r in pixels.brightness(px, ["image_id"]).collect()}
    assert (bright[0]["brightness_mean"], bright[0]["brightness_std"]) == (120, 0)
    art = {r["image_id"]: r for r in pixels.artifact_metrics(px, ["image_id"]).collect()}
    assert art[0]["low_clip_fraction"] == 1 and art[1]["high_clip_fraction"] > 0
    focus = {r["image_id"]: r["focus_score"] for r in pixels.focus_score(px, ["image_id"]).collect()}
    assert focus[0] == 0 and focus[1] == pytest.approx(k.focus(np.where(np.arange(20) == 19, 255, 100)[None].repeat(20, 0).astype(np.uint8)))
    assert {r["image_id"]: r["hot"] for r in pixels.detect_hot_pixels(px, ["image_id"]).groupBy("image_id").agg(F.max("hot").alias("hot")).collect()} == {0: False, 1: False}
    assert pixels.texture_features(px, ["image_id"]).count() == 2
    vol = spark.createDataFrame([(0, z, y, 0, float(z * 3 + y)) for z in range(2) for y in range(2)], "image_id int, z int, y int, x int, v double")
    assert {r["y"]: r["v"] for r in pixels.project_z(vol, ["image_id"], "mean", integer=True).collect()} == {0: 1, 1: 2}
    with pytest.raises(IndexError):
        pixels.select_plane(px, "c", 1)
    assert [r["chunk"] for r in pixels.chunk_ids(vol, "z", 1).select("chunk").distinct().orderBy("chunk").collect()] == [0, 1]


def test_masks_objects_and_compartments(spark):
    df = spark.createDataFrame([(0, True, True), (0, True, False), (0, False, False)], "i int, a boolean, b boolean")
    assert pixels.colocated_fraction(df, F.col("a"), F.col("b"), ["i"]).first()["colocated_fraction"] == 0.5
    m = pixels.pixel_metrics(df, F.col("a"), F.col("b"), ["i"]).first()
    assert (m["iou"], m["precision"], m["recall"]) == (0.5, 0.5, 1)
    cells, nuclei = np.zeros((20, 20), int), np.zeros((20, 20), int)
    cells[2:18, 2:18], nuclei[8:11, 8:11] = 1, 1
    c, n = (long(spark, {0: a}, "label", "int") for a in (cells, nuclei))
    assigned = pixels.assign_nuclei_to_cells(c, n, ["image_id"])
    assert [(r["nucleus"], r["cell"]) for r in assigned.collect()] == [(1, 1)]
    px = c.withColumnRenamed("label", "cell").join(n.withColumnRenamed("label", "nucleus"), ["image_id", "y", "x"]).withColumn("v", F.lit(5.0))
    out = pixels.compartment_features(px, assigned, ["image_id"]).first()
    assert (out["nucleus_area"], out["cell_area"], out["nucleus_count"]) == (9, 256, 1)
    far = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 20.0, 20.0), (0, 3, 80.0, 80.0), (1, 1, 0.0, 0.0)], "image_id int, label int, centroid_x double, centroid_y double")
    spatial = pixels.add_spatial_features(far, ["image_id"], height=100, width=100)
    s = {r["image_id"]: r for r in pixels.summarize_spatial_features(spatial, ["image_id"]).collect()}
    assert s[0]["object_count"] == 3 and s[0]["density_per_100k_px"] == 30 and s[1]["mean_nn"] is None


def test_volumes(spark):
    v = np.zeros((6, 8, 10), int)
    v[1:3, 1:4, 1:4], v[3:5, 5:7, 6:9] = 1, 2
    rows = [(0, *map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)]
    out = {r["label"]: r for r in pixels.volume_features(spark.createDataFrame(rows, "i int, z int, y int, x int, label int"), ["i"], voxel=(2, 1, 0.5)).collect()}
    assert out[1]["volume"] == 18 and out[1]["surface_area"] == 2 * (9 * 0.5 + 6 * 1 + 6 * 2)
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 3.0), (0, 3, 0.0, 4.0, 0.0)], "i int, label int, z double, y double, x double")
    near = pixels.nearest_neighbors(pts, ["i"], axes=("z", "y", "x")).orderBy("label").collect()
    assert [r["nearest_neighbor_distance"] for r in near] == [3, 3, 4]


def series(spark, *frames):
    rows = [(0, t, int(y), int(x), int(v)) for t, a in enumerate(frames) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "series int, frame int, y int, x int, label int")


def test_events_fire_in_all_kinds(spark):
    a, b, c, d = (np.zeros((12, 12), int) for _ in range(4))
    a[2:10, 2:10] = 1
    b[2:10, 2:6], b[2:10, 6:10] = 2, 3
    c[2:10, 2:10] = 4
    d[0, 0] = 9
    out = tracks.detect_events(series(spark, a, b, c, d), keys=["series"]).collect()
    assert [(r["event"], r["child_labels"]) for r in out if r["event"] == "split"] == [("split", [2, 3])]
    assert [(r["event"], r["parent_labels"], r["child_label"]) for r in out if r["event"] == "merge"] == [("merge", [2, 3], 4)]
    assert [(r["frame"], r["child_label"]) for r in out if r["event"] == "appearance"] == [(3, 9)]
    assert [(r["frame"], r["parent_label"]) for r in out if r["event"] == "disappearance"] == [(3, 4)]
    assert tracks.classify_divisions(tracks.detect_events(series(spark, a, b), keys=["series"])).first()["is_division"]


POINTS = [(0, 0, 1, 10.0, 10.0), (0, 0, 2, 30.0, 10.0), (0, 1, 2, 12.0, 10.0), (0, 1, 1, 28.0, 10.0), (0, 2, 1, 14.0, 10.0), (0, 2, 2, 90.0, 90.0), (1, 0, 1, 0.0, 0.0), (1, 2, 1, 1.0, 0.0)]
POINT_SCHEMA = "series int, frame int, label int, x double, y double"


def test_linking_survives_swapped_labels_jumps_and_gaps(spark):
    out = tracking.link_frames(spark.createDataFrame(POINTS, POINT_SCHEMA), "series", config=tracking.TrackingConfig(max_distance=6, max_gap=1)).collect()
    of = {(r["series"], r["frame"], r["label"]): r for r in out}
    assert of[0, 0, 1]["track_id"] == of[0, 1, 2]["track_id"] == of[0, 2, 1]["track_id"]
    assert of[0, 0, 2]["track_id"] == of[0, 1, 1]["track_id"] != of[0, 2, 2]["track_id"]
    assert of[1, 0, 1]["track_id"] == of[1, 2, 1]["track_id"] and of[1, 2, 1]["gap"] == 1
    with pytest.raises(ValueError):
        tracking.link_frames(spark.createDataFrame(POINTS, POINT_SCHEMA), "series", config=tracking.TrackingConfig(max_distance=0))


def test_series_are_dealt_over_tasks(spark):
    """centroids are few bytes, and series of all of them met in one task."""
    points = spark.range(4000).selectExpr("id DIV 10 AS series", "CAST(id % 10 AS INT) AS frame", "1 AS label", "CAST(id % 10 AS DOUBLE) AS x", "0D AS y")
    out = tracking.link_frames(tracking.centroids(points, ["series"]), "series", config=tracking.TrackingConfig(max_distance=2)).select("*", F.spark_partition_id().alias("task")).toPandas()
    assert len(out) == 4000 and (out.groupby("series")["track_id"].nunique() == 1).all()
    assert out.groupby("task")["series"].nunique().max() < 100


def test_stream_equals_batch(spark, tmp_path):
    config = tracking.TrackingConfig(max_distance=6, max_gap=1)
    parts = [[p for p in POINTS if p[1] == 0], [p for p in POINTS if p[1] == 1][:1], [p for p in POINTS if p[1] == 1][1:], [p for p in POINTS if p[1] == 2]]
    # A frame that comes in two micro-batches; a last frame far off lets the frames before it go.
    parts.append([(s, 9, 1, *[900.0] * (len(POINTS[0]) - 3)) for s in sorted({p[0] for p in POINTS})])
    for rows in parts:
        spark.createDataFrame(rows, POINT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = link_stream(stream, "series", config=config).writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    key = ["series", "frame", "label"]
    got = spark.table("linked").toPandas().sort_values(key).reset_index(drop=True)
    want = tracking.link_frames(spark.createDataFrame(POINTS, POINT_SCHEMA), "series", config=config).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_instance_matching(spark):
    truth = spark.createDataFrame([(0, 1.0, 1.0), (0, 10.0, 10.0), (1, 5.0, 5.0)], "i int, x double, y double")
    pred = spark.createDataFrame([(0, 2.0, 1.0), (0, 9.0, 10.0), (0, 40.0, 40.0)], "i int, x double, y double")
    out = {r["i"]: r for r in tracking.match_instances(pred, truth, "i", max_distance=5).collect()}
    assert (out[0]["tp"], out[0]["fp"], out[0]["fn"]) == (2, 1, 0) and (out[1]["tp"], out[1]["fn"]) == (0, 1)


def test_track_tables(spark):
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 2, 2), (3, 2, 3)], "track_id int, frame int, label int")
    far = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 1), (0, 1, 1, 1), (0, 1, 2, 2)], "i int, frame int, x int, label int").withColumn("y", F.lit(0))
    both = tracks.overlap_map(far.drop("i"), min_overlap=0.0).collect()
    assert len(both) == 1 and both[0]["backward"] == 0.5 and not tracks.overlap_map(far.where("label = 1").drop("i"), min_overlap=1.1).collect()
    twice = spark.createDataFrame([(2, "split", 2, 1, [3]), (2, "split", 2, 5, [3])], "frame int, event string, degree int, parent_label int, child_labels array<int>")
    more = t.unionByName(spark.createDataFrame([(9, 1, 5)], "track_id int, frame int, label int"))
    for n in (1, 4):  # the larger parent label, whatever the partitions
        assert tracks.lineage_table(more, twice.repartition(n)).where("label = 3").first()["parent_track_id"] == 9
    e = spark.createDataFrame([(2, "split", 2, 1, [2, 3])], "frame int, event string, degree int, parent_label int, child_labels array<int>")
    nodes = tracks.lineage_table(t, e)
    assert {r["track_id"] for r in nodes.where("relationship = 'division_child'").collect()} == {2, 3} and nodes.where("parent_track_id = 1").count() == 2
    assert tracks.summarize_lineages(nodes).where("is_child").count() == 2
    q = spark.createDataFrame([(1, 0, 1), (1, 2, 1), (1, 3, 1), (2, 0, 2), (2, 1, 2)], "track_id int, frame int, label int")
    out = tracks.lineage_quality_summary(q).first()
    assert (out["track_count"], out["fragmented_tracks"]) == (2, 1) and out["completeness"] == pytest.approx(5 / 6)
    g = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 0), (2, 2)], "track_id int, frame int")
    assert tracks.track_gap_rate(g).first()["gap_count"] == 1
    ev = spark.createDataFrame([("split", 2), ("split", 1), ("merge", 2), ("appearance", 0), ("disappearance", 0)], "event string, degree int")
    s = tracks.lineage_event_summary(ev, n_frames=6).first()
    assert (s["event_count"], s["split_count"], s["events_per_transition"]) == (5, 2, 1)
    assert tracks.division_consistency(ev).first()["consistency_rate"] == 0.5
    xy = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 3, 3.0, 4.0)], "track_id int, frame int, x double, y double")
    out = tracks.summarize_tracks(xy).first()
    assert (out["path_length"], out["net_displacement"], out["max_gap"], out["straightness"]) == (5, 5, 1, 1)


def test_ensemble_and_sensitivity(spark):
    rows = [(0, m, i, y, 0, 1) for i, m in enumerate(("a", "b")) for y in range(2 + 2 * i)]
    out = pixels.ensemble_agreement(spark.createDataFrame(rows, "im int, member string, idx int, y int, x int, label int"), ["im"]).first()
    assert out["agreement_fraction"] == 0.5 and out["chosen"] == "a" and out["warning"]
    runs = spark.createDataFrame([(0, 80, 1, 0.2), (0, 100, 1, 0.25), (0, 100, 1, 0.25)], "i int, threshold int, object_count int, foreground_fraction double")
    assert [r["count_cv"] for r in pixels.threshold_sensitivity(runs, ["i"]).collect()] == [0, 0]


def test_image_sources(spark, tmp_path):
    disc, deep = disc_image(), (np.arange(400).reshape(20, 20) * 100).astype(np.uint16)
    (tmp_path / "a.PNG").write_bytes(images.encode_png(disc))
    (tmp_path / "deep.png").write_bytes(images.encode_png(deep))
    xml = '<OME xmlns="x"><Image><Pixels SizeX="20" SizeY="20" SizeZ="3" SizeC="1" SizeT="1" PhysicalSizeX="0.5" PhysicalSizeXUnit="um"><Channel Name="DAPI"/></Pixels></Image></OME>'
    (tmp_path / "s.tif").write_bytes(images.encode_tiff(np.stack([deep, deep + 1, deep]), xml))
    (tmp_path / "bad.bmp").write_bytes(b"BM")
    (tmp_path / "note.txt").write_text("x")
    files = images.find_images(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.load_images(files).collect()}
    assert set(got) == {"a.PNG", "deep.png", "s.tif", "bad.bmp"} and got["bad.bmp"]["error"]
    assert np.frombuffer(got["deep.png"]["data"], np.uint16).max() == 39900
    assert (np.frombuffer(got["s.tif"]["data"], np.uint16).reshape(20, 20) == deep + 1).all()
    tif = files.where("path LIKE '%.tif'")
    info = images.read_ome_info(tif).first()
    assert (info["size_z"], info["physical_x"], info["channel_names"], info["n_pages"]) == (3, 0.5, ["DAPI"], 3)
    assert (info["axes"], info["shape"]) == ("ZYX", [3, 20, 20])
    assert images.load_stacks(tif, "ZYX").count() == 3
    odd = images.load_stacks(files, "ZYX").where("error IS NOT NULL").select("path").collect()
    assert len(odd) == 3  # files that are no TIFF tell it and don't end the job
    pages = images.load_series(tif).orderBy("z").collect()
    assert [(r["axes"], r["z"], r["shape"]) for r in pages] == [("ZYX", z, [3, 20, 20]) for z in range(3)]
    assert "series 4" in images.load_series(tif, 4).first()["error"]
    bare = (tmp_path / "bare")
    bare.mkdir()
    (bare / "bare.tif").write_bytes(images.encode_tiff(deep[None]))
    (bare / "short.tif").write_bytes(images.encode_tiff(np.stack([deep]), xml))
    others = {r["path"].rsplit("/", 1)[1]: r for r in images.read_ome_info(images.find_images(spark, str(bare))).collect()}
    assert others["bare.tif"]["error"] and others["short.tif"]["error"] is None  # a file without metadata doesn't end the job
    assert "pages" in images.load_series(images.find_images(spark, str(bare)).where("path LIKE '%short%'")).first()["error"]
    cz = '<OME><Image><Pixels DimensionOrder="XYCZT" SizeX="20" SizeY="20" SizeZ="2" SizeC="2" SizeT="1"/></Image><Image><Pixels SizeX="20" SizeY="20"/></Image></OME>'
    found = images.series_of(*tiff.pages(images.reading(images.encode_tiff(np.stack([deep + k for k in range(5)]), cz))))
    assert found == [("ZCYX", (2, 2, 20, 20), [0, 1, 2, 3]), ("YX", (20, 20), [4])]
    swapped = images.series_of(*tiff.pages(images.reading(images.encode_tiff(np.stack([deep + k for k in range(4)]), cz.split("<Image><Pixels SizeX")[0].replace("XYCZT", "XYZCT") + "</OME>"))))
    assert swapped == [("ZCYX", (2, 2, 20, 20), [0, 2, 1, 3])]
    stack = images.ImageStack("a", "TCYX", (2, 2, 5, 5), "uint8")
    assert stack.has_channel and stack.has_time and not stack.has_z
    assert images.make_cells_image(5, 64).shape == (64, 64) and (images.make_cells_image(5, 64) == images.make_cells_image(5, 64)).all()
    assert math.isclose(np.frombuffer(got["a.PNG"]["data"], np.uint8).mean(), disc.mean())
