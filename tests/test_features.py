import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vocabulary as V
from tessella.operators import features, retrieval
from tessella.sources import dataset, synthetic


def test_markers_of_captures(spark, tmp_path):
    synthetic.marker_captures(str(tmp_path), 2, 2)
    (tmp_path / "note.txt").write_text("x")
    where, layout = dataset.discover(dataset.list_files(spark, str(tmp_path)))
    assert layout == "captures_and_cameras"
    images = dataset.read_images(spark, str(tmp_path)).join(where, "name").withColumn("image_id", F.col("capture_id") * 10 + F.col("camera_id"))
    rows = features.detect(images, "aruco").collect()
    assert len(rows) == 4 * 2 * 4
    assert {(r.desc_m.capture_id, r.desc_m.marker_id) for r in rows} == {(0, 0), (0, 1), (1, 2), (1, 3)}
    at = {(r.image_id, r.desc_m.marker_id, r.desc_m.corner_index): (r.x, r.y) for r in rows}
    assert np.allclose(np.array(at[1, 0, 0]) - at[0, 0, 0], 3, atol=1)
    assert {r.capture_id for r in features.stamped(features.detect(images, "aruco"), F.lit(9)).select("desc_m.capture_id").collect()} == {9}
    k = features.detect(images, "sift", 50)
    n = {r["image_id"]: r["count"] for r in k.groupBy("image_id").count().collect()}
    assert len(n) == 4 and max(n.values()) <= 50 and all(abs(np.linalg.norm(r.desc_f) - 1) < 1e-6 for r in k.limit(5).collect())
    assert all(len(r.desc_b) == 4 for r in features.detect(images, "ORB").limit(5).collect())


def test_unknown_detectors(spark):
    for name, error in (("akaze", NotImplementedError), ("SuperPoint", NotImplementedError), ("x", ValueError)):
        with pytest.raises(error):
            features.detector_of(name)
    with pytest.raises(ValueError, match="model"):
        features.detect(spark.range(1), "disk")


def test_vocabulary():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(c, 0.1, (200, 8)) for c in range(4)])
    nodes = V.train(x, branching=4, depth=2)
    w = V.words(nodes, x)
    assert len({n["word"] for n in nodes if "word" in n}) > 4 and np.array_equal(w, V.words(V.train(x, branching=4, depth=2), x))
    assert not {*w[:200]} & {*w[200:400]}
    assert V.words(V.train(x[:3]), x).max() == 0


def test_vocabulary_pairs_stay_within_groups(spark):
    g = np.random.default_rng(1)
    centres = g.normal(0, 1, (2, 30, 16)) + np.array([0.0, 5.0])[:, None, None]
    rows = [(i, k, (centres[i // 4][g.integers(10 + 20 * (k % 2))] + g.normal(0, 0.05, 16)).tolist()) for i in range(8) for k in range(120)]
    df = spark.createDataFrame(rows, "image long, kp int, desc array<double>")
    pairs = {(r.i, r.j) for r in retrieval.vocabulary_pairs(df, neighbours=3, branching=8, depth=2).collect()}
    inside = sum((i < 4) == (j < 4) for i, j in pairs)
    assert pairs and inside > 0.5 * len(pairs) and all(i < j for i, j in pairs)
    assert retrieval.vocabulary_pairs(df.withColumn("desc", F.lit(None).cast("array<double>"))) is None
    bits = spark.range(1).select(retrieval.unpacked(F.array(F.lit(5).cast("long"), F.lit(-1).cast("long"))).alias("b")).first().b
    assert bits[:4] == [1, 0, 1, 0] and len(bits) == 128 and sum(bits) == 66


def test_tuning_finds_weak_markers(spark, monkeypatch):
    monkeypatch.setattr(features, "RADII", (7, 11))
    monkeypatch.setattr(features, "OFFSETS", (4.0, 12.0))
    img = np.rint(synthetic.scene([0, 1], size=420, contrast=0.06) * 255).astype(np.uint8)
    df = spark.createDataFrame([(0, 420, 420, 1, bytearray(img.tobytes()))], "image_id long, width int, height int, channels int, data binary")
    assert features.detect(df, "aruco").count() == 0
    params, n_images, n_markers = features.tuned_markers(df)
    assert (n_images, n_markers) == (1, 2) and features.detect(df, "aruco", params=params).count() == 8
