import json

import pytest

from tessella.functions.markers import MarkerParams
from tessella.sources import dataset, nerf
from tessella.sources.project import Project


def found(spark, *names):
    df, layout = dataset.discover(spark.createDataFrame([(n,) for n in names], "name string"))
    return {r.name: (r.capture_id, r.camera_id, r.image_index) for r in df.collect()}, layout


def test_layouts(spark):
    got, layout = found(spark, *(f"capture_{c:03d}/cam{k:03d}/image.jpg" for c in range(3) for k in range(2)), "capture_000/note.txt")
    assert layout == "captures_and_cameras" and len(got) == 6 and got["capture_001/cam001/image.jpg"] == (1, 1, 0)
    got, layout = found(spark, "cam000/a.png", "cam000/b.png", "cam007\\a.png")
    assert layout == "cameras_only" and got == {"cam000/a.png": (0, 0, 0), "cam000/b.png": (0, 0, 1), "cam007/a.png": (0, 7, 0)}
    got, layout = found(spark, "cam001_x.jpeg", "cam001_y.jpeg", "other.PNG", "stray.txt")
    assert layout == "flat" and got == {"cam001_x.jpeg": (0, 1, 0), "cam001_y.jpeg": (0, 1, 1), "other.PNG": (0, 0, 0)}
    assert found(spark, "left/a.png", "right/a.png")[0] == {"left/a.png": (0, 0, 0), "right/a.png": (0, 1, 0)}
    assert {v[1] for v in found(spark, "a1/a.png", "b1/a.png")[0].values()} == {0, 1}
    with pytest.raises(ValueError):
        found(spark, "x.txt")


CAMERAS = "camera_id long, model string, width int, height int, params array<double>"
IMAGES = "image_id long, camera_id long, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


@pytest.mark.parametrize("n", [1, 2])
def test_transforms_round_trip(spark, tmp_path, n):
    cams = spark.createDataFrame([(1, "OPENCV", 1280, 720, [1200.0, 1200.0, 640.0, 360.0, -0.02, 0.01, 0.0, 0.0]), (2, "SIMPLE_RADIAL", 640, 480, [500.0, 320.0, 240.0, 0.1])][:n], CAMERAS)
    images = spark.createDataFrame([(1, 1, "a.png", 0.8, 0.6, 0.0, 0.0, 1.0, -2.0, 0.5), (2, n, "b.png", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], IMAGES)
    nerf.write_transforms(cams, images, f"{tmp_path}/t.json")
    doc = json.load(open(f"{tmp_path}/t.json"))
    assert ("fl_x" in doc) == (n == 1) and ("fl_x" in doc["frames"][0]) == (n == 2) and "k1" not in doc["frames"][0]
    c, i = nerf.read_transforms(spark, f"{tmp_path}/t.json")
    got, want = i.orderBy("image_id").collect(), images.orderBy("image_id").collect()
    for a, b in zip(got, want):
        assert a.name == b.name and a.camera_id == b.camera_id and all(abs(a[k] - b[k]) < 1e-9 for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))
    first = c.orderBy("camera_id").first()
    assert first.params == ([1200.0, 1200.0, 640.0, 360.0, -0.02, 0.01, 0.0, 0.0] if n == 1 else [1200.0, 1200.0, 640.0, 360.0, 0.0, 0.0, 0.0, 0.0]) and c.count() == n


def test_transforms_defaults(spark, tmp_path):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 1.0, "w": 100, "h": 50, "frames": [{"file_path": "a", "transform_matrix": eye}, {"file_path": "b", "transform_matrix": eye, "fl_x": 7.0}]}))
    c, _ = nerf.read_transforms(spark, f"{tmp_path}/t.json")
    a, b = c.orderBy("camera_id").collect()
    assert abs(a.params[0] - 91.524) < 1e-3 and a.params[2:4] == [50.0, 25.0] and b.params[:2] == [7.0, 7.0]
    (tmp_path / "bad.json").write_text(json.dumps({"frames": [{"file_path": "a", "transform_matrix": eye}]}))
    with pytest.raises(Exception, match="focal length"):
        nerf.read_transforms(spark, f"{tmp_path}/bad.json")[1].collect()


def test_project(spark, tmp_path):
    p = Project.create(str(tmp_path / "p"), "/some/where")
    assert str(p.images_dir) == "/some/where" and p.marker_params() is None and p.settings.cameras == []
    p.save_marker_params(MarkerParams(radius=9, gamma=0.5))
    assert p.marker_params() == MarkerParams(radius=9, gamma=0.5)
    with pytest.raises(FileNotFoundError, match="run 'feature' first"):
        p.read(spark, "images", "feature")
    for n in (3, 5):
        p.write(spark.range(n).toDF("x") if n == 3 else p.read(spark, "t", "x").union(spark.range(2).toDF("x")), "t")
    assert p.read(spark, "t", "x").count() == 5
    assert json.load(open(p.record("map", {"a": 1}))) == {"a": 1}
    assert str(Project(str(tmp_path)).images_dir).endswith("images")
