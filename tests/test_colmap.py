import pytest

from tessella.sources import colmap


def test_model_round_trip(spark, tmp_path):
    cams = spark.createDataFrame([(1, "SIMPLE_PINHOLE", 640, 480, [500.0, 320.0, 240.0]), (2, "OPENCV", 64, 48, [float(i) for i in range(8)])], "camera_id long, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "a.png", [(1.5, 2.25, 7), (3.0, 4.0, None)]), (2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2, "b.png", [])],
                                   "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string, points array<struct<x:double,y:double,point_id:long>>")
    points = spark.createDataFrame([(7, 0.5, 1.0, 2.0, 180, 180, 180, 0.25, [(1, 0), (2, 3)])], "point_id long, x double, y double, z double, r short, g short, b short, error double, track array<struct<image_id:long,kp:int>>")
    colmap.write_model(cams, images, points, str(tmp_path))
    back = colmap.read_cameras(spark, f"{tmp_path}/cameras.txt"), colmap.read_images(spark, f"{tmp_path}/images.txt"), colmap.read_points(spark, f"{tmp_path}/points3D.txt")
    for want, got in zip((cams, images, points), back):
        assert sorted(map(str, want.collect())) == sorted(map(str, got.select(want.columns).collect()))
    (tmp_path / "bad.txt").write_text("# c\n1 PINHOLE\n")
    with pytest.raises(Exception, match="too few tokens"):
        colmap.read_cameras(spark, f"{tmp_path}/bad.txt").collect()
