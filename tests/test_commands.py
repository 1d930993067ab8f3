import json
import os

import numpy as np
import pytest

from tessella import commands
from tessella.functions import imaging
from tessella.sources import synthetic
from tessella.sources.project import Project


def views(root):
    """Three views of a textured plane and one nearer: windows of one picture at several depths."""
    os.makedirs(root)
    g = np.random.default_rng(3)
    layers = [imaging.blur(g.random((200, 420)), s) for s in (1.5, 2.0)]
    layers = [(v - v.min()) / (v.max() - v.min()) for v in layers]
    for i in range(3):
        img = layers[0][20:180, 40 + 6 * i : 240 + 6 * i].copy()
        img[50:130, 60:150] = layers[1][50:130, 60 + 14 * i : 150 + 14 * i]
        synthetic.write_png(f"{root}/{i}.png", img)


def test_stages(spark, tmp_path):
    views(str(tmp_path / "in"))
    commands.main(["project", "new", str(tmp_path / "p"), "--images", str(tmp_path / "in")])
    p = Project(str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError, match="feature"):
        commands.match(spark, p)
    r = commands.feature(spark, p, max_features=300)
    assert r["images"] == 3 and r["cameras"] == 1 and r["layout"] == "flat"
    assert commands.feature(spark, p, max_features=200)["images"] == 3 and p.read(spark, "cameras", "feature").count() == 1
    with pytest.raises(NotImplementedError):
        commands.match(spark, p, matcher="lightglue")
    r = commands.match(spark, p, "exhaustive")
    assert r["candidates"] == 3 and r["verified"] >= 1
    r = commands.map_(spark, p, "incremental")
    assert r["images"] >= 2 and r["points"] > 10 and r["mean_error"] < 4
    commands.export(spark, p)
    assert open(p.root / "export" / "cameras.txt").readline().startswith("# Camera list")
    commands.export(spark, p, "nerf-transforms")
    assert len(json.load(open(p.root / "export" / "transforms.json"))["frames"]) == r["images"]
    assert commands.eval_(spark, str(p.sparse_dir))["ours"]["points"] == r["points"]
    assert len(os.listdir(p.root / "logs")) >= 5


def test_markers_of_captures_are_merged(spark, tmp_path):
    synthetic.marker_captures(str(tmp_path / "in"), 2, 2)
    p = Project.create(str(tmp_path / "p"), str(tmp_path / "in"))
    r = commands.feature(spark, p, "aruco", merge_multicaps=True)
    assert r["images"] == 2 and r["keypoints"] == 2 * 2 * 2 * 4 and r["cameras"] == 2
    k = p.read(spark, "keypoints", "feature")
    assert k.select("image_id", "kp").distinct().count() == 32
    r = commands.match(spark, p, "exhaustive")
    assert r["verified"] == 1 and r["matches"] == 16
    assert spark.read.csv(str(p.stage_dir("feature") / "corners.csv"), header=True).count() == 32
