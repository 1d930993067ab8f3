"""A project folder: settings, stages, tables, logs."""

from __future__ import annotations

import json
import os
import time
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.markers import MarkerParams


@dataclass
class Settings:
    """What the settings file may say; cameras: name, images (a glob), model, params, refine; poses: image, quaternion, translation, fixed."""

    images_dir: str = ""
    detector: str | None = None
    pairing: str | None = None
    matcher: str | None = None
    pipeline: str | None = None
    cameras: list = field(default_factory=list)
    poses: list = field(default_factory=list)


class Project:
    def __init__(self, root: str):
        """Opens a project; the settings are the only .toml file in its folder, and defaults hold without one."""
        self.root = Path(root)
        found = sorted(self.root.glob("*.toml"))
        if len(found) > 1:
            raise ValueError(f"more than one settings file in {root}")
        known = {f.name for f in fields(Settings)}
        data = tomllib.loads(found[0].read_text()) if found else {}
        self.settings = Settings(**{k: v for k, v in data.items() if k in known})
        for entries, needed in ((self.settings.cameras, ("name", "images")), (self.settings.poses, ("image", "quaternion", "translation"))):
            for e in entries:
                if missing := [n for n in needed if n not in e]:
                    raise ValueError(f"settings: {missing} missing in {e}")
        self.images_dir = self.root / self.settings.images_dir if self.settings.images_dir else self.root / "images"

    @staticmethod
    def create(root: str, images_dir: str) -> "Project":
        """A new folder with a settings file and the usual subfolders."""
        for sub in ("cache", "export", "logs"):
            os.makedirs(f"{root}/{sub}", exist_ok=True)
        if not list(Path(root).glob("*.toml")):
            Path(root, "project.toml").write_text(f"images_dir = {json.dumps(os.path.abspath(images_dir))}\n")
        return Project(root)

    def stage_dir(self, stage: str) -> Path:
        return self.root / "cache" / stage

    @property
    def sparse_dir(self) -> Path:
        return self.stage_dir("map") / "sparse" / "0"

    @property
    def marker_params_path(self) -> Path:
        return self.stage_dir("feature") / "marker_params.toml"

    def table_path(self, name: str) -> str:
        return str(self.root / "cache" / "tables" / name)

    def has(self, name: str) -> bool:
        return os.path.isdir(self.table_path(name))

    def read(self, spark: SparkSession, name: str, stage: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"no {name} yet: run '{stage}' first")
        return spark.read.parquet(self.table_path(name))

    def write(self, df: DataFrame, name: str) -> None:
        """Replaces a table; it is written beside the old one first, as df may read that one."""
        new, old = self.table_path(name) + ".new", self.table_path(name)
        df.write.mode("overwrite").parquet(new)
        if os.path.isdir(old):
            gone = f"{old}.old-{time.time_ns()}"
            os.rename(old, gone)
        os.rename(new, old)

    def record(self, stage: str, payload: dict) -> str:
        """One JSON file per run of a stage, named by its time."""
        os.makedirs(self.root / "logs", exist_ok=True)
        path = self.root / "logs" / f"{stage}_{time.time_ns() // 1_000_000}.json"
        path.write_text(json.dumps(payload, indent=1))
        return str(path)

    def save_marker_params(self, params: MarkerParams) -> None:
        os.makedirs(self.marker_params_path.parent, exist_ok=True)
        self.marker_params_path.write_text("".join(f"{k} = {v}\n" for k, v in asdict(params).items()))

    def marker_params(self) -> MarkerParams | None:
        return MarkerParams(**tomllib.loads(self.marker_params_path.read_text())) if self.marker_params_path.exists() else None
