"""Configuration: YAML file first, then overrides; engines as a small DataFrame."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.scalars import INF
from framelake.schemas import ENGINES
from framelake.sources.manifest import read_manifest

#: Defaults of a model entry.
MODEL = {"num_detectors": 4, "type": "detection", "batch_size": 1, "input_width": 640, "input_height": 640, "conf_threshold": 0.25, "nms_threshold": 0.45, "gpu_id": 0, "roi_cropping": False}


def flag(x: Any) -> bool:
    return x if isinstance(x, bool) else str(x).strip().lower() in ("true", "1", "yes")


@dataclass
class Config:
    engines: list[dict[str, Any]] = field(default_factory=list)
    list_file: str | None = None
    list_file_jsonl: str | None = None
    paths: list[str] = field(default_factory=list)
    padding_s: float = 0.0
    num_readers: int = 1
    num_preprocessors: int = 1
    output_dir: str = "output"
    debug: bool = False
    max_frames_per_video: int = 0

    def has_clips(self) -> bool:
        return bool(self.list_file or self.list_file_jsonl or self.paths)

    def problems(self, given_clips: bool = False) -> list[str]:
        found = []
        if not self.engines:
            found.append("no engine")
        if not (given_clips or self.has_clips()):
            found.append("no clip")
        for name in ("num_readers", "num_preprocessors"):
            if getattr(self, name) <= 0:
                found.append(f"{name} must be positive")
        return found

    def use_engine_batches(self, actual: dict[str, int]) -> list[str]:
        """Batch sizes that engines were built for win over configured ones; a warning for each that differs. Names as in ``engines``."""
        warnings = []
        for e in self.engines:
            own = actual.get(e["name"])
            if own and own > 0 and own != e["batch_size"]:
                warnings.append(f"{e['name']}: batch size {e['batch_size']} is not the engine's, {own} is used")
                e["batch_size"] = own
        return warnings

    def engine_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e["name"], e["path"], int(e["type"].lower() == "pose"), e["num_detectors"], e["batch_size"], e["input_width"], e["input_height"], float(e["conf_threshold"]), float(e["nms_threshold"]), e["gpu_id"], flag(e["roi_cropping"])) for e in self.engines]
        return spark.createDataFrame(rows, ENGINES)

    def clip_frame(self, spark: SparkSession) -> DataFrame | None:
        """All sources in order: list file, JSON list file, paths; numbered through."""
        found, base = None, 0
        for path, fmt in ((self.list_file, "plain"), (self.list_file_jsonl, "jsonl")):
            if path:
                part = read_manifest(spark, path, fmt, self.padding_s).withColumn("video_id", F.col("video_id") + base)
                base += part.count()
                found = part if found is None else found.unionByName(part)
        if self.paths:
            rows = [(base + i, p, 0.0, 0.0, -INF, INF, None) for i, p in enumerate(self.paths)]
            part = spark.createDataFrame(rows, "video_id int, path string, moment_time double, duration double, start_ts double, end_ts double, roi struct<x1:float,y1:float,x2:float,y2:float>")
            found = part if found is None else found.unionByName(part)
        return found


def load_config(path: str | None = None, **overrides: Any) -> Config:
    """A file's settings with overrides on top. Entries without a path are skipped; a single ``model:`` works too."""
    import yaml

    raw: dict[str, Any] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    entries = raw.get("models") or ([raw["model"]] if isinstance(raw.get("model"), dict) else [])
    engines = []
    for i, e in enumerate(x for x in entries if isinstance(x, dict) and x.get("path")):
        engines.append({"name": f"engine{i}", **MODEL, **{k: v for k, v in e.items() if v is not None}})
    videos, threads, debug = raw.get("videos") or {}, raw.get("threads") or {}, raw.get("debug") or {}
    c = Config(
        engines, videos.get("list_file"), videos.get("list_file_jsonl"), list(videos.get("paths") or []), max(0.0, float(videos.get("time_padding_seconds") or 0)),
        int(threads.get("num_readers", 1)), int(threads.get("num_preprocessors", 1)), (raw.get("output") or {}).get("dir", "output"), flag(debug.get("enabled", False)), max(0, int(debug.get("max_frames_per_video") or 0)),
    )
    for k, v in overrides.items():
        if v is not None:
            if not hasattr(c, k):
                raise TypeError(f"no such setting: {k}")
            setattr(c, k, v)
    return c


def from_args(argv: list[str]) -> Config:
    """Command line: the file first, flags override it."""
    p = argparse.ArgumentParser(prog="framelake")
    p.add_argument("--config")
    p.add_argument("--num-readers", type=int)
    p.add_argument("--num-detectors", type=int)
    p.add_argument("--engine", action="append")
    p.add_argument("--output-dir")
    p.add_argument("--videos", nargs="*")
    a = p.parse_args(argv)
    engines = [{"name": f"engine{i}", **MODEL, "path": e} for i, e in enumerate(a.engine)] if a.engine else None
    c = load_config(a.config, num_readers=a.num_readers, output_dir=a.output_dir, paths=a.videos or None, engines=engines)
    if a.num_detectors is not None:
        c.engines = [{**e, "num_detectors": a.num_detectors} for e in c.engines]
    return c
