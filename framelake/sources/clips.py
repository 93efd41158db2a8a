"""Frames of clips: ``spark.read.format("frames")``, with a pluggable decoder and filters that become seeks.

A decoder is a function (path, first) that gives (position, width, height, BGR bytes) of frames from a position
on; if it has an attribute ``info``, a function of the path that gives (frames or None, rate), clips are split into ranges and rates are the
clips' own. Filters on video_id, frame_pos, frame_number and ts reach the reader: clips they rule out are not opened, the rest is read
from the first position that can pass to the last. Decoders open files themselves, so clips lie in mounted folders.

``npy_clip`` decodes clips that are numpy files of shape (frames, height, width, 3).
"""

from __future__ import annotations

import importlib
import json
import math
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from framelake.operators.frames import first_position, scan_clips
from framelake.schemas import FRAMES
from framelake.sources.folders import local_folder

#: Clips that are listed on the driver at most, as a file listing is; more are scanned as rows. Frames of a batch of rows.
LISTED, ROWS = 100_000, 64
_INF = float("inf")
_COLUMNS = ("video_id", "frame_pos", "frame_number", "ts")


def npy_clip(path: str, first: int) -> Iterator[tuple[int, int, int, bytes]]:
    clip = np.load(local_folder(path), mmap_mode="r")
    for i in range(first, len(clip)):
        yield i, clip.shape[2], clip.shape[1], clip[i].tobytes()


def _npy_info(path: str) -> tuple[int, float]:
    return len(np.load(local_folder(path), mmap_mode="r")), 0.0


npy_clip.info = _npy_info


def named(decoder: str) -> Callable:
    module, _, name = decoder.partition(":")
    return getattr(importlib.import_module(module), name)


class Span(InputPartition):
    """Positions ``lo`` to ``hi`` of a clip, both included; ``zero`` is the position of frame number 0."""

    def __init__(self, clip: dict, fps: float, lo: int, hi: float, zero: int) -> None:
        super().__init__(None)
        self.clip, self.fps, self.lo, self.hi, self.zero = clip, fps, lo, hi, zero


class FramesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.clips, self.name, self.fps, self.split = json.loads(options["clips"]), options["decoder"], float(options.get("fps", 30)), int(options.get("split", 0))
        self.images = options.get("images", "true").lower() == "true"
        self.low, self.high, self.any_of = ({c: -_INF for c in _COLUMNS}, {c: _INF for c in _COLUMNS}, {})

    def passes(self, column: str, value: float) -> bool:
        return self.low[column] <= value <= self.high[column] and (column not in self.any_of or value in self.any_of[column])

    def partitions(self) -> list[InputPartition]:
        out, info = [], getattr(named(self.name), "info", None)
        for c in self.clips:
            if not self.passes("video_id", c["video_id"]):
                continue
            n, fps = info(c["path"]) if info else (None, 0.0)
            fps = fps if fps and fps > 0.1 else self.fps
            first = first_position(c["moment_time"], c["start_ts"], fps)
            if first is None:
                continue
            start, end = max(c["start_ts"], self.low["ts"]), min(c["end_ts"], self.high["ts"])
            at = lambda ts, c=c, fps=fps: (ts - c["moment_time"]) * fps - 1  # noqa: E731  position by the clock, but for rounding
            lo = max(first, self.low["frame_pos"], self.low["frame_number"] + first - 1, math.floor(at(start)) - 1 if start > -_INF else 0)
            hi = min(self.high["frame_pos"], self.high["frame_number"] + first - 1, math.ceil(at(end)) + 1 if end < _INF else _INF, n - 1 if n is not None else _INF)
            for column, zero in (("frame_pos", 0), ("frame_number", first - 1)):
                if column in self.any_of:
                    lo, hi = max(lo, min(self.any_of[column], default=_INF) + zero), min(hi, max(self.any_of[column], default=-_INF) + zero)
            lo = math.ceil(lo) if lo < _INF else _INF
            step = self.split if self.split > 0 and hi < _INF else _INF
            while lo <= hi:
                out.append(Span(c, fps, int(lo), min(hi, lo + step - 1), first - 1))
                lo += step
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        s, rows = partition, []
        c = s.clip

        def batch() -> pa.RecordBatch:
            video, pos, number, ts, w, h, image = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((video, pos, number, ts, w, h, image), kinds, strict=True)], FRAMES.names)

        for pos, w, h, image in named(self.name)(c["path"], s.lo):
            if pos > s.hi:
                break
            ts = c["moment_time"] + (pos + 1) / s.fps
            if ts > c["end_ts"]:
                break
            if ts >= c["start_ts"] and self.passes("ts", ts) and self.passes("frame_pos", pos) and self.passes("frame_number", pos - s.zero):
                rows.append((c["video_id"], pos, pos - s.zero, ts, w, h, image if self.images else None))
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
            if pos >= s.hi:
                break
        if rows:
            yield batch()


class FilteredReader(FramesReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All comparisons of these columns with numbers are taken over whole; a strict one is one with the next number."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if column not in _COLUMNS or not (isinstance(value, (int, float)) and value == value or isinstance(f, In)):
                yield f
                continue
            step = 1 if column != "ts" else 0
            if isinstance(f, In):
                self.any_of[column] = self.any_of.get(column, set(f.value)) & set(f.value)
            elif isinstance(f, EqualTo):
                self.low[column], self.high[column] = max(self.low[column], value), min(self.high[column], value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                strict = isinstance(f, GreaterThan)
                self.low[column] = max(self.low[column], value + 1 if strict and step else math.nextafter(value, _INF) if strict else value)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                strict = isinstance(f, LessThan)
                self.high[column] = min(self.high[column], value - 1 if strict and step else math.nextafter(value, -_INF) if strict else value)
            else:
                yield f


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilteredReader(self.options) if "filtered" in self.options else FramesReader(self.options)


def read_frames(spark: SparkSession, clips: DataFrame, decoder: str, fps: float = 30.0, split: int = 0, images: bool = True, where: str | None = None) -> DataFrame:
    """Frames of ``clips`` inside their windows; ``decoder`` is named as ``module:function``.

    Up to LISTED clips are listed on the driver and read by the data source, in ranges of ``split`` frames; more
    are scanned clip by clip. Only ``where`` is pushed down to the reader: Spark 4.1 keeps what was pushed to a Python source for later queries on
    the same DataFrame, and would apply it to those without that filter as well. So pushdown is switched on
    only while the DataFrame with this filter, which has a source of its own, is planned. Further filters are applied to the rows.
    """
    cols = ("video_id", "path", "moment_time", "start_ts", "end_ts")
    listed = clips.select(*cols).limit(LISTED + 1).collect()
    if len(listed) > LISTED:
        found = scan_clips(clips, named(decoder), fps)
        return found.where(where) if where else found
    spark.dataSource.register(Frames)
    text = json.dumps([r.asDict() for r in listed])
    source = spark.read.format("frames").option("clips", text).option("decoder", decoder).option("fps", fps).option("split", split).option("images", str(images))
    if where is None:
        return source.load()
    switch, found = "spark.sql.python.filterPushdown.enabled", source.option("filtered", "true").load().where(where)
    before = spark.conf.get(switch, "false")
    spark.conf.set(switch, "true")
    try:
        found._jdf.queryExecution().toRdd().getNumPartitions()  # plans the ranges to read, no more
    finally:
        spark.conf.set(switch, before)
    return found


def write_npy_clips(df: DataFrame, path: str, name: str = "clip_%d.npy") -> None:
    """One file for each video_id of rows (video_id, frame_pos, image) with images of ``width`` x ``height`` BGR bytes, in order of frame_pos.

    Frames go to the file as they come; the head, which tells their number, has a fixed length and is written last. A repeated task writes the same file again.
    """
    folder = local_folder(path)
    os.makedirs(folder, exist_ok=True)

    def head(n: int, h: int, w: int) -> bytes:
        text = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({n}, {h}, {w}, 3), }}".ljust(117) + "\n"
        return b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, n, size = None, None, 0, (0, 0)

        def close() -> None:
            if out is not None:
                out.seek(0)
                out.write(head(n, *size))
                out.close()
                os.replace(out.name, os.path.join(folder, name % now))

        for b in batches:
            for video, w, h, image in zip(*(b.column(c).to_pylist() for c in ("video_id", "width", "height", "image")), strict=True):
                if video != now:
                    close()
                    now, n, size = video, 0, (h, w)
                    out = open(os.path.join(folder, f".{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                    out.write(head(0, h, w))
                out.write(image)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    df.select("video_id", "frame_pos", "width", "height", "image").repartition("video_id").sortWithinPartitions("video_id", "frame_pos").mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()


def clip_path(folder: str, video_id, name: str = "clip_%d.npy"):
    """The path of a clip of write_npy_clips(), as a column."""
    return F.format_string(f"{folder}/{name}", video_id)
