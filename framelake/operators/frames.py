"""Frame scans: windows, caps, fan-out to engines, clip lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.geometry import draw_box, drawn_points, drawn_segments, roi_pixels, valid_roi
from framelake.functions.scalars import frame_clock
from framelake.schemas import FRAMES

#: Rows, and bytes of images, that scan_clips() gives on at once, whichever is reached first; its tasks for each core.
ROWS, BYTES, TASKS = 8192, 32 << 20, 4
#: Of a clip: (frame position, width, height, image bytes) from a position on.
Decoder = Callable[[str, int], Iterator[tuple[int, int, int, bytes]]]


def window_scan(frames: DataFrame, moment: str = "moment", start: str = "start_ts", end: str = "end_ts", fps: str = "fps", pos: str = "pos") -> DataFrame:
    """Frames inside their clip's window, with the clock ``frame_ts``.

    Reading starts at floor((start - moment) * fps) where that is ahead, which is one frame
    later than the clock alone would say if the product is whole.
    """
    offset = F.col(start) - F.col(moment)
    seek = F.when((offset > 0) & (offset < float("inf")), F.floor(offset * F.col(fps))).otherwise(0)
    clock = frame_clock(F.col(moment), F.col(pos), F.col(fps))
    return frames.withColumn("frame_ts", clock).where((F.col(pos) >= seek) & (F.col("frame_ts") >= F.col(start)) & (F.col("frame_ts") <= F.col(end)))


def cap_per_video(frames: DataFrame, n: int, video: str = "video_id", pos: str = "pos") -> DataFrame:
    """The first ``n`` frames of each video; 0 or less is no cap."""
    if n <= 0:
        return frames
    return frames.withColumn("_r", F.row_number().over(W.partitionBy(video).orderBy(pos))).where(F.col("_r") <= n).drop("_r")


def global_cap(frames: DataFrame, n: int, order: tuple[str, ...] = ("video_id", "pos")) -> DataFrame:
    return frames if n <= 0 else frames.orderBy(*order).limit(n)


def frame_range(frames: DataFrame, start: int | None = None, end: int | None = None, inclusive: bool = True, pos: str = "pos", max_frames: int = 0, batch: int = 1, order: tuple[str, ...] = ()) -> DataFrame:
    """Frames from ``start`` to ``end``; ``max_frames`` is looked at after every ``batch`` frames, so it is rounded up to whole batches."""
    max_frames = -(-max_frames // batch) * batch
    if start is not None:
        frames = frames.where(F.col(pos) >= start)
    if end is not None:
        frames = frames.where(F.col(pos) <= end if inclusive else F.col(pos) < end)
    return global_cap(frames, max_frames, order or (pos,))


def with_roi(frames: DataFrame, clips: DataFrame, width: Column, height: Column, video: str = "video_id") -> DataFrame:
    """Each frame with its clip's region of interest in pixels (px1, py1, px2, py2), nulls if that is not valid; clips have x1, y1, x2, y2."""
    roi = F.when(valid_roi(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.struct("x1", "y1", "x2", "y2"))
    both = frames.join(clips.select(video, roi.alias("_roi")), video)
    px = roi_pixels(F.col("_roi"), width, height)
    return both.select("*", *(F.when(F.col("_roi").isNotNull(), p).cast("int").alias(n) for p, n in zip(px, ("px1", "py1", "px2", "py2"), strict=True))).drop("_roi")


def fan_out(frames: DataFrame, engines: DataFrame) -> DataFrame:
    """Every frame for every engine; engines are a configuration list, so they are broadcast."""
    return frames.crossJoin(F.broadcast(engines))


def with_detections(frames: DataFrame, detections: DataFrame, frame_key: str = "pos", detection_key: str = "frame_number", video: str | None = None) -> DataFrame:
    """Each frame with its detections or nulls; files count frames from 1."""
    on = F.col(frame_key) + 1 == F.col(detection_key)
    return frames.join(detections, on if video is None else on & (frames[video] == detections[video]), "left")


def first_position(moment: float, start: float, fps: float) -> int | None:
    """The position that is frame number 1 of a clip: where reading starts, or the first frame there whose clock has reached the window's start."""
    offset = start - moment
    if offset == float("inf"):
        return None
    pos = int(offset * fps) if offset > 0 else 0
    while moment + (pos + 1) / fps < start:
        pos += 1
    return pos


def scan_clips(clips: DataFrame, decoder: Decoder, fps: float = 30.0, max_frames: int = 0, error: str | None = None) -> DataFrame:
    """Decodes clips (one row each) with a pluggable decoder; seeks to the window and stops after it, or after ``max_frames`` frames of a clip (0: no cap).

    With ``error`` a clip that cannot be decoded does not end the job: a row with the failure in
    that column follows the frames that were read, with nulls in the others but for video_id. Frames of many short clips go on together.
    """
    names = [*FRAMES.names, *([error] if error else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        more, out, held = [None] if error else [], [], 0
        frame = lambda: pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("frame_pos", "frame_number", "width", "height")})
        for clip_rows in parts:
            for c in clip_rows.itertuples():
                first, number = first_position(c.moment_time, c.start_ts, fps), 0
                try:
                    for pos, width, height, image in decoder(c.path, first) if first is not None else ():
                        ts = c.moment_time + (pos + 1) / fps
                        if ts > c.end_ts:
                            break
                        if pos >= first and ts >= c.start_ts:
                            number += 1
                            out.append((c.video_id, pos, number, ts, width, height, image, *more))
                            held += len(image or b"")
                        if number == max_frames > 0:
                            break
                        if len(out) >= ROWS or held >= BYTES:
                            yield frame()
                            out, held = [], 0
                except Exception as e:
                    if not error:
                        raise
                    out.append((c.video_id, *[None] * (len(FRAMES.names) - 1), f"{type(e).__name__}: {e}"))
                if len(out) >= ROWS:
                    yield frame()
                    out, held = [], 0
        if out:
            yield frame()

    schema = T.StructType([*FRAMES.fields, *([T.StructField(error, T.StringType())] if error else [])])
    rows = clips.select("video_id", "path", "moment_time", "start_ts", "end_ts")
    dealt = rows.repartition(TASKS * clips.sparkSession.sparkContext.defaultParallelism, "video_id", "path")  # a list is small, its clips are much work
    return dealt.mapInPandas(run, schema)


def scan_images(spark: SparkSession, path: str, decoder: Callable[[bytes], tuple[int, int, bytes]], pattern: str = "*") -> DataFrame:
    """Rows (path, width, height, image) of single images, by a pluggable decoder of their bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            yield pd.DataFrame([(p, *decoder(bytes(c))) for p, c in zip(files["path"], files["content"], strict=True)], columns=["path", "width", "height", "image"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, width int, height int, image binary")


def drawings(frames: DataFrame, detections: DataFrame, width: Column, height: Column, frame_key: str = "pos", detection_key: str = "frame_number", video: str | None = None, threshold: float = 0.3) -> DataFrame:
    """Each frame with what is drawn on it: corners of each box, visible keypoints and skeleton edges inside the frame; nulls without detections."""
    rows = with_detections(frames, detections, frame_key, detection_key, video)
    corners = draw_box(tuple(F.col(c) for c in ("cx", "cy", "w", "h")), width, height)
    rows = rows.select("*", *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))
    if "keypoints" in detections.columns:
        rows = rows.withColumn("points", drawn_points(F.col("keypoints"), width, height, threshold)).withColumn("segments", drawn_segments(F.col("keypoints"), width, height, threshold))
    return rows
