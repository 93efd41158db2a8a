"""From a configuration to detections in a sink, in waves that can be interrupted and taken up again.

The work is every clip for every engine. A wave is a share of the clips: its frames are scanned once, go to each engine that
has not done them yet, and are written to a folder of the wave's own below ``detections``. Then the wave's pairs of clip and engine are
written to ``commits``, with what was done for each; that one small file is the commit. A run begins with the pairs that no commit
has. What a run leaves behind when it dies before a wave's commit is never read, and the wave is done again, so each pair's frames
are there once however often runs are killed.
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.functions.scalars import output_path
from framelake.operators import models
from framelake.operators.detect import detect
from framelake.operators.frames import TASKS, fan_out, scan_clips, with_roi
from framelake.schemas import DETECTION_FILE, RESULTS
from framelake.sources.config import Config, flag, from_args
from framelake.sources.folders import exists, file_system, stored

#: Pairs of a clip and an engine in one wave; also the bound of what is broadcast for it.
PER_WAVE = 20_000
COMMITS = "video_id int, path string, engine string, wave string, frames bigint, detections bigint, failed bigint, committed_at timestamp"
#: Frames of clips (video_id, path and windows): video_id, frame_number, width, height, image or tensor, and error of a clip that cannot be read.
Scan = Callable[[DataFrame], DataFrame]


def commits(spark: SparkSession, output: str) -> DataFrame:
    """What is complete: the last commit of each pair of clip and engine."""
    path = f"{output}/commits"
    if not exists(spark, path):
        return spark.createDataFrame([], COMMITS)
    newest = W.partitionBy("video_id", "engine").orderBy(F.desc("committed_at"), "wave")
    return spark.read.schema(COMMITS).parquet(path).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def pending(clips: DataFrame, engines: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (video_id, path, engine) that no commit has; a clip whose path is another than the commit's counts as new."""
    return fan_out(clips.select("video_id", "path"), engines.select("engine")).join(done.select("video_id", "path", "engine"), ["video_id", "path", "engine"], "left_anti")


def _write_commits(rows: DataFrame, output: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{output}/commits")  # PER_WAVE small rows at most: one file, which appears as a whole


def _file_rows(found: DataFrame, engine: dict[str, Any]) -> DataFrame:
    """Detections as rows of a detection file; a frame without any, or on which something failed, is a row with null det_index."""
    pose = str(engine.get("type", "detection")).lower() == "pose"
    points = F.col("keypoints") if pose else F.lit(None)
    some = F.col("anchor").isNotNull()
    new = {
        "path": output_path(F.col("video_id"), F.lit(engine["name"])), "model_type": F.lit(int(pose)), "det_index": F.when(some, F.col("kept_rank")),
        "keypoints": F.when(some, F.coalesce(points.cast(DETECTION_FILE["keypoints"].dataType), F.array())),
    }
    rows = found.withColumns(new)
    return rows.select("video_id", F.lit(engine["name"]).alias("engine"), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in DETECTION_FILE.fields), "error")


def run(spark: SparkSession, config: Config, scan: Scan, predictors: dict[str, Callable], output: str | None = None, tensor: str | None = None, shape: list[int] | None = None, per_wave: int = PER_WAVE, max_waves: int | None = None, clips: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """Does what is left of ``config`` (at most ``max_waves`` waves of it), and returns commits().

    ``predictors`` has a model for each engine's name; an engine's ``anchors`` is the number of anchors that it gives for a frame. ``scan`` gives the frames of some
    clips, with images or, in ``tensor``, model inputs. Clips come from the configuration if they are not given. Frames on which a model fails, and
    clips that cannot be read, do not end a run: they are committed as failed, see failures().
    """
    output = output or config.output_dir
    clips = stored(clips if clips is not None else config.clip_frame(spark)) if clips is not None or config.has_clips() else None
    if found := config.problems(clips is not None):
        raise ValueError("; ".join(found))
    engines = {e["name"]: e for e in config.engines}
    todo = stored(pending(clips, spark.createDataFrame([(n,) for n in engines], "engine string"), commits(spark, output)))
    waves = -(-todo.count() // per_wave)
    for i in range(waves if max_waves is None else min(waves, max_waves)):
        part = todo.where(F.pmod(F.xxhash64("video_id"), F.lit(waves)) == i)
        names = [r.engine for r in part.select("engine").distinct().collect()]  # of the configuration
        if not names:
            continue
        mine = clips.join(F.broadcast(part.select("video_id").distinct()), "video_id", "left_semi")
        frames = scan(mine)
        if "error" not in frames.columns:
            frames = frames.withColumn("error", F.lit(None).cast("string"))
        # Clips differ in length: frames are dealt anew, and the engines share that exchange, so clips are decoded once. What an engine
        # does not need would else be left out before the exchange, which would make one of its own for each.
        # Their number is given: by its bytes the exchange is small, and would be put together into few tasks that run the models.
        frames = frames.repartition(TASKS * spark.sparkContext.defaultParallelism, "video_id", F.floor(F.col("frame_number") / 64)).mapInArrow(lambda batches: batches, frames.schema)
        each = []
        for name in sorted(names):
            e = engines[name]
            its = frames.join(F.broadcast(part.where(F.col("engine") == name).select("video_id")), "video_id", "left_semi")
            if tensor is None and flag(e.get("roi_cropping")) and "px1" in its.columns:
                its = its.withColumn("image", models.crop("image", "width", "px1", "py1", "px2", "py2"))
            each.append(_file_rows(detect(its, e, predictors[name], ["video_id", "frame_number"], e["anchors"], tensor, shape, strategy, "error", True), e))
        rows = each[0]
        for other in each[1:]:
            rows = rows.unionByName(other)
        wave = f"w{uuid.uuid4().hex}"
        path = f"{output}/detections/wave={wave}"
        rows.write.parquet(path)
        first = F.col("frame_number").isNotNull() & (F.coalesce("det_index", F.lit(0)) == 0)
        counts = spark.read.schema(RESULTS).parquet(path).groupBy("video_id", "engine").agg(F.count_if(first).alias("frames"), F.count("det_index").alias("detections"), F.count("error").alias("failed"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        commit = part.join(counts, ["video_id", "engine"], "left").select("video_id", "path", "engine", F.lit(wave).alias("wave"), zero("frames"), zero("detections"), zero("failed"), F.current_timestamp().alias("committed_at"))
        _write_commits(commit, output)
    return commits(spark, output)


def results(spark: SparkSession, output: str) -> DataFrame:
    """Rows of detection files, with video_id, engine and error, of all that is committed."""
    path = f"{output}/detections"
    if not exists(spark, path):
        return spark.createDataFrame([], RESULTS)
    done = commits(spark, output).select("wave", "video_id", "engine")
    return spark.read.schema(f"{RESULTS.toDDL()}, wave string").parquet(path).join(done, ["wave", "video_id", "engine"], "left_semi").select(*RESULTS.names)


def failures(spark: SparkSession, output: str) -> DataFrame:
    """Frames and clips (with a null frame_number) that failed, and why."""
    return results(spark, output).where("error is not null").select("video_id", "engine", "frame_number", "error")


def summary(spark: SparkSession, output: str) -> DataFrame:
    """Clips, frames, detections and failures by engine."""
    return commits(spark, output).groupBy("engine").agg(F.count("*").alias("clips"), *(F.sum(c).alias(c) for c in ("frames", "detections", "failed")))


def vacuum(spark: SparkSession, output: str) -> int:
    """Deletes what interrupted runs have left, and says how many waves that were; not while a run goes on."""
    path = f"{output}/detections"
    if not exists(spark, path):
        return 0
    fs, p = file_system(spark, path)
    kept = {f"wave={r.wave}" for r in commits(spark, output).select("wave").distinct().collect()}  # one for each wave, not for each clip
    left = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("wave=") and x.getPath().getName() not in kept]
    for x in left:
        fs.delete(x, True)
    return len(left)


def clip_scan(clips: DataFrame, decoder: Callable, fps: float = 30.0, max_frames: int = 0) -> DataFrame:
    """Frames of clips by a decoder, with the region of interest of each in pixels where its clip has a valid one."""
    frames = scan_clips(clips, decoder, fps, max_frames, "error")
    if "roi" not in clips.columns:
        return frames
    return with_roi(frames, clips.select("video_id", *(F.col(f"roi.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))), F.col("width"), F.col("height"))


def main(argv: list[str], decoder: Callable, spark: SparkSession | None = None) -> DataFrame:
    """A command line over clips and model files: settings as in ``from_args``, and ``--fps``, ``--waves`` (at most so many in this run), ``--vacuum``."""
    p = argparse.ArgumentParser(prog="framelake", add_help=False)
    p.add_argument("--fps", type=float, default=30.0)
    p.add_argument("--waves", type=int)
    p.add_argument("--vacuum", action="store_true")
    own, rest = p.parse_known_args(argv)
    config = from_args(rest)
    spark = spark or SparkSession.builder.getOrCreate()
    if own.vacuum:
        vacuum(spark, config.output_dir)
    for e in config.engines:
        graph = models.onnx_graph(e["path"])
        batch = graph["inputs"][0][1][0]
        config.use_engine_batches({e["name"]: batch if isinstance(batch, int) else 0})
        e["anchors"] = int(graph["outputs"][0][1][-1])
    run(spark, config, lambda clips: clip_scan(clips, decoder, own.fps, config.max_frames_per_video if config.debug else 0), {e["name"]: models.onnx_model(e["path"]) for e in config.engines}, max_waves=own.waves)
    return summary(spark, config.output_dir)
