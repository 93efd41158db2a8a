"""Summaries of detection files and of processing stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_counts(detections: DataFrame, keys: list[str], index: str = "det_index") -> DataFrame:
    """Detections of each frame; frames without any have a null index."""
    return detections.groupBy(*keys).agg(F.count(index).alias("n"))


def file_summary(frames: DataFrame, file: str = "path", n: str = "n", frame: str = "frame_number") -> DataFrame:
    """Frames with and without detections, detections, and the frame range of each file."""
    return frames.groupBy(file).agg(
        F.count("*").alias("frames"), F.count_if(F.col(n) > 0).alias("with_detections"), F.count_if(F.col(n) == 0).alias("without_detections"), F.sum(n).alias("detections"),
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), (F.max(frame) - F.min(frame) + 1).alias("span"),
    )


def confidence_summary(detections: DataFrame, keys: list[str], confidence: str = "confidence", class_id: str = "class_id") -> DataFrame:
    return detections.groupBy(*keys).agg(F.min(confidence).alias("min_conf"), F.max(confidence).alias("max_conf"), F.avg(confidence).alias("avg_conf"), F.sort_array(F.collect_set(class_id)).alias("classes"), F.count_distinct(class_id).alias("n_classes"))


def rollup_summary(summary: DataFrame, file: str = "path") -> DataFrame:
    """File rows and, with a null file, the total of all."""
    return summary.rollup(file).agg(F.sum("frames").alias("frames"), F.sum("detections").alias("detections"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


def keep_record(rows: DataFrame, keys: list[str], order: str, mode: str = "last", n: str = "n") -> DataFrame:
    """Of rows with equal keys: ``all``, the ``last`` by order, or the ``last_nonempty`` one."""
    if mode == "all":
        return rows
    if mode not in ("last", "last_nonempty"):
        raise ValueError(f"mode: {mode}")
    if mode == "last_nonempty":
        rows = rows.where(F.col(n) > 0)
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_frames(frames: DataFrame, file: str, frame: str, k: int = 5, n: str = "n") -> DataFrame:
    """The first ``k`` frames with detections of each file."""
    w = W.partitionBy(file).orderBy(frame)
    return frames.where(F.col(n) > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def edge_frames(frames: DataFrame, file: str, frame: str, k: int = 10) -> DataFrame:
    """The first and the last ``k`` frames of each file, with ``edge``."""
    up, down = W.partitionBy(file).orderBy(frame), W.partitionBy(file).orderBy(F.desc(frame))
    rows = frames.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where((F.col("_a") <= k) | (F.col("_b") <= k))
    return rows.withColumn("edge", F.when(F.col("_a") <= k, "first").otherwise("last")).drop("_a", "_b")


def stage_stats(items: DataFrame, keys: list[str], ms: str, failed: str, elapsed_s: float) -> DataFrame:
    """Items done and failed, whole items a second, mean milliseconds (each cut to a whole number) and seconds."""
    done, cost = ~F.col(failed), F.floor(F.col(ms)).cast("long")
    total = F.sum(F.when(done, cost).otherwise(0))
    return items.groupBy(*keys).agg(
        F.count_if(done).alias("done"), F.count_if(F.col(failed)).alias("failed"), F.floor(F.count_if(done) / F.lit(float(elapsed_s))).cast("long").alias("fps"),
        F.when(F.count_if(done) > 0, total / F.when(F.count_if(done) > 0, F.count_if(done))).otherwise(0.0).alias("avg_ms"), (total / 1000).alias("total_s"),
    )


engine_stats = reader_stats = stage_stats


def parse_counters(detections: DataFrame, keys: list[str], threshold: float, confidence: str = "confidence") -> DataFrame:
    return detections.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(F.col(confidence) >= threshold).alias("above"), F.max(confidence).alias("max_conf"))


def completeness(files: DataFrame, videos: DataFrame, engines: DataFrame) -> DataFrame:
    """Every video and engine, and whether there is a file for them."""
    want = videos.select("video_id").distinct().crossJoin(F.broadcast(engines.select("engine")))
    return want.join(files.select("video_id", "engine").distinct().withColumn("_there", F.lit(True)), ["video_id", "engine"], "left").select("video_id", "engine", F.coalesce("_there", F.lit(False)).alias("complete"))
