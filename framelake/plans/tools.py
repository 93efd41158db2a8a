"""One function for each command-line tool of a detection workflow; all return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import scalars as S
from framelake.operators import matching, nms, stats, tensors
from framelake.sources import detbin
from framelake.sources.tensors import diff_files, is_file, numbered, read_tensor, read_tensors

BOX = ("cx", "cy", "w", "h")


def read(spark: SparkSession, path: str, dedup: str = "all") -> DataFrame:
    """Detections of files; of repeated frames all, the ``last`` or the ``last_nonempty`` record."""
    rows = detbin.read_detections(spark, path)
    if dedup == "all":
        return rows
    # Records of one frame follow each other in a file; a new one begins at index 0 or is empty.
    from pyspark.sql import Window as W

    order = F.monotonically_increasing_id()
    begins = (F.col("det_index").isNull() | (F.col("det_index") == 0)).cast("int")
    rows = rows.withColumn("_o", order).withColumn("_record", F.sum(begins).over(W.partitionBy("path", "frame_number").orderBy("_o")))
    frames = rows.groupBy("path", "frame_number", "_record").agg(F.count("det_index").alias("n"))
    kept = stats.keep_record(frames, ["path", "frame_number"], "_record", dedup).select("path", "frame_number", "_record")
    return rows.join(kept, ["path", "frame_number", "_record"], "left_semi").select(*detbin.NAMES)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file and, with a null path, one for all."""
    rows = read(spark, path)
    files = stats.file_summary(stats.frame_counts(rows, ["path", "frame_number"]))
    found = stats.confidence_summary(read(spark, path, "last_nonempty").where("det_index is not null"), ["path"])
    names = rows.groupBy("path").agg(F.min("model_type").alias("model_type"))
    total = stats.rollup_summary(files).where("path is null")
    each = files.join(names, "path").join(found, "path", "left").withColumn("model", S.model_type_name(F.col("model_type")))
    return each.unionByName(total, allowMissingColumns=True)


def debug(spark: SparkSession, path: str) -> DataFrame:
    """Every box with flags for odd values."""
    flags = G.box_diagnostics(*(F.col(c) for c in (*BOX, "confidence")))
    return read(spark, path).where("det_index is not null").select("*", *(c.alias(n) for n, c in flags.items()))


def process_outputs(spark: SparkSession, path: str, batch: int, channels: int, conf: float, threshold: float, start_frame: int = 0, keypoints: int = 0) -> DataFrame:
    """Tensor dumps to kept detections by frame: batches in order of name, items in order."""
    raw = numbered(read_tensors(spark, path, batch, channels))
    anchors = raw.agg(F.max("anchors")).first()[0] or 1
    frames = raw.select((F.col("ordinal") * batch + F.col("item") + start_frame).alias("frame_number"), "tensor")
    return nms.nms(tensors.decode_any(frames, "tensor", anchors, keypoints, conf), ["frame_number"], threshold)


def verify(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision and recall of two detection sets by frame (columns frame_number, anchor and the box)."""
    return matching.match_metrics(left, right, ["frame_number"], threshold)


def compare(spark: SparkSession, a: str, b: str, dtype: str = "<f4", tol: float = 1e-6) -> DataFrame:
    """Differences of two tensor files, up to the shorter one; in mounted folders block by block, so of any size."""
    if "://" not in a.removeprefix("file://") and "://" not in b.removeprefix("file://") and is_file(a) and is_file(b):
        return diff_files(spark, a, b, dtype, tol).drop("n_a", "n_b")
    one = lambda p: read_tensor(spark, p, dtype).select(F.lit(1).alias("key"), "tensor")
    return tensors.tensor_diff(one(a), one(b), ["key"], tol, per_key=False)


def cross_check(spark: SparkSession, a: str, b: str, batch: int, channels: int, pattern: str = "outputs_batch*.bin", tol: float = 1e-6) -> DataFrame:
    """Differences of the i-th dump of one folder with that of the other, up to the shorter list."""
    side = lambda p: numbered(read_tensors(spark, p, batch, channels, pattern)).select("ordinal", "item", "tensor")
    return tensors.tensor_diff(side(a), side(b), ["ordinal", "item"], tol)


def raw_report(spark: SparkSession, path: str, batch: int, channels: int, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Profile of each item's confidences, and the most confident anchors (of equal ones the later)."""
    raw = numbered(read_tensors(spark, path, batch, channels))
    anchors = raw.agg(F.max("anchors")).first()[0] or 1
    rows = tensors.decode_any(raw.select("ordinal", "item", "tensor"), "tensor", anchors)
    rows = rows.withColumn("sigmoid", G.sigmoid(F.col("confidence")))
    return tensors.profile(rows, ["ordinal", "item"], "confidence"), tensors.top_confidence(rows, k)
