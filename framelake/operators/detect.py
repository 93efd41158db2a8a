"""From model inputs to kept detections in pixels of the frame, in one transform."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import to_original
from framelake.operators import models, nms, tensors

BOX = ("cx", "cy", "w", "h")


def detect(frames: DataFrame, engine: dict[str, Any], make_predict: Callable, keys: list[str], anchors: int, tensor: str | None = None, shape: list[int] | None = None, strategy: str = "auto", error: str | None = None, outer: bool = False) -> DataFrame:
    """Rows (keys, anchor, box, confidence, class_id, keypoints of a pose, kept_rank), one for each detection that is kept.

    ``frames`` has ``keys``, ``width`` and ``height`` and either raw BGR bytes in ``image``, which are letterboxed, or a
    model input in ``tensor``. ``engine`` has input_width, input_height, conf_threshold, nms_threshold and may have type, batch_size and
    roi_cropping. Steps: model, decoding, confidence filter, suppression in model pixels,
    rescaling. If the engine crops and the frame has px1, py1, px2, py2, width and height are those of the crop and boxes
    are moved by its origin; an engine that does not crop never moves boxes. Frames with unknown size keep model pixels.

    With ``error`` frames on which the model fails do not end the job: each has one row, with the failure in that column
    and nulls for the detection; the other frames of its batch go on. With ``outer`` frames without detections have
    a row of nulls as well, so that every frame is told of. A frame that has an ``error`` already keeps it; the model gets zeros for it.
    """
    width, height = engine["input_width"], engine["input_height"]
    crops = bool(engine.get("roi_cropping")) and "px1" in frames.columns
    cropped = F.col("px1").isNotNull() if crops else F.lit(False)
    part = lambda a, b, whole: F.when(cropped, F.col(b) - F.col(a)).otherwise(F.col(whole)) if crops else F.col(whole)
    frames = frames.withColumn("_ow", part("px1", "px2", "width").cast("double")).withColumn("_oh", part("py1", "py2", "height").cast("double"))
    frames = frames.withColumn("_dx", (F.when(cropped, F.col("px1")) if crops else F.lit(None)).cast("double")).withColumn("_dy", (F.when(cropped, F.col("py1")) if crops else F.lit(None)).cast("double"))
    if tensor is None:
        frames = frames.withColumn("_input", models.letterbox(F.col("image"), F.col("_ow").cast("int"), F.col("_oh").cast("int"), width, height))
        tensor, shape = "_input", [3, height, width]
    size = [c for c in ("_ow", "_oh", "_dx", "_dy", "_tw", "_th")]
    frames = frames.withColumn("_tw", F.col("width").cast("double")).withColumn("_th", F.col("height").cast("double"))
    before = error in frames.columns  # failures of a step before, whose frames have no input
    if before:
        frames = frames.withColumnRenamed(error, "_before").withColumn(tensor, F.coalesce(tensor, F.array_repeat(F.lit(0.0).cast("float"), math.prod(shape))))
    out = models.infer(frames.select(*keys, *size, *(["_before"] if before else []), tensor), tensor, make_predict, engine.get("batch_size", 1), shape, "_output", error).drop(tensor)
    if before:
        out = out.withColumn(error, F.coalesce("_before", error)).withColumn("_output", F.when(F.col(error).isNull(), F.col("_output"))).drop("_before")
    pose = str(engine.get("type", "detection")).lower() == "pose"
    found = tensors.decode_any(out, "_output", anchors, 17 if pose else 0, engine["conf_threshold"], outer or error is not None)
    if error is not None and not outer:
        found = found.where(F.col("anchor").isNotNull() | F.col(error).isNotNull())
    kept = nms.nms(found, keys, engine["nms_threshold"], strategy)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    move = lambda cx, cy, w, h: to_original((cx, cy, w, h), F.col("_ow"), F.col("_oh"), F.lit(float(width)), F.lit(float(height)), zero("_dx"), zero("_dy"), F.col("_tw"), F.col("_th"))
    box = move(*(F.col(c).cast("double") for c in BOX))
    if error or outer:  # clamping would make numbers of nulls
        box = tuple(F.when(F.col("anchor").isNotNull(), b) for b in box)
    cols = [*keys, "anchor", *(b.alias(n) for b, n in zip(box, BOX, strict=True)), "confidence", "class_id"]
    if pose:
        def point(k):
            x, y, _, _ = move(k["x"].cast("double"), k["y"].cast("double"), F.lit(0.0), F.lit(0.0))
            return F.struct(x.alias("x"), y.alias("y"), k["confidence"].alias("confidence"))

        cols.append(F.transform("keypoints", point).alias("keypoints"))
    return kept.select(*cols, *([error] if error else []), "kept_rank")
