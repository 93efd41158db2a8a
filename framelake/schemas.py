"""Schemas and small dimension tables of the detection data model."""

from __future__ import annotations

from pyspark.sql import types as T

F32, F64, I32 = T.FloatType(), T.DoubleType(), T.IntegerType()

KEYPOINT = T.StructType([T.StructField(c, F32) for c in ("x", "y", "confidence")])
DETECTION_FILE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("model_type", I32), T.StructField("frame_number", I32), T.StructField("det_index", I32)]
    + [T.StructField(c, F32) for c in ("cx", "cy", "w", "h", "confidence")]
    + [T.StructField("class_id", I32), T.StructField("keypoints", T.ArrayType(KEYPOINT))]
)
#: Rows of a detection file as the application keeps them.
RESULTS = T.StructType([T.StructField("video_id", I32), T.StructField("engine", T.StringType()), *DETECTION_FILE.fields, T.StructField("error", T.StringType())])
ROI = T.StructType([T.StructField(c, F32) for c in ("x1", "y1", "x2", "y2")])
CLIPS = T.StructType(
    [T.StructField("video_id", I32), T.StructField("path", T.StringType())]
    + [T.StructField(c, F64) for c in ("moment_time", "duration", "start_ts", "end_ts")]
    + [T.StructField("roi", ROI)]
)
ENGINES = T.StructType(
    [
        T.StructField("engine", T.StringType()), T.StructField("path", T.StringType()), T.StructField("model_type", I32), T.StructField("num_detectors", I32), T.StructField("batch_size", I32),
        T.StructField("input_width", I32), T.StructField("input_height", I32), T.StructField("conf_threshold", F32), T.StructField("nms_threshold", F32), T.StructField("gpu_id", I32), T.StructField("roi_cropping", T.BooleanType()),
    ]
)
FRAMES = T.StructType([T.StructField("video_id", I32), T.StructField("frame_pos", T.LongType()), T.StructField("frame_number", T.LongType()), T.StructField("ts", F64), T.StructField("width", I32), T.StructField("height", I32), T.StructField("image", T.BinaryType())])

#: Model types on disk.
MODEL_TYPES = {0: "DETECTION", 1: "POSE"}
#: Keypoints of a pose in file order.
KEYPOINT_NAMES = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
#: Pairs of keypoints that a skeleton joins.
SKELETON = [(0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16)]
#: Log levels in order; boxes of a frame that suppression looks at, and that are kept.
LOG_LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}
MAX_BEFORE_NMS, MAX_DETECTIONS = 5000, 300
