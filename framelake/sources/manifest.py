"""Clip lists: plain text and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.functions.geometry import valid_roi
from framelake.functions.scalars import INF, extension, number_prefix_or, parse_epoch, time_window, trim_all
from framelake.sources.folders import stored

_JSON = """alarm STRUCT<raw_alarm: STRUCT<record_list: ARRAY<STRUCT<moment_time: STRING, duration: STRING>>, video_start_time: STRING, video_end_time: STRING>>,
playback_location ARRAY<STRING>, config STRUCT<box: ARRAY<ARRAY<FLOAT>>>"""


def parse_plain(lines: DataFrame) -> DataFrame:
    """Trimmed lines that are neither empty nor begin with ``#``."""
    return lines.select(*(c for c in lines.columns if c != "value"), trim_all(F.col("value")).alias("path")).where((F.length("path") > 0) & ~F.col("path").startswith("#"))


def zip_flatten(records: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each pair of elements at equal places, up to the shorter list."""
    n = F.least(F.size(a), F.size(b))
    rest = [c for c in records.columns if c not in (a, b)]
    return records.select(*rest, F.posexplode(F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))).alias("place", "z")).select(*rest, "place", F.col("z.a").alias(a), F.col("z.b").alias(b))


def parse_jsonl(lines: DataFrame, padding_s: float = 0.0, legacy_iso: bool = False) -> DataFrame:
    """Clips of JSON lines (column ``value``); lines that cannot be read, or lack the lists, are skipped."""
    j = lines.withColumn("j", F.from_json("value", _JSON, {"mode": "PERMISSIVE"})).where(F.col("j.alarm.raw_alarm").isNotNull() & F.col("j.alarm.raw_alarm.record_list").isNotNull() & F.col("j.playback_location").isNotNull())
    start, end = time_window(parse_epoch(F.col("j.alarm.raw_alarm.video_start_time"), legacy_iso), parse_epoch(F.col("j.alarm.raw_alarm.video_end_time"), legacy_iso), padding_s)
    box = F.col("j.config.box")
    at = lambda i, k: F.get(F.get(box, F.lit(i)), F.lit(k))
    x1, y1, x2, y2 = at(0, 0), at(0, 1), at(2, 0), at(2, 1)
    roi = F.when((F.size(box) >= 4) & valid_roi(x1, y1, x2, y2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    rest = [c for c in lines.columns if c != "value"]
    flat = zip_flatten(j.select(*rest, F.col("j.alarm.raw_alarm.record_list").alias("record"), F.col("j.playback_location").alias("location"), start.alias("start_ts"), end.alias("end_ts"), roi.alias("roi")), "record", "location")
    path = F.when(F.col("location").startswith("{"), F.get_json_object("location", "$.file")).otherwise(F.col("location"))
    return flat.select(*rest, "place", path.alias("path"), number_prefix_or(F.col("record.moment_time")).alias("moment_time"), number_prefix_or(F.col("record.duration")).alias("duration"), "start_ts", "end_ts", "roi").where(F.length("path") > 0)


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None, padding_s: float = 0.0, legacy_iso: bool = False) -> DataFrame:
    """Clips of a list file; ``video_id`` is the place in the list, from 0."""
    if fmt is None:
        suffix = path.rsplit(".", 1)[-1].lower()
        fmt = "jsonl" if suffix in ("json", "jsonl", "ndjson") else "plain"
    # A list may be many files: their names, then the places in them are its order.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    if fmt == "plain":
        unbounded = F.lit(INF)
        no_roi = F.lit(None).cast("struct<x1:float,y1:float,x2:float,y2:float>")
        clips = parse_plain(lines).select("_file", "_block", "_line", F.lit(0).alias("place"), "path", F.lit(0.0).alias("moment_time"), F.lit(0.0).alias("duration"), (-unbounded).alias("start_ts"), unbounded.alias("end_ts"), no_roi.alias("roi"))
    else:
        clips = parse_jsonl(lines, padding_s, legacy_iso)
    clips = stored(clips)  # lists are read and parsed once, and a line's place is the same for all that follows
    block = ["_file", "_block"]
    counts = clips.groupBy(*block).agg(F.count("*").alias("_c"))  # a row for each block of a file
    counts = counts.select(*block, (F.sum("_c").over(W.orderBy(*block)) - F.col("_c")).alias("_before"))
    own = F.row_number().over(W.partitionBy(*block).orderBy("_line", "place")) - 1
    placed = clips.withColumn("_own", own).join(F.broadcast(counts), block).withColumn("_i", F.col("_own") + F.col("_before"))
    return placed.select(F.col("_i").cast("int").alias("video_id"), "path", "moment_time", "duration", "start_ts", "end_ts", "roi")


def is_json_list(path):
    """Column test by file name."""
    return extension(path).isin("json", "jsonl", "ndjson")
