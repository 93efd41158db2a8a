"""Views of the test tables that play the part of anchors, frames, tensors, engines and clips; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENGINES = [("det640", 0, 640, 640, 0.2, 0.55, True), ("det864", 0, 864, 864, 0.2, 0.6, False), ("pose640", 1, 640, 640, 0.4, 0.55, True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes: an order is a frame."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.row_number().over(w).cast("long").alias("anchor"), (F.col("l_quantity") * 12.8).alias("cx"), (F.col("l_partkey") % 640).cast("double").alias("cy"),
        (80.0 + F.col("l_discount") * 2000.0).alias("w"), (80.0 + F.col("l_tax") * 2000.0).alias("h"), (F.floor("l_extendedprice").cast("long") % 1000 / 1000.0).alias("confidence"), F.col("l_returnflag").alias("flag"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is a video."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("engine"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("value").alias("latency"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as outputs of 4 channels and 16 anchors."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("tensor"))


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "engine string, model_type int, input_width int, input_height int, conf double, nms double, crops boolean")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as clips with a window and a region of interest, not always a valid one."""
    moment = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    side = lambda k, n: (F.col("o_custkey") % k) / F.lit(n)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), moment.alias("moment"), (F.floor("o_totalprice").cast("long") % 600).cast("double").alias("duration"), side(50, 100.0).alias("x1"), side(40, 100.0).alias("y1"), side(97, 80.0).alias("x2"), side(89, 70.0).alias("y2"))
    return rows


SQL = {
    "anchors": """anchors AS (SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS anchor,
        l_quantity * 12.8e0 AS cx, CAST(l_partkey % 640 AS DOUBLE) AS cy, 80e0 + l_discount * 2000e0 AS w, 80e0 + l_tax * 2000e0 AS h,
        (CAST(floor(l_extendedprice) AS BIGINT) % 1000) / 1000e0 AS confidence, l_returnflag AS flag FROM lineitem)""",
    "frames": "frames AS (SELECT user_id AS video_id, event_type AS engine, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, value AS latency, event_id, ts FROM events)",
    "tensors": "tensors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS tensor FROM embeddings)",
    "engines": "engines(engine, model_type, input_width, input_height, conf, nms, crops) AS (VALUES ('det640', 0, 640, 640, 0.2e0, 0.55e0, true), ('det864', 0, 864, 864, 0.2e0, 0.6e0, false), ('pose640', 1, 640, 640, 0.4e0, 0.55e0, true))",
    "clips": """clips AS (SELECT o_orderkey AS video_id, CAST(epoch(o_orderdate) AS DOUBLE) AS moment, CAST(CAST(floor(o_totalprice) AS BIGINT) % 600 AS DOUBLE) AS duration,
        (o_custkey % 50) / 100e0 AS x1, (o_custkey % 40) / 100e0 AS y1, (o_custkey % 97) / 80e0 AS x2, (o_custkey % 89) / 70e0 AS y2 FROM orders)""",
}


def sql(body: str, *views: str, **more: str) -> str:
    """A statement over some of the views; ``more`` are further named parts, in order."""
    return "WITH " + ",\n".join([*(SQL[v] for v in views), *(f"{k} AS ({v})" for k, v in more.items())]) + "\n" + body
