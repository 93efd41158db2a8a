"""Queries on files: table rows are written to the shared folder in a format of the data model and read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from framelake.functions import scalars as S
from framelake.operators import application, batching, frames, models
from framelake.operators import tensors as tensor_ops
from framelake.plans import tools, views
from framelake.plans.catalog import nms_sql
from framelake.plans.registry import ORACLE, query, rounded
from framelake.plans.views import sql
from framelake.schemas import DETECTION_FILE
from framelake.sources import clips, config, detbin, logs, manifest, tensors
from framelake.sources.folders import local_folder, shared_folder
from framelake.streaming import detections, metrics

# Clip lists

LINE = "CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN p_name || ' # kept' ELSE p_name END"


def _write_lines(lines, path):
    """A list as text files whose names are in the order of their lines."""
    lines.repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)
    return path


def _plain_list(spark, d):
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    line = F.when(kind == 0, F.concat(F.lit("# "), name)).when(kind == 1, " \t ").when(kind == 2, F.concat(F.lit("  "), name, F.lit(" # kept"))).otherwise(F.concat(name, F.lit("\t")))
    return _write_lines(views.table(spark, d, "part").select(F.col("p_partkey").alias("n"), line.alias("value")), shared_folder(spark))


PLAIN = f"SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS video_id, path FROM (SELECT p_partkey, {LINE} AS path FROM part) WHERE path IS NOT NULL"


@query(PLAIN)
def plain_clip_list(spark, d):
    return manifest.read_manifest(spark, _plain_list(spark, d), "plain").select("video_id", "path")


# A line has 1 to 3 records and 1 or 2 places; times are numbers, texts that begin with one, or no numbers.
JSON_ROWS = """SELECT o_orderkey, i, CASE WHEN o_custkey % 7 = 0 AND i = 0 THEN '' ELSE printf('clip_%d_%d.mp4', o_orderkey, i) END AS path,
    CASE CAST(o_custkey % 4 AS INTEGER) WHEN 3 THEN 0e0 ELSE CAST(o_orderkey * 10 + i AS DOUBLE) END AS moment_time, CAST(o_custkey % 60 AS DOUBLE) AS duration,
    CAST(o_orderkey - 5 AS DOUBLE) AS start_ts, CASE WHEN o_custkey % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(o_orderkey + 100 + 5 AS DOUBLE) END AS end_ts, o_custkey % 3 = 1 AS has_roi
    FROM orders, range(3) t(i) WHERE o_custkey % 11 <> 0 AND i < least(1 + o_custkey % 3, 1 + o_custkey % 2)"""


def _json_list(spark, d):
    o = views.table(spark, d, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    moment = lambda i: F.when(c % 4 == 0, (k * 10 + i).cast("string")).when(c % 4 == 3, "none").otherwise(F.concat((k * 10 + i).cast("string"), F.lit("abc")))
    records = F.transform(F.sequence(F.lit(0), c.cast("int") % 3), lambda i: F.struct(moment(i).alias("moment_time"), (c % 60).cast("string").alias("duration")))
    names = F.transform(F.sequence(F.lit(0), c.cast("int") % 2), lambda i: F.when((c % 7 == 0) & (i == 0), "").otherwise(F.format_string("clip_%d_%d.mp4", k, i)))
    end = F.when(c % 5 == 0, "never").otherwise((k + 100).cast("string"))
    times = F.struct(records.alias("record_list"), k.cast("string").alias("video_start_time"), end.alias("video_end_time"))
    x2 = F.when(c % 3 == 1, 0.9).otherwise(0.1)
    box = F.array(*(F.array(a, b) for a, b in ((F.lit(0.2), F.lit(0.2)), (x2, F.lit(0.2)), (x2, F.lit(0.8)), (F.lit(0.2), F.lit(0.8)))))
    line = F.to_json(F.struct(F.struct(times.alias("raw_alarm")).alias("alarm"), names.alias("playback_location"), F.struct(box.alias("box")).alias("config")))
    return _write_lines(o.select(k.alias("n"), F.when(c % 11 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")), shared_folder(spark))


@query(f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey, i) - 1 AS INTEGER) AS video_id, path, moment_time, duration, start_ts, end_ts, has_roi FROM ({JSON_ROWS}) WHERE path <> ''")
def json_clip_list(spark, d):
    clips = manifest.read_manifest(spark, _json_list(spark, d), "jsonl", padding_s=5.0)
    return clips.select("video_id", "path", "moment_time", "duration", "start_ts", "end_ts", F.col("roi").isNotNull().alias("has_roi"))


@query(f"WITH p AS ({PLAIN}), j AS ({JSON_ROWS}), n AS (SELECT count(*) AS n FROM p), m AS (SELECT count(*) AS m FROM j WHERE path <> '') SELECT video_id, path FROM p UNION ALL SELECT CAST(n + row_number() OVER (ORDER BY o_orderkey, i) - 1 AS INTEGER), path FROM j, n WHERE path <> '' UNION ALL SELECT CAST(n + m + k AS INTEGER), printf('last_%d.mp4', k) FROM range(2) t(k), n, m")
def source_concat(spark, d):
    """A list file, a JSON list and paths, numbered through."""
    c = config.Config(list_file=_plain_list(spark, d), list_file_jsonl=_json_list(spark, d), paths=["last_0.mp4", "last_1.mp4"])
    return c.clip_frame(spark).select("video_id", "path")


@query("SELECT s_name AS engine, printf('%d.onnx', s_suppkey) AS path, CAST(s_nationkey % 2 AS INTEGER) AS model_type, CAST(CASE WHEN s_nationkey % 3 = 0 THEN 16 ELSE 1 + s_nationkey % 5 END AS INTEGER) AS batch_size, CAST(7 AS INTEGER) AS num_detectors, CAST(CAST(CASE WHEN s_acctbal > 0 THEN (s_nationkey % 8) / 8e0 ELSE 0.25 END AS FLOAT) AS DOUBLE) AS conf_threshold, s_nationkey % 4 = 1 AS roi_cropping, s_nationkey % 3 = 0 AND 1 + s_nationkey % 5 <> 16 AS warned, 'no clip,num_readers must be positive' AS problems FROM supplier WHERE s_suppkey % 7 <> 0")
def config_engines(spark, d):
    """Suppliers as the engines of a configuration file: entries without path, defaults, flags over the file, engines whose own batch size wins, and what is missing."""
    import yaml

    rows = views.table(spark, d, "supplier").orderBy("s_suppkey").collect()  # a configuration is read on the driver
    entries, own = [], {}
    for r in rows:
        e = {"name": r.s_name, "type": "Pose" if r.s_nationkey % 2 else "detection", "batch_size": 1 + r.s_nationkey % 5, "roi_cropping": "yes" if r.s_nationkey % 4 == 1 else "no"}
        if r.s_suppkey % 7:
            e["path"] = f"{r.s_suppkey}.onnx"
        if r.s_acctbal > 0:
            e["conf_threshold"] = r.s_nationkey % 8 / 8
        own[r.s_name] = 16 if r.s_nationkey % 3 == 0 else 0
        entries.append(e)
    folder = local_folder(shared_folder(spark))
    os.makedirs(folder)
    with open(f"{folder}/config.yaml", "w") as f:
        yaml.safe_dump({"models": entries, "threads": {"num_readers": 3}}, f)
    c = config.from_args(["--config", f"{folder}/config.yaml", "--num-detectors", "7", "--num-readers", "0"])
    warned = [w.split(":")[0] for w in c.use_engine_batches(own)]
    return c.engine_frame(spark).select("engine", "path", "model_type", "batch_size", "num_detectors", F.col("conf_threshold").cast("double").alias("conf_threshold"), "roi_cropping", F.col("engine").isin(warned).alias("warned"), F.lit(",".join(c.problems())).alias("problems"))


CLIP = "SELECT o_orderkey AS video_id, 1000e0 AS moment, 1000e0 + o_orderkey % 5 AS start_ts, 1000e0 + 6 + o_orderkey % 3 AS end_ts, 10 + o_orderkey % 20 AS n FROM orders"


@query(f"SELECT CAST(video_id AS INTEGER) AS video_id, CAST(i AS BIGINT) AS frame_pos, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) AS BIGINT) AS frame_number, 1000e0 + (i + 1) / 2e0 AS ts FROM ({CLIP}), range(30) t(i) WHERE i < n AND i >= CASE WHEN start_ts > moment THEN floor((start_ts - moment) * 2) ELSE 0 END AND 1000e0 + (i + 1) / 2e0 BETWEEN start_ts AND end_ts")
def frame_scan(spark, d):
    """Clips of ten to thirty frames, two a second, behind a decoder that makes them up."""

    def decoder(path, first):
        return ((i, 4, 2, b"") for i in range(first, int(path)))

    k = F.col("o_orderkey")
    clips = views.table(spark, d, "orders").select(k.cast("int").alias("video_id"), (10 + k % 20).cast("string").alias("path"), F.lit(1000.0).alias("moment_time"), (1000.0 + k % 5).alias("start_ts"), (1006.0 + k % 3).alias("end_ts"))
    return frames.scan_clips(clips, decoder, 2.0).select("video_id", "frame_pos", "frame_number", "ts")


EVENT_CLIPS = "SELECT video_id, pos, event_id, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS number, 50e0 + (pos + 1) / 4e0 AS ts FROM frames"


@query(sql("SELECT CAST(video_id AS INTEGER) AS video_id, pos AS frame_pos, CAST(number - CASE WHEN video_id % 3 = 0 THEN 8 ELSE 0 END AS BIGINT) AS frame_number, ts, event_id % 16777216 AS pixels FROM c WHERE ts BETWEEN 51.5e0 AND 55e0 AND ts >= CASE WHEN video_id % 3 = 0 THEN 52e0 ELSE 50e0 END AND pos >= CASE WHEN video_id % 3 = 0 THEN 8 ELSE 0 END AND video_id % 5 <> 1 AND video_id <= 900 AND pos <= 17", "frames", c=EVENT_CLIPS))
def frames_pushdown(spark, d):
    """Events of a user as a clip of one pixel, in numpy files; filters reach the reader, which seeks and stops."""
    folder = local_folder(shared_folder(spark))
    f = views.frames(spark, d).select(F.col("video_id").cast("int").alias("video_id"), F.col("pos").alias("frame_pos"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.unhex(F.lpad(F.hex(F.col("event_id") % 16777216), 6, "0")).alias("image"))
    clips.write_npy_clips(f, folder)
    v = F.col("video_id")
    listed = f.select("video_id").distinct().select("video_id", clips.clip_path(folder, v).alias("path"), F.lit(50.0).alias("moment_time"), F.when(v % 3 == 0, 52.0).otherwise(50.0).alias("start_ts"), F.lit(1000.0).alias("end_ts"))
    found = clips.read_frames(spark, listed, "framelake.sources.clips:npy_clip", 4.0, split=64, where="ts >= 51.5 and ts <= 55 and video_id <= 900 and frame_pos <= 17 and video_id % 5 <> 1")
    return found.select("video_id", "frame_pos", "frame_number", "ts", F.conv(F.hex("image"), 16, 10).cast("long").alias("pixels"))


def _failing_identity():
    """A model that gives back its input, but for inputs with the number 7 in the fourth place."""

    def predict(x):
        if (x[:, 3] % 50 == 7).any():
            raise ValueError("no such input")
        return x

    return predict


def _numbered(spark, d):
    f, n = views.frames(spark, d), F.col("event_id")
    values = [n % 600 + 20, n % 600 + 30, n % 1080, n % 1080, F.lit(100), F.lit(100), F.lit(100), F.lit(100), n % 64 / 64, n * 7 % 64 / 64]
    return f.select(F.col("video_id").cast("int").alias("video_id"), (F.col("pos") + 1).alias("frame_number"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.array(*(v.cast("float") for v in values)).alias("tensor"))


TWO_ANCHORS = "SELECT video_id, pos + 1 AS frame, (event_id % 1080) % 50 = 7 AS bad, k AS anchor, CAST(event_id % 600 + 20 + 10 * k AS DOUBLE) AS cx, CAST(event_id % 1080 AS DOUBLE) AS cy, 100e0 AS w, 100e0 AS h, CASE WHEN k = 0 THEN event_id % 64 ELSE event_id * 7 % 64 END / 64e0 AS confidence FROM frames, range(2) t(k)"
BY_ENGINE = " UNION ALL ".join(f"SELECT '{e}' AS engine, * FROM ({nms_sql(f'(SELECT * FROM two WHERE NOT bad AND confidence >= {c})', n, 'video_id, frame')})" for e, c, n in (("det_a", "0.25e0", "0.55e0"), ("det_b", "0.5e0", "0.9e0")))
F32 = "CASE WHEN i IS NOT NULL THEN CAST(CAST(least(greatest({}, 0e0), {}) AS FLOAT) AS DOUBLE) END"


@query(sql(f"SELECT CAST(f.video_id AS INTEGER) AS video_id, f.engine, CAST(f.frame AS INTEGER) AS frame_number, CAST(i AS INTEGER) AS det_index, {F32.format('r.cx / s', '1920e0')} AS cx, {F32.format('(r.cy - 140) / s', '1080e0')} AS cy, {F32.format('r.w / s', '1920e0')} AS w, r.confidence AS confidence, CASE WHEN bad THEN 'ValueError: no such input' END AS error FROM every f LEFT JOIN k ON f.video_id = k.video_id AND f.frame = k.frame AND f.engine = k.engine", "frames", two=TWO_ANCHORS, folded=BY_ENGINE, k="SELECT video_id, frame, engine, unnest(kept) AS r, unnest(range(len(kept))) AS i, 640 / 1920e0 AS s FROM folded", every="SELECT DISTINCT video_id, frame, bad, engine FROM two, (VALUES ('det_a'), ('det_b')) e(engine)"))
def resumed_run(spark, d):
    """Users as clips and their events as frames, for two engines that fail on some of them: a run of two waves, then one that does what is left."""
    output, frames_ = shared_folder(spark), _numbered(spark, d)
    engines = [{"name": n, "path": n, "type": "detection", "batch_size": 16, "input_width": 640, "input_height": 640, "conf_threshold": c, "nms_threshold": t, "roi_cropping": False, "anchors": 2} for n, c, t in (("det_a", 0.25, 0.55), ("det_b", 0.5, 0.9))]
    videos = frames_.select("video_id").distinct().select("video_id", F.format_string("user_%d", "video_id").alias("path"))
    scan = lambda clips: frames_.join(clips.select("video_id"), "video_id", "left_semi")
    per_wave = -(-videos.count() * 2 // 4)

    def go(**kw):
        return application.run(spark, config.Config(engines), scan, {e["name"]: lambda: _failing_identity() for e in engines}, output, "tensor", [10], per_wave, clips=videos, strategy="native", **kw)

    go(max_waves=2)
    go()
    return application.results(spark, output).select("video_id", "engine", "frame_number", "det_index", *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "confidence")), "error")


# Tensor dumps

DUMP = "SELECT CAST(i // 16 AS BIGINT) AS ordinal, CAST(i % 16 AS INTEGER) AS item, vec_id, tensor FROM (SELECT vec_id, tensor, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM tensors) WHERE (i // 16 + 1) * 16 <= n"


def _dumps(spark, d, rows=None):
    t = views.tensors(spark, d) if rows is None else rows
    full = batching.batches(t.withColumn("key", F.lit(0)), 16, ["key"], ["vec_id"], "drop")
    path = shared_folder(spark)
    tensors.write_dumps(full, path)
    return path


@query(sql("SELECT ordinal, item, CAST(4 AS INTEGER) AS channels, CAST(16 AS INTEGER) AS anchors, round(list_sum(list_transform(tensor, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 5) AS total FROM dumps", "tensors", dumps=DUMP))
def tensor_dump_scan(spark, d):
    """Batches of sixteen as headerless files, in order of their names."""
    raw = tensors.numbered(tensors.read_tensors(spark, _dumps(spark, d), 16, 4))
    total = F.aggregate("tensor", F.lit(0.0), lambda acc, v: acc + v)
    return rounded(raw.select(F.col("ordinal").cast("long").alias("ordinal"), "item", "channels", "anchors", total.alias("total")), "total", digits=5)


@query(sql("SELECT a.ordinal, a.item, CAST(64 AS BIGINT) AS n, CAST(list_max(list_transform(range(64), lambda j: abs(a.tensor[j + 1] - b.tensor[j + 1]))) > 1e-6 AS BOOLEAN) AS differs FROM dumps a JOIN shifted b USING (ordinal, item)", "tensors", dumps=DUMP, moved="SELECT vec_id, tensor, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM tensors WHERE vec_id >= 20", shifted="SELECT CAST(i // 16 AS BIGINT) AS ordinal, CAST(i % 16 AS INTEGER) AS item, tensor FROM moved WHERE (i // 16 + 1) * 16 <= n"))
def positional_pairing(spark, d):
    """The i-th dump of one folder against the i-th of another that has fewer."""
    both = tools.cross_check(spark, _dumps(spark, d), _dumps(spark, d, views.tensors(spark, d).where("vec_id >= 20")), 16, 4)
    return both.select(F.col("ordinal").cast("long").alias("ordinal"), "item", "n", (F.col("max_abs") > 1e-6).alias("differs"))


_F32 = "list_transform({}, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))"


@query(sql("SELECT ordinal, CAST(1024 AS BIGINT) AS n, round(max(d), 5) AS max_abs, round(avg(d), 5) AS mean_abs, round(sqrt(avg(d * d)), 5) AS rms, CAST(count(*) FILTER (WHERE d > 0.3) AS BIGINT) AS n_over FROM (SELECT a.ordinal, abs(unnest(" + _F32.format("a.tensor") + ") - unnest(" + _F32.format("b.tensor") + ")) AS d FROM dumps a JOIN shifted b USING (ordinal, item)) GROUP BY ordinal", "tensors", dumps=DUMP, moved="SELECT vec_id, tensor, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM tensors WHERE vec_id >= 20", shifted="SELECT CAST(i // 16 AS BIGINT) AS ordinal, CAST(i % 16 AS INTEGER) AS item, tensor FROM moved WHERE (i // 16 + 1) * 16 <= n"))
def dumps_diff(spark, d):
    """Pairs of dumps of two folders, read by ranges of bytes on both sides."""
    other = _dumps(spark, d, views.tensors(spark, d).where("vec_id >= 20"))
    found = tensors.diff_folders(spark, _dumps(spark, d), other, tol=0.3, block=300)
    return rounded(found.select("ordinal", "n", "max_abs", "mean_abs", "rms", "n_over"), "max_abs", "mean_abs", "rms", digits=5)


@query(sql("SELECT ordinal, CAST(1024 AS BIGINT) AS n, '16,4,16' AS shape, round(sum(list_sum(tensor)), 4) AS total FROM dumps GROUP BY ordinal", "tensors", dumps=DUMP))
def generic_tensor(spark, d):
    """Whole files with a shape."""
    shape = spark.range(1).select(S.shape_of(F.lit("16x4, 16")).alias("s")).first().s
    one = tensors.numbered(tensors.read_tensor(spark, _dumps(spark, d), shape=shape))
    total = F.aggregate("tensor", F.lit(0.0), lambda acc, v: acc + v)
    return rounded(one.select(F.col("ordinal").cast("long").alias("ordinal"), F.size("tensor").cast("long").alias("n"), F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), total.alias("total")), "total", digits=4)


@query(sql("SELECT ordinal, item, CAST(a AS BIGINT) AS anchor, CAST(CAST(tensor[a + 33] AS FLOAT) AS DOUBLE) AS confidence FROM dumps, range(8) t(a) ORDER BY confidence DESC, a DESC, ordinal, item LIMIT 20", "tensors", dumps=DUMP))
def raw_report_top(spark, d):
    """The most confident anchors of dumps of eight channels."""
    _, top = tools.raw_report(spark, _dumps(spark, d), 16, 8, 20)
    return top.select(F.col("ordinal").cast("long").alias("ordinal"), "item", "anchor", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT p_partkey, printf('%d,%d,%d', p_partkey % 7, p_size, p_partkey) AS shape FROM part")
def shape_strings(spark, d):
    a, b, c = F.col("p_partkey") % 7, F.col("p_size"), F.col("p_partkey")
    text = F.when(c % 3 == 0, F.format_string(" %dx%dX%d ", a, b, c)).when(c % 3 == 1, F.format_string("%d,%d,%d", a, b, c)).otherwise(F.format_string("%d, %d x %d", a, b, c))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(S.shape_of(text).cast("array<string>"), ",").alias("shape"))


@query("SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 0e0 ELSE p_size * 100e0 END AS v FROM part")
def number_prefix(spark, d):
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(n, F.lit("abc"))).when(kind == 1, F.concat(F.lit(" "), n, F.lit(".5"))).when(kind == 2, F.concat(F.lit("x"), n)).otherwise(F.concat(n, F.lit("e2 m")))
    return views.table(spark, d, "part").select("p_partkey", S.number_prefix_or(text).alias("v"))


# Detections


def _detections(spark, d):
    f32 = lambda c: F.col(c).cast("float").alias(c)
    points = F.array().cast("array<struct<x:float,y:float,confidence:float>>")
    return views.anchors(spark, d).select((F.col("frame") % 5).cast("int").alias("video_id"), F.lit("det640").alias("engine"), S.output_path(F.col("frame") % 5, F.lit("det640")).alias("path"), F.lit(0).alias("model_type"), F.col("frame").cast("int").alias("frame_number"), (F.col("anchor") - 1).cast("int").alias("det_index"), *(f32(c) for c in ("cx", "cy", "w", "h", "confidence")), F.lit(0).alias("class_id"), points.alias("keypoints"))


@query(sql("SELECT CAST(frame % 5 AS INTEGER) AS video_id, 'det640' AS engine, CAST(count(*) AS BIGINT) AS n, CAST(max(frame) AS INTEGER) AS last_frame FROM anchors WHERE frame % 5 = 2 GROUP BY ALL", "anchors"))
def detection_parquet(spark, d):
    """The canonical sink, read back for one video."""
    path = shared_folder(spark)
    detbin.write_parquet(_detections(spark, d), path)
    return detbin.read_parquet(spark, path).where("video_id = 2").groupBy("video_id", "engine").agg(F.count("*").alias("n"), F.max("frame_number").alias("last_frame"))


@query(sql("SELECT CAST(frame AS INTEGER) AS frame_number, CAST(2 * count(*) AS BIGINT) AS n FROM anchors WHERE frame % 2 = 1 GROUP BY frame UNION ALL SELECT CAST(frame AS INTEGER), CAST(count(*) AS BIGINT) FROM anchors WHERE frame % 2 = 0 GROUP BY frame", "anchors"))
def detbin_append(spark, d):
    """A second run over the odd frames adds records to the files that are there."""
    path, rows = shared_folder(spark), _detections(spark, d)
    detbin.write_detections(rows, path)
    detbin.write_detections(rows.where("frame_number % 2 = 1"), path)
    return detbin.read_detections(spark, path, "FAILFAST").groupBy("frame_number").agg(F.count("det_index").alias("n"))


@query(sql("SELECT CAST(frame AS INTEGER) AS frame_number, CAST(count(*) AS BIGINT) AS n, CAST(max(anchor) - 1 AS INTEGER) AS last FROM anchors WHERE frame BETWEEN 1000 AND 9000 GROUP BY frame", "anchors"))
def indexed_detections(spark, d):
    """Frames of a range from detection files with an index: other blocks are not read, and a file is read by several tasks."""
    path = shared_folder(spark)
    detbin.write_detections(_detections(spark, d), path)
    return detbin.read_frames_of(spark, path, 1000, 9000, "FAILFAST", split=1 << 18).groupBy("frame_number").agg(F.count("det_index").alias("n"), F.max("det_index").alias("last"))


@query(sql("SELECT CAST(frame AS INTEGER) AS frame_number, CAST(count(*) AS BIGINT) AS n, CAST(CAST(max(confidence) AS FLOAT) AS DOUBLE) AS highest FROM anchors GROUP BY frame", "anchors"))
def stream_appended(spark, d):
    """A stream over detection files that grow between two runs of it, the second with few bytes a micro-batch: every frame comes once."""
    path, out, rows = shared_folder(spark), shared_folder(spark), _detections(spark, d)
    for odd in (0, 1):
        detbin.write_detections(rows.where(F.col("frame_number") % 2 == odd), path)
        seen = detections.stream_detections(spark, path, odd * (4 << 20), f"{out}/progress")
        detections.finished(seen, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(DETECTION_FILE).parquet(f"{out}/rows").groupBy("frame_number").agg(F.count("det_index").alias("n"), F.max("confidence").cast("double").alias("highest"))


@query(ORACLE["batch_full_only"])
def stream_batches(spark, d):
    """Batches of sixteen that go on over three runs of a stream; unfinished ones wait in its state."""
    f = views.frames(spark, d).select("engine", "event_id", "ts")
    path, out = shared_folder(spark), shared_folder(spark)
    low, high = (F.lit(x) for x in f.agg(F.expr("percentile_approx(unix_micros(ts), array(0.3, 0.31))")).first()[0])
    at = F.unix_micros("ts")
    with detections.rocksdb(spark):
        for part in (at <= low, (at > low) & (at <= high), at > high):
            f.where(part).coalesce(1).write.mode("append").parquet(path)
            new = spark.readStream.schema(f.schema).parquet(path)
            detections.finished(detections.stream_batches(new, 16, ["engine"], ["ts", "event_id"]), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("engine", "event_id", "batch", "slot")


@query(sql("SELECT CAST(k AS BIGINT) AS k, engine, CAST(items AS BIGINT) AS items, round(total, 2) AS total, rate FROM (SELECT k, engine, sum(n) OVER w AS items, sum(t) OVER w AS total, n / 3600e0 AS rate FROM (SELECT epoch_us(ts) // 3600000000 AS k, engine, count(*) AS n, sum(latency) AS t FROM frames GROUP BY ALL) WINDOW w AS (PARTITION BY engine ORDER BY k))", "frames"))
def rates_by_window(spark, d):
    """Rates of an hour and running totals by engine, as the live report has them."""
    rates = metrics.replay_frame(views.frames(spark, d), 3600.0)
    return rates.select("k", "engine", "items", F.round(F.col("mean_time") * F.col("items"), 2).alias("total"), "rate")


@query(sql("SELECT vec_id, CAST(a AS BIGINT) AS anchor, CAST(tensor[(a % 64) + 1] AS DOUBLE) AS cx, CAST(tensor[(448 + a) % 64 + 1] AS DOUBLE) AS cy, CAST(tensor[(4 * 448 + a) % 64 + 1] AS DOUBLE) AS confidence FROM t, range(448) x(a) WHERE tensor[(4 * 448 + a) % 64 + 1] >= CAST(0.3 AS FLOAT)", t="SELECT vec_id, embedding AS tensor FROM embeddings"))
def packed_decode(spark, d):
    """Tensors of 448 anchors as bytes: the threshold is put to whole batches before any row is made."""
    t = views.table(spark, d, "embeddings").select("vec_id", tensor_ops.pack(F.flatten(F.array_repeat("embedding", 35))).alias("tensor"))
    found = tensor_ops.decode_any(t, "tensor", 448, threshold=0.3)
    return found.select("vec_id", "anchor", *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "confidence")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'WARN' WHEN 1 THEN 'STATS' ELSE 'ERROR' END AS level, event_type AS component FROM events WHERE event_id % 4 <> 3")
def log_roundtrip(spark, d):
    """A log is written from events at WARN and above, with statistics in any case, and read again."""
    k = F.col("event_id") % 4
    level = F.when(k == 0, "WARN").when(k == 1, "STATS").when(k == 2, "ERROR").otherwise("INFO")
    path = shared_folder(spark)
    logs.write_log(views.table(spark, d, "events").select("ts", level.alias("level"), F.col("event_type").alias("component"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit("\n"), F.col("props")).alias("message")), path, "WARN")
    back = logs.parse_log(spark.read.text(path))
    return back.select(F.regexp_extract("message", r"event (\d+) \{", 1).cast("long").alias("event_id"), "ts", "level", "component")


PIXELS = "SELECT vec_id, list_transform(embedding[1:24], lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 4096) AS BIGINT) % 256) AS b FROM embeddings"


@query(f"SELECT vec_id, CAST(o AS BIGINT) AS pos, CASE WHEN (o % 16) // 4 BETWEEN 1 AND 2 THEN round(b[((o % 16) // 4 - 1) * 12 + (o % 4) * 3 + (2 - o // 16) + 1] / 255e0, 5) ELSE 0e0 END AS v FROM ({PIXELS}), range(48) x(o)")
def letterbox_pixels(spark, d):
    """Pictures of 4 x 2 BGR pixels in an input of 4 x 4: channels in planes and turned round, rows of padding above and below."""
    e = F.slice("embedding", 1, 24)
    byte = F.transform(e, lambda x: F.lpad(F.hex((F.floor(F.abs(x.cast("double")) * 4096) % 256).cast("long")), 2, "0"))
    t = views.table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(byte, "")).alias("image"))
    boxed = models.letterbox(F.col("image"), F.lit(4), F.lit(2), 4, 4)
    return t.select("vec_id", F.posexplode(boxed).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query(sql("SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(CAST(tensor[p + 1] AS FLOAT) AS DOUBLE) * 2 AS v, ['x', 'float', 'y'] AS names FROM x", "tensors", x="SELECT vec_id, tensor, unnest(range(64)) AS p FROM tensors").replace("['x', 'float', 'y']", "'x tensor(float) y'"))
def onnx_predict(spark, d):
    """A model file that adds its input to itself, written to the shared folder and run by the runtime in each worker; and what its graph says."""
    folder = local_folder(shared_folder(spark))
    os.makedirs(folder)
    with open(f"{folder}/model.onnx", "wb") as f:
        f.write(models.adding_model(64))
    graph = models.onnx_graph(f"{folder}/model.onnx")
    names = f"{graph['inputs'][0][0]} {graph['inputs'][0][2]} {graph['outputs'][0][0]}"
    t = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("tensor"))
    out = models.infer(t, "tensor", models.onnx_model(f"{folder}/model.onnx"), 16, [64])
    return out.select("vec_id", F.posexplode("output").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"), F.lit(names).alias("names"))
