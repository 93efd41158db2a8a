"""Queries over the detection operators, by name, and their DuckDB SQL.

Every query takes (spark, sf_dir) and reads whole tables.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import scalars as S
from framelake.operators import batching, detect, frames, matching, models, nms, stats, tensors
from framelake.plans import views
from framelake.plans.registry import ORACLE, QUERIES, query, rounded
from framelake.plans.views import sql
from framelake.schemas import KEYPOINT_NAMES, SKELETON
from framelake.sources import logs, manifest
from framelake.sources.folders import shared_folder
from framelake.streaming.stats import windowed_stats

BOX = ("cx", "cy", "w", "h")


def box() -> tuple:
    return tuple(F.col(c) for c in BOX)


# Detections: filter, boxes, overlap, suppression

AREA, X1, X2, Y1, Y2 = "({0}.w * {0}.h)", "({0}.cx - {0}.w / 2)", "({0}.cx + {0}.w / 2)", "({0}.cy - {0}.h / 2)", "({0}.cy + {0}.h / 2)"


def iou_sql(a: str, b: str) -> str:
    f = lambda t, s: t.format(s)
    ix = f"greatest(0e0, least({f(X2, a)}, {f(X2, b)}) - greatest({f(X1, a)}, {f(X1, b)}))"
    iy = f"greatest(0e0, least({f(Y2, a)}, {f(Y2, b)}) - greatest({f(Y1, a)}, {f(Y1, b)}))"
    union = f"({f(AREA, a)} + {f(AREA, b)} - {ix} * {iy})"
    return f"(CASE WHEN {union} <= 0 THEN 0e0 ELSE {ix} * {iy} / {union} END)"


def nms_sql(source: str, threshold: str, keys: str = "frame", before: int = 5000, after: int = 300) -> str:
    """A fold over each group's boxes in order of confidence."""
    s = "{'anchor': anchor, 'cx': cx, 'cy': cy, 'w': w, 'h': h, 'confidence': confidence}"
    fold = f"list_reduce(list_transform(d, lambda e: [e]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {iou_sql('y', 'x[1]')} > {threshold})) > 0 THEN acc ELSE list_concat(acc, x) END)"
    return f"SELECT {keys}, {fold}[1:{after}] AS kept FROM (SELECT {keys}, list({s} ORDER BY confidence DESC, anchor)[1:{before}] AS d FROM {source} GROUP BY {keys})"


KEPT = "SELECT frame, unnest(kept) AS r FROM folded"
CONF = "SELECT * FROM anchors WHERE confidence >= 0.2e0"


@query(sql("SELECT frame, anchor, cx, cy, w, h, confidence FROM anchors WHERE confidence >= 0.2e0", "anchors"))
def conf_filter(spark, d):
    return nms.confidence_filter(views.anchors(spark, d), 0.2).drop("flag")


@query(sql("SELECT frame, anchor, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, w * h AS area FROM anchors", "anchors"))
def cxcywh_to_xyxy(spark, d):
    x = G.cxcywh_to_xyxy(*box())
    return views.anchors(spark, d).select("frame", "anchor", *(c.alias(n) for c, n in zip(x, ("x1", "y1", "x2", "y2"), strict=True)), G.area(F.col("w"), F.col("h")).alias("area"))


@query(sql("SELECT frame, anchor, (cx - w / 2 + (cx + w / 2)) / 2 AS cx, (cy - h / 2 + (cy + h / 2)) / 2 AS cy, greatest(0e0, cx + w / 2 - (cx - w / 2)) AS w, greatest(0e0, cy + h / 2 - (cy - h / 2)) AS h FROM anchors", "anchors"))
def xyxy_roundtrip(spark, d):
    back = G.xyxy_to_cxcywh(*G.cxcywh_to_xyxy(*box()))
    return views.anchors(spark, d).select("frame", "anchor", *(c.alias(n) for c, n in zip(back, BOX, strict=True)))


@query(sql(f"SELECT a.frame, a.anchor AS a, b.anchor AS b, {iou_sql('a', 'b')} AS iou FROM anchors a JOIN anchors b ON a.frame = b.frame AND a.anchor < b.anchor WHERE {iou_sql('a', 'b')} > 0.3e0", "anchors"))
def iou_pairs(spark, d):
    return nms.overlapping_pairs(views.anchors(spark, d).drop("flag"), ["frame"], 0.3)


@query(sql(f"SELECT a.crowd, a.anchor AS a, b.anchor AS b, {iou_sql('a', 'b')} AS iou FROM crowd a JOIN crowd b ON a.crowd = b.crowd AND a.anchor < b.anchor WHERE {iou_sql('a', 'b')} > 0.3e0", "anchors", crowd="SELECT frame % 40 AS crowd, frame * 8 + anchor AS anchor, confidence * 1000 * 40 + cx AS cx, cy, w, h FROM anchors"))
def iou_pairs_crowd(spark, d):
    """Groups of very many boxes, spread over a wide picture: the grid compares neighbours only."""
    a = views.anchors(spark, d)
    crowd = a.select((F.col("frame") % 40).alias("crowd"), (F.col("frame") * 8 + F.col("anchor")).alias("anchor"), (F.col("confidence") * 1000 * 40 + F.col("cx")).alias("cx"), "cy", "w", "h")
    return nms.overlapping_pairs(crowd, ["crowd"], 0.3)


_EPS = iou_sql("a", "b").split(" ELSE ")[1].removesuffix(" END)")


@query(sql(f"SELECT a.frame, a.anchor AS a, b.anchor AS b, {_EPS.rsplit(' / ', 1)[0]} / ({_EPS.rsplit(' / ', 1)[1]} + 1e-6) AS iou FROM anchors a JOIN anchors b ON a.frame = b.frame AND a.anchor + 1 = b.anchor", "anchors"))
def iou_with_epsilon(spark, d):
    """Overlap of neighbouring anchors by the formula that adds a small number to the union and tests nothing."""
    a, b = (views.anchors(spark, d).select("frame", F.col("anchor").alias(n), F.struct(*BOX).alias(f"box_{n}")) for n in "ab")
    both = a.join(b, (a["frame"] == b["frame"]) & (F.col("a") + 1 == F.col("b"))).drop(b["frame"])
    return both.select("frame", "a", "b", G.iou(G.field_box(F.col("box_a")), G.field_box(F.col("box_b")), 1e-6).alias("iou"))


def _kept(spark, d, threshold=0.3, strategy="native", **caps):
    rows = nms.confidence_filter(views.anchors(spark, d).drop("flag"), 0.2)
    return nms.nms(rows, ["frame"], threshold, strategy, **caps)


@query(sql("SELECT frame, r.anchor AS anchor, r.confidence AS confidence FROM kept", "anchors", chosen=CONF, folded=nms_sql("chosen", "0.3e0"), kept=KEPT))
def nms_greedy(spark, d):
    return _kept(spark, d).select("frame", "anchor", "confidence")


@query(ORACLE["nms_greedy"])
def nms_greedy_arrow(spark, d):
    return _kept(spark, d, strategy="arrow").select("frame", "anchor", "confidence")


@query(sql("SELECT frame, r.anchor AS anchor FROM kept", "anchors", chosen=CONF, folded=nms_sql("chosen", "0.1e0", before=5, after=2), kept=KEPT))
def nms_topk_capped(spark, d):
    return _kept(spark, d, 0.1, before=5, after=2).select("frame", "anchor")


@query(sql("SELECT frame, CAST(count(*) AS BIGINT) AS n, max(r.confidence) AS max_conf FROM kept GROUP BY frame", "anchors", chosen=CONF, folded=nms_sql("chosen", "0.3e0"), kept=KEPT))
def detections_per_frame(spark, d):
    return _kept(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.max("confidence").alias("max_conf"))


ENGINE_BOX = "SELECT e.engine, a.frame, a.anchor, a.cx, a.cy, a.w, a.h, CAST(e.input_width AS DOUBLE) AS iw, CAST(e.input_height AS DOUBLE) AS ih, least(e.input_width / 1920e0, e.input_height / 1080e0) AS s FROM anchors a CROSS JOIN engines e"


def _engine_boxes(spark, d):
    e = views.engines(spark).select("engine", F.col("input_width").cast("double").alias("iw"), F.col("input_height").cast("double").alias("ih"))
    return frames.fan_out(views.anchors(spark, d), e)


def _original(spark, d, **kw):
    ow, oh = F.lit(1920.0), F.lit(1080.0)
    new = G.to_original(box(), ow, oh, F.col("iw"), F.col("ih"), **kw)
    return _engine_boxes(spark, d).select("engine", "frame", "anchor", *(c.alias(n) for c, n in zip(new, BOX, strict=True)))


def _native_sql(dx: str = "", dy: str = "", mx: str = "999999e0", my: str = "999999e0") -> str:
    part = lambda v, p, hi: f"least(greatest({v.format(p)}, 0e0), {hi})"
    return f"SELECT engine, frame, anchor, {part('(cx - (iw - 1920e0 * s) / 2) / s' + dx, '', mx)} AS cx, {part('(cy - (ih - 1080e0 * s) / 2) / s' + dy, '', my)} AS cy, {part('w / s', '', mx)} AS w, {part('h / s', '', my)} AS h FROM b"


@query(sql(_native_sql(" + 0", " + 0"), "anchors", "engines", b=ENGINE_BOX))
def inverse_letterbox(spark, d):
    return _original(spark, d)


@query(sql(_native_sql(" + 100e0", " + 50e0", "2000e0", "1100e0"), "anchors", "engines", b=ENGINE_BOX))
def roi_offset_clamp(spark, d):
    return _original(spark, d, dx=F.lit(100.0), dy=F.lit(50.0), tw=F.lit(2000.0), th=F.lit(1100.0))


def _corner_sql(cut: str, px: str, py: str) -> str:
    c = lambda v, p, hi: f"least(greatest({cut.format(f'({v} - {p}) / s')}, 0e0), {hi})"
    corners = f"SELECT engine, frame, anchor, {c('(cx - w / 2)', px, '1920e0')} AS x1, {c('(cy - h / 2)', py, '1080e0')} AS y1, {c('(cx + w / 2)', px, '1920e0')} AS x2, {c('(cy + h / 2)', py, '1080e0')} AS y2 FROM b"
    return sql("SELECT engine, frame, anchor, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(0e0, x2 - x1) AS w, greatest(0e0, y2 - y1) AS h FROM c", "anchors", "engines", b=ENGINE_BOX, c=corners)


@query(_corner_sql("{0}", "(iw - 1920e0 * s) / 2", "(ih - 1080e0 * s) / 2"))
def corner_clamp_variant(spark, d):
    return _original(spark, d, geometry="corner")


@query(_corner_sql("CAST(trunc({0}) AS DOUBLE)", "trunc((iw - trunc(1920e0 * s)) / 2)", "trunc((ih - trunc(1080e0 * s)) / 2)"))
def int_box_variant(spark, d):
    return _original(spark, d, geometry="int")


SIZED = "SELECT p_partkey, engine, input_width AS iw, input_height AS ih, 320 + p_partkey % 3000 AS ow, 240 + p_size * 40 AS oh, least(input_width / CAST(320 + p_partkey % 3000 AS DOUBLE), input_height / CAST(240 + p_size * 40 AS DOUBLE)) AS scale FROM part, engines"


@query(sql("SELECT p_partkey, engine, scale, CAST(trunc(ow * scale) AS INTEGER) AS nw, CAST(trunc(oh * scale) AS INTEGER) AS nh, CAST((iw - CAST(trunc(ow * scale) AS INTEGER)) // 2 AS INTEGER) AS px, CAST((ih - CAST(trunc(oh * scale) AS INTEGER)) // 2 AS INTEGER) AS py FROM sized", "engines", sized=SIZED))
def letterbox_geometry(spark, d):
    """How pictures of many sizes lie in each engine's input."""
    p = views.table(spark, d, "part").select("p_partkey", (320 + F.col("p_partkey") % 3000).cast("double").alias("ow"), (240 + F.col("p_size") * 40).cast("double").alias("oh"))
    parts = G.letterbox(F.col("ow"), F.col("oh"), F.col("input_width"), F.col("input_height"))
    return frames.fan_out(p, views.engines(spark)).select("p_partkey", "engine", *(c.alias(n) for c, n in zip(parts, ("scale", "nw", "nh", "px", "py"), strict=True)))


CUT = "CAST(least(greatest(trunc({v}), 0), {hi} - 1) AS INTEGER)"
DRAW = sql(
    "SELECT frame, anchor, " + ", ".join(f"{CUT.format(v=v, hi=hi)} AS {n}" for n, v, hi in (("x1", "cx - w / 2", 1920), ("y1", "cy - h / 2", 1080), ("x2", "cx + w / 2", 1920), ("y2", "cy + h / 2", 1080))) + ", printf('Class %d (%d%%)', 0, CAST(trunc(confidence * 100) AS INTEGER)) AS label, CAST(anchor % 8 AS BIGINT) AS colour FROM n", "anchors",
    n="SELECT frame, anchor, confidence, CASE WHEN cx <= 1 AND cy <= 1 AND w <= 1 AND h <= 1 THEN cx * 1920 ELSE cx END AS cx, CASE WHEN cx <= 1 AND cy <= 1 AND w <= 1 AND h <= 1 THEN cy * 1080 ELSE cy END AS cy, CASE WHEN cx <= 1 AND cy <= 1 AND w <= 1 AND h <= 1 THEN w * 1920 ELSE w END AS w, CASE WHEN cx <= 1 AND cy <= 1 AND w <= 1 AND h <= 1 THEN h * 1080 ELSE h END AS h FROM anchors",
)


@query(DRAW)
def draw_boxes(spark, d):
    corners = G.draw_box(box(), F.lit(1920), F.lit(1080))
    return views.anchors(spark, d).select("frame", "anchor", *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)), G.box_label(F.lit(0), F.col("confidence")).alias("label"), G.palette_index(F.col("anchor")).alias("colour"))


UNIT = "(cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)"


@query(sql(f"SELECT frame, anchor, {UNIT} AS is_normalised, (cx > 100 OR cy > 100 OR w > 100 OR h > 100) AS is_pixel_like, confidence BETWEEN 0 AND 1 AS conf_in_range, (w <= 0 OR h <= 0) AS is_invalid, CASE WHEN {UNIT} THEN cx * 1920 ELSE cx END AS full_hd_x, CASE WHEN {UNIT} THEN cy * 1080 ELSE cy END AS full_hd_y FROM anchors", "anchors"))
def box_diagnostics(spark, d):
    flags = G.box_diagnostics(*box(), F.col("confidence"))
    return views.anchors(spark, d).select("frame", "anchor", *(c.alias(n) for n, c in flags.items()))


# Frames, clips, batches


@query(sql("SELECT f.video_id, f.pos, f.event_id, e.engine, CAST(e.input_width AS BIGINT) AS input_width FROM frames f CROSS JOIN engines e", "frames", "engines"))
def frame_engine_fanout(spark, d):
    e = views.engines(spark).select("engine", F.col("input_width").cast("long").alias("input_width"))
    return frames.fan_out(views.frames(spark, d).select("video_id", "pos", "event_id"), e)


@query(sql("SELECT f.event_id, f.pos, a.anchor, a.confidence FROM frames f LEFT JOIN anchors a ON f.event_id + 1 = a.frame", "frames", "anchors"))
def frame_left_detections(spark, d):
    f, a = views.frames(spark, d).select("event_id", "pos"), views.anchors(spark, d).select("frame", "anchor", "confidence")
    return frames.with_detections(f, a, "event_id", "frame").select("event_id", "pos", "anchor", "confidence")


ROI_OK = "x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x2 BETWEEN 0 AND 1 AND y2 BETWEEN 0 AND 1 AND x1 < x2 AND y1 < y2"
RX1, RY1 = "least(greatest(trunc(x1 * 1920), 0), 1919)", "least(greatest(trunc(y1 * 1080), 0), 1079)"


@query(sql(f"SELECT f.event_id, f.video_id, px1, py1, px2, py2 FROM frames f JOIN r USING (video_id)", "frames", "clips", r=f"SELECT video_id, CASE WHEN {ROI_OK} THEN CAST({RX1} AS INTEGER) END AS px1, CASE WHEN {ROI_OK} THEN CAST({RY1} AS INTEGER) END AS py1, CASE WHEN {ROI_OK} THEN CAST(least(greatest(trunc(x2 * 1920), {RX1} + 1), 1920) AS INTEGER) END AS px2, CASE WHEN {ROI_OK} THEN CAST(least(greatest(trunc(y2 * 1080), {RY1} + 1), 1080) AS INTEGER) END AS py2 FROM clips"))
def roi_lookup(spark, d):
    c = views.clips(spark, d).select("video_id", "x1", "y1", "x2", "y2")
    return frames.with_roi(views.frames(spark, d).select("event_id", "video_id"), c, F.lit(1920), F.lit(1080)).select("event_id", "video_id", "px1", "py1", "px2", "py2")


SCAN = "SELECT f.event_id, f.video_id, f.pos, c.moment, 2e0 AS fps, c.moment + (c.duration % 7) AS start_ts, c.moment + 40 AS end_ts, c.moment + (f.pos + 1) / 2e0 AS frame_ts FROM frames f JOIN clips c USING (video_id)"


def _clocked(spark, d):
    c = views.clips(spark, d).select("video_id", "moment", F.lit(2.0).alias("fps"), (F.col("moment") + F.col("duration") % 7).alias("start_ts"), (F.col("moment") + 40).alias("end_ts"))
    return views.frames(spark, d).select("event_id", "video_id", "pos").join(c, "video_id")


@query(sql("SELECT event_id, video_id, pos, frame_ts FROM s WHERE frame_ts BETWEEN start_ts AND end_ts AND pos >= CASE WHEN start_ts > moment THEN floor((start_ts - moment) * fps) ELSE 0 END", "frames", "clips", s=SCAN))
def time_window_scan(spark, d):
    return frames.window_scan(_clocked(spark, d)).select("event_id", "video_id", "pos", "frame_ts")


@query(sql("SELECT video_id, CAST(count(*) AS BIGINT) AS by_filter, CAST(count(*) FILTER (WHERE pos >= CASE WHEN start_ts > moment THEN floor((start_ts - moment) * fps) ELSE 0 END) AS BIGINT) AS by_seek FROM s WHERE frame_ts BETWEEN start_ts AND end_ts GROUP BY video_id", "frames", "clips", s=SCAN))
def seek_vs_filter(spark, d):
    rows = _clocked(spark, d)
    clock = S.frame_clock(F.col("moment"), F.col("pos"), F.col("fps"))
    plain = rows.where(clock.between(F.col("start_ts"), F.col("end_ts"))).groupBy("video_id").agg(F.count("*").alias("by_filter"))
    seek = frames.window_scan(rows).groupBy("video_id").agg(F.count("*").alias("by_seek"))
    return plain.join(seek, "video_id", "left").select("video_id", "by_filter", F.coalesce("by_seek", F.lit(0)).alias("by_seek"))


FPS = "CASE WHEN x1 * 60 > 0.1 THEN x1 * 60 WHEN duration > 0 AND CAST(y1 * 1000 AS BIGINT) / duration > 0.1 THEN CAST(y1 * 1000 AS BIGINT) / duration WHEN x1 * 60 > 0 THEN x1 * 60 ELSE 30e0 END"


@query(sql(f"SELECT video_id, {FPS} AS fps FROM clips", "clips"))
def fps_resolve(spark, d):
    return views.clips(spark, d).select("video_id", S.resolve_fps(F.col("x1") * 60, F.round(F.col("y1") * 1000).cast("long"), F.col("duration")).alias("fps"))


@query(sql("SELECT video_id, pos, event_id FROM frames WHERE pos < 32", "frames"))
def frame_cap_per_video(spark, d):
    return frames.cap_per_video(views.frames(spark, d).select("video_id", "pos", "event_id"), 32)


@query(sql("SELECT video_id, pos, event_id FROM frames ORDER BY video_id, pos LIMIT 500", "frames"))
def global_cap(spark, d):
    return frames.global_cap(views.frames(spark, d).select("video_id", "pos", "event_id"), 500)


@query(sql("SELECT video_id, pos, event_id FROM frames WHERE pos >= 5 AND pos < 25", "frames"))
def frame_range(spark, d):
    return frames.frame_range(views.frames(spark, d).select("video_id", "pos", "event_id"), 5, 25, inclusive=False)


NUMBERED = "SELECT engine, event_id, row_number() OVER (PARTITION BY engine ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY engine) AS n FROM frames"


def _batched(spark, d, tail):
    return batching.batches(views.frames(spark, d).select("engine", "event_id", "ts"), 16, ["engine"], ["ts", "event_id"], tail).drop("ts")


@query(sql("SELECT engine, event_id, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS BIGINT) AS slot FROM m WHERE (i // 16 + 1) * 16 <= n", "frames", m=NUMBERED))
def batch_full_only(spark, d):
    return _batched(spark, d, "drop")


@query(sql("SELECT engine, event_id, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS BIGINT) AS slot FROM m", "frames", m=NUMBERED))
def batch_pad_tail(spark, d):
    return _batched(spark, d, "pad")


@query(sql("SELECT engine, event_id, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS BIGINT) AS slot, false AS is_copy FROM m UNION ALL SELECT engine, event_id, CAST(i // 16 AS BIGINT), CAST(s AS BIGINT), true FROM m, range(16) t(s) WHERE i = n - 1 AND s > i % 16", "frames", m=NUMBERED))
def batch_repeat_tail(spark, d):
    return _batched(spark, d, "repeat")


@query(sql("SELECT DISTINCT f.video_id, e.engine, printf('video_%04d_%s.bin', f.video_id, e.engine) AS path FROM frames f CROSS JOIN engines e", "frames", "engines"))
def output_path(spark, d):
    v = views.frames(spark, d).select("video_id").distinct()
    return frames.fan_out(v, views.engines(spark).select("engine")).select("video_id", "engine", S.output_path(F.col("video_id"), F.col("engine")).alias("path"))


# Tensors

POS = "SELECT vec_id, tensor, unnest(range(64)) AS p FROM tensors"


@query(sql("SELECT vec_id, CAST(p // 32 AS BIGINT) AS item, CAST(p % 32 AS BIGINT) AS pos, tensor[p + 1] AS v FROM x", "tensors", x=POS))
def tensor_slice(spark, d):
    t = views.tensors(spark, d).withColumn("item", F.explode(F.array(F.lit(0), F.lit(1))))
    return t.select("vec_id", F.col("item").cast("long").alias("item"), F.posexplode(tensors.batch_slice(F.col("tensor"), F.col("item"), 4, 8)).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


@query(sql("SELECT vec_id, CAST(a AS BIGINT) AS anchor, tensor[a + 1] AS c0, tensor[a + 17] AS c1, tensor[a + 33] AS c2, tensor[a + 49] AS c3 FROM tensors, range(16) t(a)", "tensors"))
def tensor_transpose(spark, d):
    rows = views.tensors(spark, d).select("vec_id", F.posexplode(tensors.to_anchor_rows(F.col("tensor"), 4, 16)).alias("anchor", "r"))
    return rows.select("vec_id", F.col("anchor").cast("long").alias("anchor"), *(F.get("r", F.lit(c)).alias(f"c{c}") for c in range(4)))


@query(sql("SELECT vec_id, CAST(a AS BIGINT) AS anchor, tensor[a + 1] AS cx, tensor[a + 13] AS cy, tensor[a + 25] AS w, tensor[a + 37] AS h, tensor[a + 49] AS confidence, 0 AS class_id FROM tensors, range(12) t(a) WHERE tensor[a + 49] >= CAST(CAST(0.05e0 AS FLOAT) AS DOUBLE)", "tensors"))
def decode_detection(spark, d):
    return tensors.decode_frames(views.tensors(spark, d), "tensor", 12, threshold=0.05)


# A pose of 17 keypoints has 56 channels: one anchor of 56 of the 64 values.
POINTS = "SELECT vec_id, k, tensor[6 + 3 * k] * 4 AS x, tensor[7 + 3 * k] * 4 AS y, tensor[8 + 3 * k] * 4 AS raw FROM tensors, range(17) t(k)"
NORM = "CASE WHEN raw > 1 THEN least(1e0, greatest(0e0, raw / 255)) ELSE raw END"


def _poses(spark, d):
    t = views.tensors(spark, d).withColumn("tensor", F.transform("tensor", lambda v: v * 4))
    return tensors.decode_frames(t, "tensor", 1, 17)


@query(sql(f"SELECT vec_id, CAST(k AS BIGINT) AS k, x, y, {NORM} AS confidence FROM p", "tensors", p=POINTS))
def decode_keypoints(spark, d):
    return _poses(spark, d).select("vec_id", F.posexplode("keypoints").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), "p.*")


@query(sql("SELECT vec_id, CAST(p AS BIGINT) AS pos, CASE WHEN v > 1 THEN least(1e0, greatest(0e0, v / 255)) ELSE v END AS confidence FROM (SELECT vec_id, p, tensor[p + 1] * 10 AS v FROM x)", "tensors", x=POS))
def keypoint_conf_norm(spark, d):
    v = views.tensors(spark, d).select("vec_id", F.posexplode("tensor").alias("pos", "v"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), G.keypoint_confidence(F.col("v") * 10).alias("confidence"))


@query(sql(f"SELECT vec_id, CAST(count(*) FILTER (WHERE {NORM} > 0.1) AS BIGINT) AS n_01, CAST(count(*) FILTER (WHERE {NORM} > 0.3) AS BIGINT) AS n_03 FROM p GROUP BY vec_id", "tensors", p=POINTS))
def visible_keypoints(spark, d):
    return _poses(spark, d).select("vec_id", F.size(G.visible(F.col("keypoints"), 0.1)).cast("long").alias("n_01"), F.size(G.visible(F.col("keypoints"), 0.3)).cast("long").alias("n_03"))


EDGES = "SELECT unnest([" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in SKELETON) + "]) AS e"


@query(sql("SELECT p.vec_id, CAST(e.a AS BIGINT) AS a, CAST(e.b AS BIGINT) AS b, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM edges JOIN n p ON p.k = e.a JOIN n q ON q.k = e.b AND p.vec_id = q.vec_id WHERE p.c > 0.1 AND q.c > 0.1", "tensors", p0=POINTS, n=f"SELECT vec_id, k, x, y, {NORM} AS c FROM p0", edges=EDGES))
def skeleton_segments(spark, d):
    return _poses(spark, d).select("vec_id", F.explode(G.skeleton_segments(F.col("keypoints"))).alias("s")).select("vec_id", F.col("s.a").cast("long").alias("a"), F.col("s.b").cast("long").alias("b"), "s.x1", "s.y1", "s.x2", "s.y2")


@query(sql("SELECT vec_id, round(min(1 / (1 + exp(-v))), 6) AS min, round(max(1 / (1 + exp(-v))), 6) AS max, round(avg(1 / (1 + exp(-v))), 6) AS mean FROM (SELECT vec_id, tensor[p + 1] AS v FROM x) GROUP BY vec_id", "tensors", x=POS))
def sigmoid_profile(spark, d):
    v = views.tensors(spark, d).select("vec_id", F.explode("tensor").alias("v")).withColumn("s", G.sigmoid(F.col("v")))
    return rounded(tensors.profile(v, ["vec_id"], "s").select("vec_id", "min", "max", "mean"), "min", "max", "mean")


@query(sql("SELECT vec_id, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(count(*) FILTER (WHERE v <> 0) AS BIGINT) AS nonzero, CAST(count(*) FILTER (WHERE v > 0.01e0) AS BIGINT) AS over_0_01, CAST(count(*) FILTER (WHERE v > 0.1e0) AS BIGINT) AS over_0_1, CAST(count(*) FILTER (WHERE v > 0.2e0) AS BIGINT) AS over_0_2 FROM (SELECT vec_id, tensor[p + 1] AS v FROM x) GROUP BY vec_id", "tensors", x=POS))
def conf_profile(spark, d):
    v = views.tensors(spark, d).select("vec_id", F.explode("tensor").alias("v"))
    return rounded(tensors.profile(v, ["vec_id"], "v"), "mean", "std")


@query(sql("SELECT frame, anchor, confidence FROM anchors ORDER BY confidence DESC, frame DESC, anchor DESC LIMIT 20", "anchors"))
def topk_anchor(spark, d):
    return tensors.top_confidence(views.anchors(spark, d).select("frame", "anchor", "confidence"), 20, ties=("frame", "anchor"))


DIFF = "SELECT a.vec_id, p, a.tensor[p + 1] AS a, b.tensor[p + 1] AS b, a.tensor[p + 1] - b.tensor[p + 1] AS diff FROM x a JOIN tensors b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, d):
    t = views.tensors(spark, d)
    return t, t.select((F.col("vec_id") - 1).alias("vec_id"), "tensor")


@query(sql("SELECT vec_id, CAST(count(*) AS BIGINT) AS n, max(abs(diff)) AS max_abs, round(avg(abs(diff)), 6) AS mean_abs, round(sqrt(avg(diff * diff)), 6) AS rms, CAST(count(*) FILTER (WHERE abs(diff) > 0.1e0) AS BIGINT) AS n_over, count(*) FILTER (WHERE abs(diff) > 0.1e0) / CAST(count(*) AS DOUBLE) AS share_over FROM y GROUP BY vec_id", "tensors", x=POS, y=DIFF))
def tensor_diff(spark, d):
    return rounded(tensors.tensor_diff(*_neighbours(spark, d), ["vec_id"], 0.1), "mean_abs", "rms")


@query(sql("SELECT vec_id, CAST(p AS BIGINT) AS pos, a, b, diff, abs(diff) AS abs_diff, CAST(p // 16 % 4 AS BIGINT) AS dim0, CAST(p % 16 AS BIGINT) AS dim1 FROM y ORDER BY abs(diff) DESC, vec_id, p LIMIT 10", "tensors", x=POS, y=DIFF))
def tensor_topn_diff(spark, d):
    return tensors.tensor_topn(*_neighbours(spark, d), ["vec_id"], 10, [4, 16])


# Matching

_BOXES = "{'id': anchor, 'cx': cx, 'cy': cy, 'w': w, 'h': h}"
# Candidates of each left box by falling overlap, then the first unused one, box by box.
PAIRS = f"SELECT l.frame, l.anchor AS l, r.anchor AS r, {iou_sql('l', 'r')} AS iou FROM anchors l JOIN anchors r ON l.frame = r.frame AND l.flag = 'A' AND r.flag = 'R' WHERE {iou_sql('l', 'r')} >= 0.3e0"
CANDIDATES = "SELECT frame, l, list({'l': l, 'r': r, 'iou': iou} ORDER BY iou DESC, r) AS c FROM pairs GROUP BY frame, l"
_FREE = "list_filter(x, lambda z: NOT list_contains(list_transform(acc, lambda u: u.r), z.r))"
MATCH_FOLD = f"SELECT frame, list_reduce(list_prepend([{{'l': CAST(-1 AS BIGINT), 'r': CAST(-1 AS BIGINT), 'iou': -1e0}}], list(c ORDER BY l)), lambda acc, x: list_concat(acc, {_FREE}[1:1])) AS m FROM candidates GROUP BY frame"
MATCHES = "SELECT frame, e.l AS left_id, e.r AS right_id, e.iou AS iou FROM (SELECT frame, unnest(m) AS e FROM fold) WHERE e.l >= 0"
_MATCH = {"pairs": PAIRS, "candidates": CANDIDATES, "fold": MATCH_FOLD, "matches": MATCHES}


def _sides(spark, d):
    a = views.anchors(spark, d)
    return a.where("flag = 'A'").drop("flag"), a.where("flag = 'R'").drop("flag")


@query(sql("SELECT * FROM matches", "anchors", **_MATCH))
def greedy_match(spark, d):
    return matching.greedy_match(*_sides(spark, d), ["frame"], 0.3)


@query(
    sql(
        "SELECT CAST(count(*) AS BIGINT) AS frames, CAST(sum(nl) AS BIGINT) AS n_left, CAST(sum(nr) AS BIGINT) AS n_right, CAST(sum(nm) AS BIGINT) AS n_match, CASE WHEN sum(nr) > 0 THEN sum(nm) / CAST(sum(nr) AS DOUBLE) ELSE 0e0 END AS precision, CASE WHEN sum(nl) > 0 THEN sum(nm) / CAST(sum(nl) AS DOUBLE) ELSE 0e0 END AS recall FROM f", "anchors", **_MATCH,
        f="SELECT l.frame, l.n AS nl, coalesce(r.n, 0) AS nr, coalesce(m.n, 0) AS nm FROM (SELECT frame, count(*) AS n FROM anchors WHERE flag = 'A' GROUP BY frame) l LEFT JOIN (SELECT frame, count(*) AS n FROM anchors WHERE flag = 'R' GROUP BY frame) r USING (frame) LEFT JOIN (SELECT frame, count(*) AS n FROM matches GROUP BY frame) m USING (frame)",
    )
)
def match_metrics(spark, d):
    return matching.match_metrics(*_sides(spark, d), ["frame"], 0.3)


def _unmatched_sql(flag: str, side: str) -> str:
    return sql(f"SELECT frame, anchor, confidence FROM anchors a WHERE flag = '{flag}' AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.frame = a.frame AND m.{side}_id = a.anchor)", "anchors", **_MATCH)


@query(_unmatched_sql("A", "left"))
def unmatched_left(spark, d):
    left, right = _sides(spark, d)
    return matching.unmatched_boxes(left, right, ["frame"], "left", 0.3, rest=["confidence"]).select("frame", "anchor", "confidence")


@query(_unmatched_sql("R", "right"))
def unmatched_right(spark, d):
    left, right = _sides(spark, d)
    return matching.unmatched_boxes(left, right, ["frame"], "right", 0.3, rest=["confidence"]).select("frame", "anchor", "confidence")


# Statistics

RECORDS = "SELECT CAST(frame % 7 AS BIGINT) AS path, frame AS frame_number, CAST(count(*) FILTER (WHERE confidence >= 0.9e0) AS BIGINT) AS n FROM anchors GROUP BY frame"
SUMMARY = "SELECT path, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS with_detections, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS without_detections, CAST(sum(n) AS BIGINT) AS detections, min(frame_number) AS first_frame, max(frame_number) AS last_frame, max(frame_number) - min(frame_number) + 1 AS span FROM records GROUP BY path"


def _records(spark, d):
    """Orders are frames of seven files; boxes of low confidence make no detection."""
    rows = views.anchors(spark, d).select((F.col("frame") % 7).alias("path"), F.col("frame").alias("frame_number"), F.when(F.col("confidence") >= 0.9, F.col("anchor")).alias("det_index"))
    return stats.frame_counts(rows, ["path", "frame_number"])


@query(sql("SELECT * FROM summary", "anchors", records=RECORDS, summary=SUMMARY))
def file_summary(spark, d):
    return stats.file_summary(_records(spark, d))


@query(sql("SELECT video_id, min(pos) AS first_frame, max(pos) AS last_frame, max(pos) - min(pos) + 1 AS span FROM frames GROUP BY video_id", "frames"))
def frame_span(spark, d):
    f = views.frames(spark, d).select("video_id", "pos", F.lit(1).alias("n"))
    return stats.file_summary(f, "video_id", "n", "pos").select("video_id", "first_frame", "last_frame", "span")


@query(sql("SELECT frame % 7 AS path, min(confidence) AS min_conf, max(confidence) AS max_conf, round(avg(confidence), 6) AS avg_conf, array_to_string(list_sort(list(DISTINCT flag)), ',') AS classes, CAST(count(DISTINCT flag) AS BIGINT) AS n_classes FROM anchors GROUP BY frame % 7", "anchors"))
def conf_stats(spark, d):
    a = views.anchors(spark, d).select((F.col("frame") % 7).alias("path"), "confidence", F.col("flag").alias("class_id"))
    return rounded(stats.confidence_summary(a, ["path"]), "avg_conf").withColumn("classes", F.array_join("classes", ","))


@query(sql("SELECT path, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(detections) AS BIGINT) AS detections, min(first_frame) AS first_frame, max(last_frame) AS last_frame FROM summary GROUP BY ROLLUP (path)", "anchors", records=RECORDS, summary=SUMMARY))
def cross_file_rollup(spark, d):
    return stats.rollup_summary(stats.file_summary(_records(spark, d)))


@query(sql("SELECT path, frame_number, n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY frame_number) AS r FROM records WHERE n > 0) WHERE r <= 5", "anchors", records=RECORDS))
def first_n_frames(spark, d):
    return stats.first_frames(_records(spark, d), "path", "frame_number")


@query(sql("SELECT path, frame_number, n, CASE WHEN a <= 10 THEN 'first' ELSE 'last' END AS edge FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY frame_number) AS a, row_number() OVER (PARTITION BY path ORDER BY frame_number DESC) AS b FROM records) WHERE a <= 10 OR b <= 10", "anchors", records=RECORDS))
def edge_frames(spark, d):
    return stats.edge_frames(_records(spark, d), "path", "frame_number")


def _stage_sql(key: str) -> str:
    done, ms = "latency < 95", "CASE WHEN latency < 95 THEN CAST(floor(latency) AS BIGINT) ELSE 0 END"
    return sql(f"SELECT {key}, CAST(count(*) FILTER (WHERE {done}) AS BIGINT) AS done, CAST(count(*) FILTER (WHERE NOT {done}) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE {done}) // 60 AS BIGINT) AS fps, CASE WHEN count(*) FILTER (WHERE {done}) > 0 THEN sum({ms}) / CAST(count(*) FILTER (WHERE {done}) AS DOUBLE) ELSE 0e0 END AS avg_ms, sum({ms}) / 1000e0 AS total_s FROM frames GROUP BY {key}", "frames")


@query(_stage_sql("engine"))
def engine_stats(spark, d):
    return stats.engine_stats(views.frames(spark, d).withColumn("failed", F.col("latency") >= 95), ["engine"], "latency", "failed", 60)


@query(_stage_sql("video_id"))
def reader_stats(spark, d):
    return stats.reader_stats(views.frames(spark, d).withColumn("failed", F.col("latency") >= 95), ["video_id"], "latency", "failed", 60)


@query(sql("SELECT frame, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE confidence >= 0.5e0) AS BIGINT) AS above, max(confidence) AS max_conf FROM anchors GROUP BY frame", "anchors"))
def parse_counters(spark, d):
    return stats.parse_counters(views.anchors(spark, d), ["frame"], 0.5)


@query(sql("SELECT v.video_id, e.engine, f.video_id IS NOT NULL AS complete FROM (SELECT DISTINCT video_id FROM frames) v CROSS JOIN (SELECT DISTINCT engine FROM frames) e LEFT JOIN (SELECT DISTINCT video_id, engine FROM frames) f ON f.video_id = v.video_id AND f.engine = e.engine", "frames"))
def file_completeness(spark, d):
    f = views.frames(spark, d)
    return stats.completeness(f, f, f.select("engine").distinct())


@query(sql("SELECT date_trunc('day', ts) AS window_start, engine, CAST(count(*) AS BIGINT) AS items, round(sum(latency), 4) AS total, max(latency) AS highest FROM frames GROUP BY ALL", "frames"))
def stats_tumbling(spark, d):
    out = rounded(windowed_stats(views.frames(spark, d), "1 day"), "total", digits=4)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(sql("SELECT video_id, engine, event_id, latency FROM frames QUALIFY row_number() OVER (PARTITION BY video_id, engine ORDER BY event_id DESC) = 1", "frames"))
def dedup_last(spark, d):
    return stats.keep_record(views.frames(spark, d).select("video_id", "engine", "event_id", "latency"), ["video_id", "engine"], "event_id")


@query(sql("SELECT video_id, engine, event_id, latency FROM frames WHERE latency > 50 QUALIFY row_number() OVER (PARTITION BY video_id, engine ORDER BY event_id DESC) = 1", "frames"))
def dedup_last_nonempty(spark, d):
    f = views.frames(spark, d).select("video_id", "engine", "event_id", "latency").withColumn("n", (F.col("latency") > 50).cast("int"))
    return stats.keep_record(f, ["video_id", "engine"], "event_id", "last_nonempty").drop("n")


# Manifests, text, time


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0e0) AS k_number, coalesce(TRY_CAST(event_type AS DOUBLE), 0e0) AS fallback FROM events")
def manifest_props_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return views.table(spark, d, "events").select("event_id", k.alias("k"), S.number_or(k).alias("k_number"), S.number_or(F.col("event_type")).alias("fallback"))


LISTS = "SELECT video_id, list(event_id ORDER BY pos) AS a, list(latency ORDER BY pos) FILTER (WHERE pos % 3 <> 0) AS b FROM frames GROUP BY video_id"


@query(sql("SELECT video_id, CAST(i - 1 AS BIGINT) AS place, a[i] AS record, b[i] AS location FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM l)", "frames", l=LISTS))
def zip_flatten(spark, d):
    f = views.frames(spark, d)
    a = F.transform(F.sort_array(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"])
    b = F.transform(F.sort_array(F.collect_list(F.when(F.col("pos") % 3 != 0, F.struct("pos", "latency")))), lambda x: x["latency"])
    lists = f.groupBy("video_id").agg(a.alias("record"), b.alias("location"))
    return manifest.zip_flatten(lists, "record", "location").withColumn("place", F.col("place").cast("long"))


@query("""SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN epoch_us(date_trunc('second', ts)) / 1e6 WHEN 1 THEN epoch_us(date_trunc('second', ts)) / 1e6
    WHEN 2 THEN epoch_us(date_trunc('second', ts)) / 1e6 - 25200 END AS epoch FROM events""")
def timestamp_parse(spark, d):
    """Numbers, Z, an offset of seven hours, and text that is no time."""
    e = views.table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.unix_seconds("t").cast("string"), F.lit(".0"))).when(kind == 1, F.concat(iso, F.lit("Z"))).when(kind == 2, F.concat(iso, F.lit("+07:00"))).otherwise(F.lit("soon"))
    return e.select("event_id", S.parse_epoch(text).alias("epoch"))


@query(sql("SELECT video_id, least(lo, hi) AS start_ts, greatest(lo, hi) AS end_ts FROM w", "clips", w="SELECT video_id, CASE WHEN duration < 100 THEN -1e300 ELSE moment + duration - 5 END AS lo, CASE WHEN duration > 500 THEN 1e300 ELSE moment + 200 + 5 END AS hi FROM clips"))
def window_normalise(spark, d):
    start = F.when(F.col("duration") >= 100, F.col("moment") + F.col("duration"))
    end = F.when(F.col("duration") <= 500, F.col("moment") + 200)
    lo, hi = S.time_window(start, end, 5.0)
    finite = lambda c: F.greatest(F.lit(-1e300), F.least(F.lit(1e300), c))
    return views.clips(spark, d).select("video_id", finite(lo).alias("start_ts"), finite(hi).alias("end_ts"))


@query("SELECT p_partkey, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, trim(p_name) AS path_trimmed FROM (SELECT p_partkey, p_name, CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN 'a/b.MP4' WHEN 1 THEN 'c.d/e' ELSE 'x.tar.JSONL' END AS path FROM part)")
def text_conversions(spark, d):
    path = F.when(F.col("p_partkey") % 3 == 0, "a/b.MP4").when(F.col("p_partkey") % 3 == 1, "c.d/e").otherwise("x.tar.JSONL")
    return views.table(spark, d, "part").select("p_partkey", S.extension(path).alias("ext"), S.trim_all(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n "))).alias("path_trimmed"))


@query("SELECT event_id, 'INFO' AS level, event_type AS component, props AS message FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'ERROR', event_type, props FROM events WHERE event_id % 6 = 1")
def log_parse(spark, d):
    """Lines are made of events; those below INFO are dropped."""
    level = F.when(F.col("event_id") % 2 == 0, "INFO").when(F.col("event_id") % 6 == 1, "ERROR").otherwise("DEBUG")
    lines = views.table(spark, d, "events").select(F.format_string("[%d] [%s] [%s] %s", "event_id", level, "event_type", "props").alias("value"))
    return logs.parse_log(lines, "INFO").select(F.col("ts").cast("long").alias("event_id"), "level", "component", "message")


@query("SELECT user_id AS model_type, CASE user_id WHEN 0 THEN 'DETECTION' WHEN 1 THEN 'POSE' ELSE printf('UNKNOWN(%d)', user_id) END AS name FROM (SELECT DISTINCT user_id FROM events)")
def model_type_names(spark, d):
    return views.table(spark, d, "events").select(F.col("user_id").alias("model_type")).distinct().select("model_type", S.model_type_name(F.col("model_type")).alias("name"))


@query(sql("SELECT vec_id, list_extract([" + ", ".join(f"'{n}'" for n in KEYPOINT_NAMES) + f"], CAST(k AS INTEGER) + 1) AS name, x, y, {NORM} AS confidence FROM p WHERE {NORM} > 0.1", "tensors", p=POINTS))
def keypoint_names(spark, d):
    """Visible keypoints of poses by name."""
    names = F.array(*map(F.lit, KEYPOINT_NAMES))
    return _poses(spark, d).select("vec_id", F.posexplode("keypoints").alias("k", "p")).where("p.confidence > 0.1").select("vec_id", F.get(names, F.col("k")).alias("name"), "p.*")


# Formats and models


@query(sql("SELECT CAST(frame % 7 AS INTEGER) AS file, CAST(frame AS INTEGER) AS frame_number, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(CAST(confidence AS FLOAT) AS DOUBLE)), 4) AS conf FROM anchors GROUP BY frame", "anchors"))
def detbin_roundtrip(spark, d):
    """Writes boxes as detection files in the shared folder, one for each seventh of the frames, and reads them back."""
    from framelake.sources import detbin

    path = shared_folder(spark)
    f32 = lambda c: F.col(c).cast("float").alias(c)
    points = F.array().cast("array<struct<x:float,y:float,confidence:float>>")
    rows = views.anchors(spark, d).select(S.output_path(F.col("frame") % 7, F.lit("det640")).alias("path"), F.lit(0).alias("model_type"), F.col("frame").cast("int").alias("frame_number"), (F.col("anchor") - 1).cast("int").alias("det_index"), *(f32(c) for c in (*BOX, "confidence")), F.lit(0).alias("class_id"), points.alias("keypoints"))
    detbin.write_detections(rows, path)
    back = detbin.read_detections(spark, path, "FAILFAST")
    return rounded(back.groupBy(F.regexp_extract("path", r"video_(\d+)_", 1).cast("int").alias("file"), "frame_number").agg(F.count("det_index").alias("n"), F.sum(F.col("confidence").cast("double")).alias("conf")), "conf", digits=4)


@query(sql("SELECT vec_id, CAST(o AS BIGINT) AS pos, CAST(CAST(list_sum(list_transform(range(8), lambda j: tensor[o + 1 + 8 * j])) AS FLOAT) AS DOUBLE) AS v FROM tensors, range(8) t(o)", "tensors"))
def batch_predict_stub(spark, d):
    t = views.tensors(spark, d).withColumn("tensor", F.col("tensor").cast("array<float>"))
    out = models.infer(t, "tensor", models.stub_model(2, 4), 16, [64])
    return out.select("vec_id", F.posexplode("output").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query(sql("SELECT vec_id, CAST(floor(i / 2) AS BIGINT) AS half, round(sum(v), 5) AS total FROM (SELECT vec_id, p // 16 AS i, tensor[p + 1] AS v FROM x) GROUP BY ALL", "tensors", x=POS))
def channel_sums(spark, d):
    t = views.tensors(spark, d)
    halves = [F.aggregate(tensors.batch_slice(F.col("tensor"), i, 2, 16), F.lit(0.0), lambda acc, v: acc + v) for i in (0, 1)]
    return rounded(t.select("vec_id", F.posexplode(F.array(*halves)).alias("half", "total")).withColumn("half", F.col("half").cast("long")), "total", digits=5)


def _framed(spark, d):
    """Poses with their points spread over a frame of 8 x 8 pixels around its middle."""
    return _poses(spark, d).withColumn("keypoints", F.transform("keypoints", lambda p: F.struct((p["x"] * 10 + 4).alias("x"), (p["y"] * 10 + 4).alias("y"), p["confidence"].alias("confidence"))))


SPREAD = f"SELECT vec_id, k, x * 10 + 4 AS x, y * 10 + 4 AS y, {NORM} AS c FROM p0"
INSIDE = "trunc({0}.x) BETWEEN 0 AND 7 AND trunc({0}.y) BETWEEN 0 AND 7"


@query(sql(f"SELECT p.vec_id, CAST(e.a AS BIGINT) AS a, CAST(e.b AS BIGINT) AS b, CAST(trunc(p.x) AS INTEGER) AS x1, CAST(trunc(p.y) AS INTEGER) AS y1, CAST(trunc(q.x) AS INTEGER) AS x2, CAST(trunc(q.y) AS INTEGER) AS y2 FROM edges JOIN n p ON p.k = e.a JOIN n q ON q.k = e.b AND p.vec_id = q.vec_id WHERE p.c > 0.3 AND q.c > 0.3 AND {INSIDE.format('p')} AND {INSIDE.format('q')}", "tensors", p0=POINTS, n=SPREAD, edges=EDGES))
def skeleton_in_frame(spark, d):
    s = _framed(spark, d).select("vec_id", F.explode(G.drawn_segments(F.col("keypoints"), F.lit(8), F.lit(8))).alias("s"))
    return s.select("vec_id", F.col("s.a").cast("long").alias("a"), F.col("s.b").cast("long").alias("b"), "s.x1", "s.y1", "s.x2", "s.y2")


DRAWN = "SELECT vec_id, CAST(vec_id % 5 AS BIGINT) AS frame, count(*) FILTER (WHERE c > 0.3 AND " + INSIDE.format("n") + ") AS points FROM n GROUP BY vec_id"


@query(sql("SELECT f.pos, d.vec_id, CAST(d.points AS BIGINT) AS points FROM (SELECT CAST(i AS BIGINT) AS pos FROM range(7) t(i)) f LEFT JOIN d ON f.pos + 1 = d.frame", "tensors", p0=POINTS, n=SPREAD, d=DRAWN))
def frame_drawings(spark, d):
    """What is drawn on each of seven frames; poses are spread over five of them."""
    poses = _framed(spark, d).withColumn("frame_number", F.col("vec_id") % 5)
    f = spark.range(7).select(F.col("id").alias("pos"))
    return frames.drawings(f, poses, F.lit(8), F.lit(8)).select("pos", "vec_id", F.size("points").cast("long").alias("points"))


@query(sql("SELECT video_id, pos, event_id FROM frames WHERE pos >= 3 ORDER BY pos, video_id LIMIT 48", "frames"))
def range_at_batch_ends(spark, d):
    """At most 40 frames, looked at after every batch of 16."""
    f = views.frames(spark, d).select("video_id", "pos", "event_id")
    return frames.frame_range(f, 3, max_frames=40, batch=16, order=("pos", "video_id"))


# Outputs of 5 channels and 8 anchors from a model that sums the inputs at each place.
_MODEL = "SELECT vec_id, o, CAST(CAST(CAST(CAST(tensor[o + 1] * 40 AS FLOAT) AS DOUBLE) + CASE WHEN o < 24 THEN CAST(CAST(tensor[o + 41] * 40 AS FLOAT) AS DOUBLE) ELSE 0e0 END AS FLOAT) AS DOUBLE) AS v FROM tensors, range(40) t(o)"
_DECODED = "SELECT vec_id AS frame, o % 8 AS anchor, max(v) FILTER (WHERE o // 8 = 0) AS cx, max(v) FILTER (WHERE o // 8 = 1) AS cy, max(v) FILTER (WHERE o // 8 = 2) AS w, max(v) FILTER (WHERE o // 8 = 3) AS h, max(v) FILTER (WHERE o // 8 = 4) AS confidence FROM m GROUP BY ALL"
_MOVED = "SELECT frame AS vec_id, CAST(r.anchor AS BIGINT) AS anchor, least(greatest(r.cx / s, 0e0), 1920e0) AS cx, least(greatest((r.cy - 140e0) / s, 0e0), 1080e0) AS cy, least(greatest(r.w / s, 0e0), 1920e0) AS w, least(greatest(r.h / s, 0e0), 1080e0) AS h FROM kept, (SELECT 640 / 1920e0 AS s)"


@query(sql("SELECT vec_id, anchor, cx, cy, w, h FROM moved", "tensors", m=_MODEL, decoded=_DECODED, chosen="SELECT * FROM decoded WHERE confidence >= 0.1e0", folded=nms_sql("chosen", "0.3e0"), kept=KEPT, moved=_MOVED))
def detect_flow(spark, d):
    """Model, decoding, confidence, suppression and then rescaling, in one transform."""
    t = views.tensors(spark, d).select("vec_id", F.transform("tensor", lambda v: v * 40).cast("array<float>").alias("tensor"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    engine = {"input_width": 640, "input_height": 640, "conf_threshold": 0.1, "nms_threshold": 0.3, "batch_size": 16}
    found = detect.detect(t, engine, models.stub_model(5, 8), ["vec_id"], 8, "tensor", [64], "native")
    return found.select("vec_id", "anchor", "cx", "cy", "w", "h")


@query(sql("SELECT vec_id, tensor[1] > 0 AS failed, CASE WHEN tensor[1] > 0 THEN NULL ELSE round(tensor[2], 5) END AS v FROM tensors", "tensors"))
def tolerant_batches(spark, d):
    """A model that fails on inputs beginning with a positive number; the other rows go on."""

    def make():
        def predict(x):
            if (x[:, 0] > 0).any():
                raise RuntimeError("no such input")
            return x

        return predict

    t = views.tensors(spark, d).withColumn("tensor", F.col("tensor").cast("array<float>"))
    out = models.infer(t, "tensor", make, 16, [64], error="error")
    return out.select("vec_id", F.col("error").isNotNull().alias("failed"), F.round(F.get("output", F.lit(1)).cast("double"), 5).alias("v"))


@query(sql("SELECT t.vec_id, CASE WHEN tensor[64] > 0.1e0 THEN 'ValueError: no such input' END AS error, anchor, cx, cy, w, h FROM tensors t LEFT JOIN moved m ON t.vec_id = m.vec_id AND NOT tensor[64] > 0.1e0", "tensors", m=_MODEL, decoded=_DECODED, chosen="SELECT * FROM decoded WHERE confidence >= 0.1e0", folded=nms_sql("chosen", "0.3e0"), kept=KEPT, moved=_MOVED))
def detect_failing(spark, d):
    """The flow above with a model that fails on some frames: only these are lost, and every frame is told of."""
    inner = models.stub_model(5, 8)

    def make():
        predict = inner()

        def checked(x):
            if (x[:, 63] > 4).any():
                raise ValueError("no such input")
            return predict(x)

        return checked

    t = views.tensors(spark, d).select("vec_id", F.transform("tensor", lambda v: v * 40).cast("array<float>").alias("tensor"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    engine = {"input_width": 640, "input_height": 640, "conf_threshold": 0.1, "nms_threshold": 0.3, "batch_size": 16}
    found = detect.detect(t, engine, make, ["vec_id"], 8, "tensor", [64], "native", "error", True)
    return found.select("vec_id", "error", "anchor", "cx", "cy", "w", "h")


from framelake.plans import formats  # noqa: E402, F401  (registers the queries on files)
