"""Detection operators against plain Python and numpy, with ties, empty groups and odd numbers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import scalars as S
from framelake.operators import batching, frames, matching, models, nms, stats, tensors
from framelake.sources import manifest


def boxes(seed, groups=(0, 1, 2, 13, 60)):
    r = random.Random(seed)
    rows = []
    for g, n in enumerate(groups):
        for a in range(n):
            rows.append((g, a + 1, r.choice([50.0, 55.0, 200.0]) + r.random() * 30, 60.0 + r.random() * 40, r.choice([40.0, 0.0, 80.0]), 40.0, round(r.random(), 1)))
    return rows


COLS = ["frame", "anchor", "cx", "cy", "w", "h", "confidence"]


def iou(a, b):
    ix = max(0.0, min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2))
    iy = max(0.0, min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2))
    union = a[2] * a[3] + b[2] * b[3] - ix * iy
    return ix * iy / union if union > 0 else 0.0


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(k[2:6], r[2:6]) <= t for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("strategy", ["native", "arrow", "auto"])
@pytest.mark.parametrize("threshold", [0.0, 0.45, 1.0])
def test_nms(spark, strategy, threshold):
    rows = boxes(1)
    got = nms.nms(spark.createDataFrame(rows, COLS), ["frame"], threshold, strategy).collect()
    want = {(g, r[1]): i for g in range(5) for i, r in enumerate(greedy([r for r in rows if r[0] == g], threshold))}
    assert {(r.frame, r.anchor): r.kept_rank for r in got} == want


def test_nms_caps_and_repeats(spark):
    rows = boxes(2, (30,))
    df = spark.createDataFrame(rows, COLS)
    top = sorted(rows, key=lambda r: (-r[6], r[1]))[:5]
    assert [r.anchor for r in nms.nms(df, ["frame"], 0.3, before=5, after=2).orderBy("kept_rank").collect()] == [r[1] for r in greedy(top, 0.3)][:2]
    once = nms.nms(df, ["frame"], 0.3).select(COLS)
    assert sorted(nms.nms(once, ["frame"], 0.3).select(COLS).collect()) == sorted(once.collect())
    with pytest.raises(ValueError):
        nms.nms(df, ["frame"], 0.3, "other")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.floats(0, 50)] * 4), max_size=25), st.floats(0, 1))
def test_kept_boxes_do_not_overlap(found, t):
    b = np.array(found, float).reshape(-1, 4)
    kept = nms.keep_greedy(b, t)
    assert kept.tolist() == [r[1] for r in greedy([(0, i, *x, -float(i)) for i, x in enumerate(found)], t)]
    for n, i in enumerate(kept):
        assert all(iou(b[i], b[j]) <= t + 1e-9 for j in kept[:n])


@pytest.mark.parametrize("together", [0, 7, 512])
def test_groups_are_suppressed_together(monkeypatch, together):
    """As group by group, in any rounds; numpy is not gone through for each small group."""
    rng = np.random.default_rng(5)
    sizes = np.append(rng.integers(0, 12, 3000), [0, 40, 600, 1, 0])
    n = int(sizes.sum())
    x = np.stack([rng.uniform(0, 300, n), rng.uniform(0, 300, n), rng.uniform(-1, 200, n), rng.uniform(-1, 200, n)], axis=1)
    x[rng.integers(0, n, 60), rng.integers(0, 4, 60)] = np.tile([float("nan"), 0, float("inf")], 20)
    ends, alone, calls = np.cumsum(sizes), nms.keep_greedy, []
    with np.errstate(all="ignore"):
        want = np.concatenate([e - k + alone(x[e - k : e], 0.3) for e, k in zip(ends, sizes, strict=True)])
        monkeypatch.setattr(nms, "keep_greedy", lambda b, t: calls.append(len(b)) or alone(b, t))
        monkeypatch.setattr(nms, "TOGETHER", together)
        monkeypatch.setattr(nms, "ROUND", 1000)
        assert np.flatnonzero(nms.keep_greedy_groups(x, sizes, 0.3)).tolist() == want.tolist()
    assert sorted(calls) == sorted(sizes[sizes > together].tolist())


def test_confidence_filter_compares_in_the_columns_type(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (float("nan"),), (None,)], "confidence float")
    assert nms.confidence_filter(df, 0.7).count() == 2
    assert nms.confidence_filter(df, 0.7, inclusive=False).count() == 1


def test_iou_of_odd_boxes(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 1.0), (nan, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, -2.0, 1.0, 1.0), (0.5, 0.0, 1.0, 1.0, 1.0)], ["cx", "cy", "w", "h", "one"])
    zero = F.lit(0.0)
    got = [r[0] for r in df.select(G.iou((F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), (zero, zero, F.col("one"), F.col("one")))).collect()]
    assert got[0] == 0 and got[2] == 0 and got[3] == pytest.approx(1 / 3)


def test_greedy_match(spark):
    rows = boxes(3, (8, 0, 14, 5))
    left, right = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    for t in (0.0, 0.3, 0.8):
        want = []
        for g in range(4):
            used = set()
            for a in sorted((r for r in left if r[0] == g), key=lambda r: r[1]):
                best, who = 0.0, None
                for b in sorted((r for r in right if r[0] == g), key=lambda r: r[1]):
                    v = iou(a[2:6], b[2:6])
                    if b[1] not in used and v > best:
                        best, who = v, b[1]
                if who is not None and best >= t:
                    used.add(who)
                    want.append((g, a[1], who))
        ldf, rdf = spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS)
        m = matching.greedy_match(ldf, rdf, ["frame"], t)
        assert sorted((r.frame, r.left_id, r.right_id) for r in m.collect()) == sorted(want)
        assert matching.unmatched(ldf, m, ["frame"], "left").count() == len(left) - len(want)
        got = matching.match_metrics(ldf, rdf, ["frame"], t).first()
        assert got.n_match == len(want) and got.precision == pytest.approx(len(want) / len(right)) and got.recall == pytest.approx(len(want) / len(left))


@pytest.mark.parametrize("n", [0, 15, 16, 17, 32])
def test_batches(spark, n):
    df = spark.createDataFrame([("k", i) for i in range(n)], "key string, i int")
    count = lambda tail: batching.batches(df, 16, ["key"], ["i"], tail).count()
    assert (count("drop"), count("pad"), count("repeat")) == (n // 16 * 16, n, -(-n // 16) * 16)


def test_letterbox_round_trip(spark):
    df = spark.createDataFrame([(300.0, 200.0, 50.0, 40.0)], ["cx", "cy", "w", "h"])
    ow, oh, size = F.lit(1920.0), F.lit(1080.0), F.lit(640.0)
    scale = 640 / 1920
    pad = (640 - 1080 * scale) / 2
    inside = (F.col("cx") * scale, F.col("cy") * scale + pad, F.col("w") * scale, F.col("h") * scale)
    for geometry, tol in (("native", 1e-9), ("corner", 1e-9), ("int", 3)):
        assert list(df.select(*G.to_original(inside, ow, oh, size, size, geometry=geometry)).first()) == pytest.approx([300, 200, 50, 40], abs=tol)
    none = F.lit(0.0)
    assert list(df.select(*G.to_original((F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), none, none, size, size)).first()) == [300, 200, 50, 40]


def test_letterbox_pixels():
    image = np.zeros((20, 40, 3), np.uint8)
    image[:, :, 0] = 255  # blue
    x = models.letterbox_pixels(image, 32, 32)
    assert x.shape == (3, 32, 32) and x[2, 16, 16] == 1 and x[0].max() == 0 and x[2, 0].max() == 0 and (x[2].max(axis=1) > 0).sum() == 16
    assert models.letterbox_pixels(np.full((1, 9, 3), 10, np.uint8), 4, 4).shape == (3, 4, 4)


def test_tensors(spark):
    t = np.arange(2 * 5 * 7, dtype=float)
    df = spark.createDataFrame([(1, t.tolist())], "id int, tensor array<double>")
    got = df.select(tensors.to_anchor_rows(tensors.batch_slice(F.col("tensor"), 1, 5, 7), 5, 7)).first()[0]
    assert np.array(got).tolist() == t.reshape(2, 5, 7)[1].T.tolist()
    pose = np.arange(56 * 3, dtype=float) / 10
    rows = tensors.decode_frames(spark.createDataFrame([(1, pose.tolist())], "id int, tensor array<double>"), "tensor", 3, 17).orderBy("anchor").collect()
    a = pose.reshape(56, 3).T
    assert rows[2].confidence == a[2, 4] and rows[2].keypoints[16].x == a[2, 53] and rows[1].keypoints[0].confidence == (a[1, 7] if a[1, 7] <= 1 else a[1, 7] / 255)
    other = spark.createDataFrame([(1, (t + np.where(t == 33, 2.0, 0)).tolist()[:60])], "id int, tensor array<double>")
    d = tensors.tensor_diff(df, other, ["id"]).first()
    assert (d.n, d.n_over, d.max_abs) == (60, 1, 2)
    top = tensors.tensor_topn(df, other, ["id"], 1, [2, 5, 7]).first()
    assert (top.pos, top.dim0, top.dim1, top.dim2) == (33, 0, 4, 5)


def test_skeleton(spark):
    k = [{"x": float(i), "y": 0.0, "confidence": 0.05 if i == 0 else 0.9} for i in range(17)]
    df = spark.createDataFrame([(k,)], "k array<struct<x:double,y:double,confidence:double>>")
    got = df.select(G.skeleton_segments(F.col("k")), F.size(G.visible(F.col("k")))).first()
    assert len(got[0]) == 14 and got[1] == 16


def test_windows_and_caps(spark):
    f = spark.createDataFrame([(1, i) for i in range(100)], "video_id int, pos long")
    clock = lambda s, e: f.select("video_id", "pos", F.lit(100.0).alias("moment"), F.lit(30.0).alias("fps"), F.lit(s).alias("start_ts"), F.lit(e).alias("end_ts"))
    inf = float("inf")
    assert frames.window_scan(clock(-inf, inf)).count() == 100
    assert frames.window_scan(clock(101.0, inf)).agg(F.min("pos")).first()[0] == 30  # by the clock alone it would be 29
    assert frames.window_scan(clock(0.0, 99.0)).count() == 0
    assert frames.cap_per_video(f, 7).count() == 7 and frames.cap_per_video(f, 0).count() == 100 and frames.global_cap(f, 9).count() == 9
    assert frames.frame_range(f, 10, 20).count() == 11 and frames.frame_range(f, 10, 20, inclusive=False, max_frames=3).count() == 3


def test_scan_clips(spark):
    clips = spark.createDataFrame([(0, "a", 10.0, 12.0, 13.0), (1, "b", 0.0, float("-inf"), float("inf"))], "video_id int, path string, moment_time double, start_ts double, end_ts double")

    def decoder(path, first):
        for i in range(first, 150):
            yield i, 4, 2, b"x" * 24

    got = frames.scan_clips(clips, decoder).toPandas()
    a = got[got.video_id == 0]
    assert a.frame_pos.min() == 60 and a.frame_number.min() == 1 and a.ts.max() <= 13.0 and (got.video_id == 1).sum() == 150


def test_short_clips_are_scanned_together(spark):
    """Many clips in one partition are dealt to tasks, and their few frames do not each go on alone."""
    clips = spark.range(20_000).coalesce(1).select(F.col("id").cast("int").alias("video_id"), F.lit("a").alias("path"), F.lit(0.0).alias("moment_time"), F.lit(0.0).alias("start_ts"), F.lit(9.0).alias("end_ts"))

    def decoder(path, first):
        return ((i, 1, 1, b"x") for i in range(first, 2))

    got = frames.scan_clips(clips, decoder)
    sizes = got.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    n = [r.n for r in sizes.collect()]
    assert sum(n) == 40_000 and len(n) < 100 and got.select("video_id", "frame_pos").distinct().count() == 40_000 and got.rdd.getNumPartitions() > 4


@pytest.mark.parametrize(("text", "want", "legacy"), [("12.5", 12.5, 12.5), ("2025-11-18T08:30:00+07:00", 1763429400.0, 1763429400.0), ("2025-11-18T08:30:00.25Z", 1763454600.25, None), ("2025-11-18T08:30:00", 1763454600.0, None), ("2025-11-18T08:30:00+0700", 1763429400.0, 1763454600.0), ("", None, None), ("soon", None, None), (" 7 ", 7.0, 7.0), ("2025-13-45T08:30:00Z", None, None)])
def test_parse_epoch(spark, text, want, legacy):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(S.parse_epoch(F.col("t")), S.parse_epoch(F.col("t"), True)).first()) == (want, legacy)


def test_scalars(spark):
    df = spark.createDataFrame([("1x3x640x640", "a.b/C.MP4", " \tyes\n")], "shape string, path string, flag string")
    got = df.select(S.shape_of(F.col("shape")), S.extension(F.col("path")), S.stem(F.col("path")), S.truthy(F.col("flag")), S.output_path(F.lit(7), F.lit("x"), "out/"), S.model_type_name(F.lit(9))).first()
    assert list(got) == [[1, 3, 640, 640], "mp4", "C", True, "out/video_0007_x.bin", "UNKNOWN(9)"]
    lo, hi = S.time_window(F.lit(10.0), F.lit(5.0), 1.0)
    assert list(df.select(lo, hi).first()) == [6.0, 9.0]
    fps = lambda *a: df.select(S.resolve_fps(*(F.lit(x) for x in a))).first()[0]
    assert (fps(29.97, 10, 1.0), fps(0.0, 50, 2.0), fps(float("nan"), 0, 0.0), fps(0.05, 0, 0.0)) == (29.97, 25.0, 30.0, 0.05)


def test_records(spark):
    rows = spark.createDataFrame([("f", 1, 1, 3), ("f", 1, 2, 0), ("f", 2, 3, 1)], "path string, frame_number int, seq int, n int")
    keep = lambda m: sorted(r.seq for r in stats.keep_record(rows, ["path", "frame_number"], "seq", m).collect())
    assert (keep("all"), keep("last"), keep("last_nonempty")) == ([1, 2, 3], [2, 3], [1, 3])
    s = stats.file_summary(rows).first()
    assert (s.frames, s.with_detections, s.without_detections, s.detections, s.span) == (3, 2, 1, 4, 2)


def test_zip_flatten(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [], ["a"])], "id int, a array<int>, b array<string>")
    assert [tuple(r) for r in manifest.zip_flatten(df, "a", "b").collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]


@pytest.mark.parametrize("per_task", [1_000_000, 40, 7])
def test_batches_numbered_in_ranges(spark, per_task):
    rows = [(k, i * 7 % 301, i) for k, n in ((None, 5), ("a", 300), ("b", 17), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, o int, i int").repartition(5)
    for tail in ("pad", "drop", "repeat"):
        got = sorted((str(r.key), r.batch, r.slot, r.o, r.i) for r in batching.batches(df, 16, ["key"], ["o", "i"], tail, per_task).collect())
        want = []
        for key in (None, "a", "b", "c"):
            own = sorted((o, i) for k, o, i in rows if k == key)
            if tail == "drop":
                own = own[: len(own) // 16 * 16]
            elif tail == "repeat":
                own += [own[-1]] * (-len(own) % 16)
            want += [(str(key), j // 16, j % 16, o, i) for j, (o, i) in enumerate(own)]
        assert got == sorted(want)


def test_detect_moves_boxes_of_cropping_engines_only(spark):
    from framelake.operators import detect

    def model():
        return lambda x: np.tile(np.array([32, 32, 10, 10, 0.9], np.float32), (len(x), 1))

    f = spark.createDataFrame([(1, 200, 100, 50, 20, 150, 70, [0.0] * 4), (2, 200, 100, None, None, None, None, [0.0] * 4), (3, 0, 0, None, None, None, None, [0.0] * 4)], "id int, width int, height int, px1 int, py1 int, px2 int, py2 int, tensor array<float>")
    engine = {"input_width": 64, "input_height": 64, "conf_threshold": 0.5, "nms_threshold": 0.5}
    box = lambda e: {r.id: (r.cx, r.cy, r.w, r.h) for r in detect.detect(f, e, model, ["id"], 1, "tensor", [4]).collect()}
    plain, crops = box(engine), box({**engine, "roi_cropping": True})
    assert plain[1] == plain[2] == pytest.approx((100, 50, 31.25, 31.25)) and plain[3] == (32, 32, 10, 10)
    assert crops[1] == pytest.approx((50 + 50, 20 + 25, 15.625, 15.625)) and crops[2] == plain[2]
    image = f.where("id < 3").select("id", "width", "height", F.lit(bytes(200 * 100 * 3)).alias("image"))
    assert {r.id: round(r.cx, 3) for r in detect.detect(image, engine, model, ["id"], 1).collect()} == {1: 100.0, 2: 100.0}


def crowd(seed, n, spread):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.uniform(-spread, spread, n), rng.uniform(-spread, spread, n), *np.exp(rng.normal(2, 1, (2, n)))], axis=1)
    x[: n // 4] = x[n // 4 : n // 4 * 2] + rng.normal(0, 0.5, (n // 4, 4))  # near others
    x[-5:, 2:] = [[0, 3], [3, -1], [1000, 900], [2.0**5, 2.0**5], [float("nan"), 1]]
    return x


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3, 0.7])
def test_grid_finds_all_overlaps(spark, threshold):
    rows, want = [], {}
    for g, (n, spread) in enumerate([(0, 1), (5, 5), (64, 40), (65, 40), (700, 150)]):
        x = crowd(g, n, spread) if n > 5 else np.ones((n, 4))
        rows += [(g, i, *map(float, b)) for i, b in enumerate(x)]
        for i in range(n):
            for j in range(i + 1, n):
                if np.isfinite(x[[i, j]]).all() and (v := iou(x[i], x[j])) > threshold:
                    want[g, i, j] = v
    df = spark.createDataFrame(rows, "g int, anchor long, cx double, cy double, w double, h double")
    for few in (64, 0):
        got = [tuple(r) for r in nms.overlapping_pairs(df, ["g"], threshold, few=few).collect()]
        assert len(got) == len(want) and {r[:3]: pytest.approx(r[3]) for r in got} == want


def test_grid_compares_few_pairs(spark):
    rows = [(0, i, *map(float, b)) for i, b in enumerate(crowd(9, 5000, 1500)[:-5])]
    df = spark.createDataFrame(rows, "g int, anchor long, cx double, cy double, w double, h double")
    found, tried = nms.overlapping_pairs(df, ["g"], 0.3).count(), nms.candidate_pairs(df, ["g"], 0.3).count()
    assert found <= tried < 5000 * 5000 / 2 / 100


def test_grid_of_a_dense_crowd_compares_near_boxes(spark):
    """Boxes of three grids, side by side in a wide picture: what coarser grids hold together is not compared for it."""
    rng = np.random.default_rng(3)
    n = 4000
    x = np.stack([rng.uniform(0, 8000, n), rng.uniform(0, 640, n), rng.uniform(80, 280, n), rng.uniform(80, 240, n)], axis=1)
    df = spark.createDataFrame([(0, i, *map(float, b)) for i, b in enumerate(x)], "g int, anchor long, cx double, cy double, w double, h double")
    half = x[:, 2:] / 2
    lo, hi, size = x[:, :2] - half, x[:, :2] + half, x[:, 2] * x[:, 3]
    side = np.maximum(0, np.minimum(hi[:, None], hi[None]) - np.maximum(lo[:, None], lo[None]))
    inter = side[..., 0] * side[..., 1]
    want = np.triu(inter / (size[:, None] + size[None] - inter) > 0.3, 1)
    got = nms.overlapping_pairs(df, ["g"], 0.3)
    assert {(r.a, r.b) for r in got.collect()} == set(zip(*(i.tolist() for i in np.nonzero(want)), strict=True))
    looked = nms.candidate_pairs(df, ["g"], 0.3).count()
    assert want.sum() <= looked < 8 * want.sum()


def test_boxes_of_a_cell_meet_in_arrays(spark, monkeypatch):
    """Rows are not joined pair by pair; few more pairs than overlap are looked at, also where cells come in many chunks or have equal hashes."""
    rng = np.random.default_rng(5)
    n = 3000
    x = np.stack([rng.uniform(-2000, 4000, n), rng.uniform(0, 640, n), *np.exp(rng.normal(5, 0.5, (2, n)))], axis=1)
    x[:200, :2] = x[200:400, :2]  # equal centres
    x[:100] = x[100:200]
    rows = [(name, i, *map(float, b)) for k, name in enumerate(("left", "right")) for i, b in enumerate(x[k::2])]
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 0.0, 9.0, 9.0)], "g string, anchor long, cx double, cy double, w double, h double")
    want = {(name, i, j): v for k, name in enumerate(("left", "right")) for i in range(n // 2) for j in range(i + 1, n // 2) if (v := iou(x[k::2][i], x[k::2][j])) > 0.3}
    plan = nms.candidate_pairs(df, ["g"], 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert len(want) < nms.candidate_pairs(df, ["g"], 0.3).count() < 8 * len(want)
    for change in ({}, {"CELLS": 50, "LOOKS": 7}, {"xxhash64": True}):
        with monkeypatch.context() as m:
            if "xxhash64" in change:
                m.setattr(nms.F, "xxhash64", lambda *cols: F.abs(F.hash(*cols) % 3).cast("long"))
            else:
                for name, value in change.items():
                    m.setattr(nms, name, value)
            got = [tuple(r) for r in nms.overlapping_pairs(df, ["g"], 0.3, few=0).collect()]
        assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want)


def test_packing_makes_no_objects_of_rows(spark):
    """Batches go through as Arrow arrays; nulls, empty tensors, missing numbers and doubles keep their bytes."""
    rows = [(0, [1.0, 2.5]), (1, None), (2, []), (3, [None, 3.0]), (4, [float("inf")])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"i int, t array<{kind}>").coalesce(1).select("i", tensors.pack(F.col("t")).alias("p"))
        got = {r.i: None if r.p is None else np.frombuffer(r.p, "<f4").tolist() for r in df.collect()}
        assert got[0] == [1.0, 2.5] and got[1] is None and got[2] == [] and np.isnan(got[3][0]) and got[3][1] == 3.0 and got[4] == [float("inf")]
        assert df.where("i = 3").count() == 1


@pytest.mark.parametrize("keypoints", [0, 17])
@pytest.mark.parametrize("outer", [False, True])
def test_packed_decoding_equals_decoding_in_columns(spark, keypoints, outer):
    rng = np.random.default_rng(keypoints)
    n = (5 + 3 * keypoints) * 9
    x = rng.normal(size=(12, n)).astype("f4")
    x[:, 7::11] *= 300
    x[3, 4 * 9 :] = -1  # nothing is above the threshold
    x[5, 4 * 9 + 2] = float("nan")
    rows = [(i, "k", None if i in (7, 11) else v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, name string, t array<float>")
    key = lambda r: repr(r.asDict(True))
    for threshold in (0.25, None):
        want = sorted(map(key, tensors.decode_frames(df, "t", 9, keypoints, threshold, outer).collect()))
        packed = df.withColumn("t", tensors.pack(F.col("t")))
        for source in (df, packed):
            got = tensors.decode_packed(source, "t", 9, keypoints, threshold, outer)
            assert sorted(map(key, got.collect())) == want
    double = df.withColumn("t", F.col("t").cast("array<double>"))
    same = lambda f: sorted((r.id, r.anchor, r.confidence) for r in f(double, "t", 9, keypoints, 0.25).collect())
    assert same(tensors.decode_packed) == same(tensors.decode_frames) != []
    with pytest.raises(Exception, match="not"):
        tensors.decode_packed(packed, "t", 8, keypoints).collect()


def test_wide_tensors_are_decoded_in_batches(spark):
    rng = np.random.default_rng(1)
    x = rng.random((6, 56 * 8400)).astype("f4")
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id int, t binary")
    got = tensors.decode_any(df, "t", 8400, 17, 0.999).collect()
    want = {(i, a) for i in range(6) for a in np.flatnonzero(x[i].reshape(56, 8400)[4] >= np.float32(0.999)).tolist()}
    assert {(r.id, r.anchor) for r in got} == want and all(len(r.keypoints) == 17 for r in got)
    r = got[0]
    v = x[r.id].reshape(56, 8400)[:, r.anchor]
    assert [r.cx, r.cy, r.w, r.h, r.confidence] == v[:5].tolist() and tuple(r.keypoints[16]) == tuple(v[53:].tolist())
