"""Sources, sinks, configuration, streaming."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import models
from framelake.sources import config, detbin, detcodec, logs, manifest, tensors
from framelake.streaming import stats as streaming

DET = (1.5, 2.5, 3.0, 4.0, 0.5, 0, [])
POSE = (1.0, 2.0, 3.0, 4.0, 0.75, 0, [(float(i), i + 0.5, 0.25) for i in range(17)])


def encode(model_type, frames):
    """Bytes of a detection file, field by field; a detection is (cx, cy, w, h, confidence, class, [(x, y, confidence)])."""
    out = [struct.pack("<i", model_type)]
    for number, found in frames:
        out.append(struct.pack("<2i", number, len(found)))
        for *box, conf, cls, points in found:
            out.append(struct.pack("<4ffii", *box, conf, cls, len(points)))
            out += [struct.pack("<3f", *p) for p in points]
    return b"".join(out)


def test_plain_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\n  a.mp4\t\n#b\nc #d.mp4\n")
    got = manifest.read_manifest(spark, str(tmp_path / "list.txt")).orderBy("video_id").collect()
    assert [(r.video_id, r.path, r.start_ts) for r in got] == [(0, "a.mp4", float("-inf")), (1, "c #d.mp4", float("-inf"))]


def test_json_list(spark, tmp_path):
    one = {"alarm": {"raw_alarm": {"record_list": [{"moment_time": 1763426000, "duration": 60}, {"moment_time": "5", "duration": "x"}, {"moment_time": 1}], "video_start_time": "2025-11-18T08:31:00+07:00", "video_end_time": "2025-11-18T08:30:00+07:00"}}, "playback_location": ["a.mp4", {"file": "b.mp4"}], "config": {"box": [[0.1, 0.2], [0.9, 0.2], [0.9, 0.8], [0.1, 0.8]]}}
    bad_roi = {**one, "config": {"box": [[0.9, 0.2], [0, 0], [0.1, 0.8], [0, 0]]}, "playback_location": ["", "c.mp4"]}
    lines = [json.dumps(one), "{broken", json.dumps({"alarm": {}}), json.dumps(bad_roi), json.dumps({**one, "config": {"box": [[0, 0]]}, "playback_location": []})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = manifest.read_manifest(spark, str(tmp_path / "m.jsonl"), padding_s=1).orderBy("video_id").collect()
    assert [(r.path, r.moment_time, r.duration) for r in got] == [("a.mp4", 1763426000.0, 60.0), ("b.mp4", 5.0, 0.0), ("c.mp4", 5.0, 0.0)]
    assert got[0].start_ts == 1763429400.0 + 1 and got[0].end_ts == 1763429460.0 - 1
    assert got[0].roi.x1 == pytest.approx(0.1) and got[2].roi is None


def test_config(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.mp4\nb.mp4\n")
    (tmp_path / "c.yaml").write_text(f"models:\n  - {{path: m.onnx, name: one, type: Pose, conf_threshold: 0.4, roi_cropping: 'yes'}}\n  - {{name: none}}\nvideos:\n  list_file: {tmp_path}/list.txt\n  paths: [z.mp4]\n  time_padding_seconds: -3\nthreads: {{num_readers: 7, num_preprocessors: 14}}\ndebug: {{enabled: true, max_frames_per_video: -1}}\n")
    c = config.from_args(["--config", str(tmp_path / "c.yaml"), "--num-readers", "3", "--num-detectors", "2"])
    assert (c.num_readers, c.num_preprocessors, c.padding_s, c.debug, c.max_frames_per_video, c.problems()) == (3, 14, 0.0, True, 0, [])
    e = c.engine_frame(spark).collect()
    assert len(e) == 1 and (e[0].engine, e[0].model_type, e[0].num_detectors, e[0].input_width, e[0].roi_cropping) == ("one", 1, 2, 640, True)
    assert [r.path for r in c.clip_frame(spark).orderBy("video_id").collect()] == ["a.mp4", "b.mp4", "z.mp4"]
    assert config.load_config().problems() == ["no engine", "no clip"]
    (tmp_path / "d.yaml").write_text("model: {path: old.onnx}\n")
    assert config.load_config(str(tmp_path / "d.yaml"), paths=["a"]).problems() == []
    with pytest.raises(TypeError):
        config.load_config(None, colour=1)


FRAMES = [(1, [DET, DET]), (2, []), (3, [POSE]), (3, [DET])]


def test_detection_files(spark, tmp_path):
    for name, kind in (("video_0000_a.bin", 0), ("video_0001_b.bin", 1)):
        (tmp_path / name).write_bytes(encode(kind, FRAMES))
    (tmp_path / "video_0002_c.bin").write_bytes(struct.pack("<i", 0))
    detbin.register(spark)
    for df in (spark.read.format("detbin").option("mode", "FAILFAST").load(str(tmp_path)), detbin.read_detections(spark, str(tmp_path), "FAILFAST")):
        rows = df.where(F.col("path").contains("0001")).collect()
        assert [(r.model_type, r.frame_number, r.det_index) for r in rows] == [(1, 1, 0), (1, 1, 1), (1, 2, None), (1, 3, 0), (1, 3, 0)]
        assert len(rows[3].keypoints) == 17 and rows[3].keypoints[2].y == 2.5 and rows[0].keypoints == []
        assert df.count() == 10


def test_detection_files_are_written_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "video_0000_a.bin").write_bytes(data := encode(1, FRAMES[:3]))
    df = detbin.read_detections(spark, str(tmp_path / "in"))
    for _ in range(2):  # a second run that overwrites gives the same file
        detbin.write_detections(df, str(tmp_path / "out"), "overwrite")
        assert (tmp_path / "out" / "video_0000_a.bin").read_bytes() == data


def test_cut_detection_files():
    data = encode(0, [(1, [DET]), (2, [POSE])])
    for n in range(len(data)):
        list(detcodec.parse(data[:n]))
        if n not in (4, 4 + 8 + 28):
            with pytest.raises(detcodec.BadFile):
                list(detcodec.parse(data[:n], strict=True))
    for bad in (encode(11, []), encode(0, [(-1, [])]), encode(0, [(1_000_001, [])])):
        with pytest.raises(detcodec.BadFile):
            list(detcodec.parse(bad, strict=True))
    assert len(list(detcodec.parse(data, max_frames=1))) == 1


def test_tensor_files(spark, tmp_path):
    x = np.arange(2 * 5 * 7, dtype="<f4")
    (tmp_path / "sub").mkdir()
    x.tofile(tmp_path / "sub" / "outputs_batch000000.bin")
    rows = tensors.read_tensors(spark, str(tmp_path), 2, 5).orderBy("item").collect()
    assert [(r.item, r.channels, r.anchors) for r in rows] == [(0, 5, 7), (1, 5, 7)] and rows[1].tensor == x[35:].tolist()
    assert tensors.numbered(tensors.read_tensors(spark, str(tmp_path), 2, 5)).first().ordinal == 0
    one = tensors.read_tensor(spark, str(tmp_path / "sub"), shape=[2, 5, 7]).first()
    assert one.shape == [2, 5, 7] and len(one.tensor) == 70
    with pytest.raises(Exception, match="are no 3 x 5 tensors"):
        tensors.read_tensors(spark, str(tmp_path), 3, 5).collect()
    assert tensors.tee(spark.range(3), str(tmp_path / "tee")).count() == 3


def test_logs(spark):
    df = spark.createDataFrame([("[t] [INFO] [reader] hello [x]",), ("[t] [DEBUG] [a] b",), ("noise",)], "value string")
    assert [tuple(r) for r in logs.parse_log(df, "INFO").collect()] == [("t", "INFO", "reader", "hello [x]")]
    assert logs.parse_log(df).count() == 3


def test_inference_seam(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8) for i in range(10)], "id int, tensor array<float>")
    got = {r.id: r.output for r in models.infer(df, "tensor", models.stub_model(2, 2), 4, [8]).collect()}
    assert got == {i: [2.0 * i] * 4 for i in range(10)}


def failing(limit):
    """Fails on rows whose first number is above the limit."""

    def make():
        def predict(x):
            if x.reshape(len(x), -1)[:, 0].max() > limit:
                raise RuntimeError("no")
            return x.reshape(len(x), -1)

        return predict

    return make


def test_failing_rows_are_found_by_halving(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8) for i in range(40)], "id int, tensor array<float>").coalesce(1)
    got = {r.id: r for r in models.infer(df, "tensor", failing(38), 16, [8], error="why").collect()}
    assert got[39].why == "RuntimeError: no" and got[39].output is None
    assert all(got[i].why is None and got[i].output == [float(i)] * 8 for i in range(39))


@pytest.mark.parametrize("bad", [[], [3], [0, 15], list(range(16))])
def test_halving_takes_few_runs(bad):
    runs = []

    def predict(x):
        runs.append(len(x))
        if set(x[:, 0]) & set(bad):
            raise ValueError("no")
        return x

    out, why = models.halved(predict, np.arange(16.0)[:, None])
    assert [i for i, w in enumerate(why) if w] == bad and all(len(o) == (i not in bad) for i, o in enumerate(out))
    assert len(runs) <= 1 + 2 * len(bad) * 4
    assert models.halved(lambda x: x[:1], np.zeros((4, 1)))[1][0] == ""  # a single output is right for a single input
    assert models.halved(lambda x: x[:0], np.zeros((2, 1)))[1] == ["ValueError: 0 outputs for 1 inputs"] * 2


def test_failed_frames_are_no_detections(spark):
    from framelake.operators.detect import detect

    # one anchor of 5 channels; sixteen frames in a batch, one of them bad, one with a confidence that is no number
    rows = [(i, [10.0 * i, 5.0, 2.0, 2.0, float("nan") if i == 7 else 0.1 if i == 9 else 0.9], 64, 64) for i in range(16)]
    df = spark.createDataFrame(rows, "frame int, tensor array<float>, width int, height int").coalesce(1)
    engine = {"input_width": 64, "input_height": 64, "conf_threshold": 0.5, "nms_threshold": 0.5, "batch_size": 16}
    for strategy in ("arrow", "native"):
        run = lambda model, **kw: {r.frame: r for r in detect(df, engine, model, ["frame"], 1, "tensor", [5], strategy, **kw).collect()}  # noqa: B023, E731
        got = run(failing(145), error="error")
        assert got.keys() == {*range(16)} - {7, 9}
        assert [(f, r.error) for f, r in got.items() if r.error or r.anchor is None] == [(15, "RuntimeError: no")]
        got = run(failing(145), error="error", outer=True)
        assert got.keys() == {*range(16)} and got[7].anchor is None and got[7].error is None and got[15].confidence is None
        got = run(failing(-1), error="error")
        assert all(r.anchor is None and r.error for r in got.values()) and len(got) == 16
        assert run(failing(1e9)).keys() == {*range(16)} - {7, 9}
        with pytest.raises(Exception, match="RuntimeError"):
            run(failing(145))


def test_tools(spark, tmp_path):
    from framelake.plans import tools

    for d, shift in (("a", 0.0), ("b", 0.5)):
        (tmp_path / d).mkdir()
        x = np.zeros((2, 5, 3), "<f4")
        x[:, 0] = [[10, 11, 300]] * 2
        x[:, 1] = 20
        x[:, 2:4] = 8
        x[:, 4] = [[0.9, 0.8, 0.7], [0.1, 0.1, 0.1 + shift]]
        x.tofile(tmp_path / d / "outputs_batch000000.bin")
    found = tools.process_outputs(spark, str(tmp_path / "a"), 2, 5, 0.2, 0.5, start_frame=1)
    assert sorted((r.frame_number, r.anchor) for r in found.collect()) == [(1, 0), (1, 2)]
    m = tools.verify(found, tools.process_outputs(spark, str(tmp_path / "b"), 2, 5, 0.2, 0.5, start_frame=1)).first()
    assert (m.n_left, m.n_right, m.n_match, m.precision, m.recall) == (2, 2, 2, 1.0, 1.0)
    both = tools.cross_check(spark, str(tmp_path / "a"), str(tmp_path / "b"), 2, 5).orderBy("item").collect()
    assert [r.n_over for r in both] == [0, 1]
    assert tools.compare(spark, str(tmp_path / "a"), str(tmp_path / "b")).first().n == 30
    profile, top = tools.raw_report(spark, str(tmp_path / "a"), 2, 5, 2)
    assert profile.count() == 2 and [r.anchor for r in top.collect()] == [0, 1]
    (tmp_path / "video_0000_a.bin").write_bytes(encode(1, [(1, [DET, DET]), (2, []), (3, [POSE]), (3, [])]))
    modes = {m: tools.read(spark, str(tmp_path / "video_0000_a.bin"), m).count() for m in ("all", "last", "last_nonempty")}
    assert modes == {"all": 5, "last": 4, "last_nonempty": 3}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "video_0000_a.bin").write_bytes(encode(1, FRAMES[:3]))
    rows = tools.inspect(spark, str(tmp_path / "c")).collect()
    assert len(rows) == 2 and {r.frames for r in rows} == {3} and rows[0].model == "POSE"
    assert tools.debug(spark, str(tmp_path / "c")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("event_type").alias("engine"), F.col("value").alias("latency"))
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    q = streaming.run_available(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "ck"), "1 day", 6)
    assert q.awaitTermination(120)
    got = {(r.window_start, r.engine): r["items"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.engine): r["items"] for r in streaming.windowed_stats(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()}
    last = max(w for w, _ in want)
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k[0] < last} <= set(got)


def test_detection_writer_appends_and_overwrites(spark, tmp_path):
    from framelake.sources.detbin import NAMES

    folder = str(tmp_path / "out")
    row = lambda path, kind, frame, i: (path, kind, frame, i, 1.0, 2.0, 3.0, 4.0, 0.5, 0, []) if i is not None else (path, kind, frame, None, None, None, None, None, None, None, None)
    df = lambda *rows: spark.createDataFrame(list(rows), detbin.DETECTION_FILE)
    detbin.write_detections(df(row("a.bin", 0, 2, 0), row("a.bin", 0, 2, 1), row("a.bin", 0, 1, None), row("b.bin", 1, 1, 0)), folder)
    detbin.write_detections(df(row("a.bin", 0, 2, 0)), folder)
    read = lambda: sorted((r.path[-5:], r.model_type, r.frame_number, -1 if r.det_index is None else r.det_index) for r in detbin.read_detections(spark, folder, "FAILFAST").collect())
    assert read() == [("a.bin", 0, 1, -1), ("a.bin", 0, 2, 0), ("a.bin", 0, 2, 0), ("a.bin", 0, 2, 1), ("b.bin", 1, 1, 0)]
    with pytest.raises(Exception, match="another model type"):
        detbin.write_detections(df(row("b.bin", 0, 1, 0)), folder)
    detbin.write_detections(df(row("c.bin", 0, 1, 0)), folder, "overwrite")
    assert read() == [("c.bin", 0, 1, 0)]
    with pytest.raises(ValueError, match="mounted"):
        detbin.DetBinWriter({"path": "hdfs://host/x"}, False)
    assert len(NAMES) == 11


def test_detection_parquet(spark, tmp_path):
    rows = [(v, e, f"{v}.bin", 0, f, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 0, []) for v in range(3) for e in "ab" for f in range(4)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("video_id", T.IntegerType()), T.StructField("engine", T.StringType()), *detbin.DETECTION_FILE.fields])
    df = spark.createDataFrame(rows, schema)
    for _ in range(2):
        detbin.write_parquet(df, str(tmp_path / "p"))
    back = detbin.read_parquet(spark, str(tmp_path / "p"))
    assert back.count() == 48 and back.where("video_id = 1 and engine = 'a'").count() == 8
    assert (tmp_path / "p" / "video_id=1" / "engine=a").is_dir()


def test_engine_batch_sizes_win():
    c = config.Config(engines=[{**config.MODEL, "name": "a", "path": "x", "batch_size": 4}, {**config.MODEL, "name": "b", "path": "y"}])
    warnings = c.use_engine_batches({"a": 16, "b": 1, "c": 3})
    assert [e["batch_size"] for e in c.engines] == [16, 1] and len(warnings) == 1 and "16" in warnings[0]


def test_images(spark, tmp_path):
    from framelake.operators import frames

    for i in range(3):
        (tmp_path / f"{i}.raw").write_bytes(bytes([i + 1, 2]) + bytes(6 * (i + 1)))
    got = frames.scan_images(spark, str(tmp_path), lambda b: (b[0], b[1], b[2:]), "*.raw").orderBy("path").collect()
    assert [(r.width, r.height, len(r.image)) for r in got] == [(1, 2, 6), (2, 2, 12), (3, 2, 18)]


# Output of a detection model of 5 channels and 8400 anchors, its first ten anchors and its most confident ones.
FIRST_ANCHORS = [(4.80859, 9.3125, 8.71094, 16.9375, 1.49012e-07), (22.9688, 9.84375, 43.875, 18.875, 0), (23.125, 9.82812, 44.375, 18.5938, 0), (25.1406, 7.87109, 47.0312, 14.8828, 0), (29.875, 6.03906, 49.75, 11.3906, 0), (41.1562, 5.00391, 43.75, 9.46094, 0), (52.6562, 4.625, 38.9375, 8.65625, 0), (60.875, 4.61328, 38.75, 8.61719, 0), (68.875, 4.60547, 38.8125, 8.60156, 0), (76.875, 4.59375, 38.8125, 8.57812, 0)]
TOP_ANCHORS = [(6399, 1.78814e-07, 634, 628, 11.5, 22.5), (8399, 1.49012e-07, 606, 585.5, 251.25, 210.25), (8398, 1.49012e-07, 569, 575.5, 245.5, 241.75), (8397, 1.49012e-07, 552, 568, 273.5, 235.5), (8396, 1.49012e-07, 544, 564.5, 318.5, 236)]


def test_recorded_model_output(spark, tmp_path):
    from framelake.operators import tensors as T
    from framelake.plans import tools

    x = np.zeros((5, 8400), np.float32)
    x[:, :10] = np.array(FIRST_ANCHORS, np.float32).T
    for a, conf, *box in TOP_ANCHORS:
        x[:, a] = [*box, conf]
    (tmp_path / "outputs_batch000000.bin").write_bytes(np.tile(x, (2, 1, 1)).tobytes())
    raw = tensors.read_tensors(spark, str(tmp_path), 2, 5)
    one = raw.where("item = 1").select(F.explode(F.slice(T.to_anchor_rows(F.col("tensor"), 5, 8400), 1, 10)).alias("v")).collect()
    np.testing.assert_allclose([r.v for r in one], FIRST_ANCHORS, rtol=1e-6)
    profile, top = tools.raw_report(spark, str(tmp_path), 2, 5, 10)
    best = top.where("item = 1").orderBy(F.desc("confidence"), F.desc("anchor")).collect()
    assert [r.anchor for r in best] == [6399, 8399, 8398, 8397, 8396]
    assert [(r.cx, r.cy, r.w, r.h) for r in best] == [tuple(map(float, t[2:])) for t in TOP_ANCHORS]
    assert all(round(r.sigmoid, 4) == 0.5 for r in best) and profile.count() == 2
    assert tools.process_outputs(spark, str(tmp_path), 2, 5, 0.2, 0.55).count() == 0


def test_onnx_model(spark, tmp_path):
    path = str(tmp_path / "m.onnx")
    (tmp_path / "m.onnx").write_bytes(models.adding_model(4))
    graph = models.onnx_graph(path)
    assert graph["inputs"] == [("x", ["n", 4], "tensor(float)")] and graph["outputs"][0][0] == "y"
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "i int, t array<float>")
    assert {r.i: r.output for r in models.infer(df, "t", models.onnx_model(path), 4, [4]).collect()} == {i: [2.0 * i] * 4 for i in range(10)}


# Frames of clips




def counted_clip(path, first):
    """A clip named <file to count in>#<frames>."""
    log, n = path.split("#")
    for i in range(first, int(n)):
        with open(log, "a") as f:
            f.write(f"{i}\n")
        yield i, 2, 1, bytes([i % 256] * 6)


counted_clip.info = lambda path: (int(path.split("#")[1]), 0.0)
CLIP = "video_id int, path string, moment_time double, start_ts double, end_ts double"


def touched(path):
    n = len(path.read_text().splitlines()) if path.exists() else 0
    path.unlink(missing_ok=True)
    return n


@pytest.mark.parametrize("split", [0, 10])
def test_filters_on_frames_become_seeks(spark, tmp_path, capsys, split):
    from framelake.operators.frames import scan_clips
    from framelake.sources import clips

    log = tmp_path / "log"
    inf = float("inf")
    rows = [(0, f"{log}#1000", 0.0, -inf, inf), (1, f"{log}#1000", 100.0, 101.0, 110.0), (2, f"{log}#50", 5.0, 1.0, 7.05), (3, f"{log}#9", 0.0, inf, inf)]
    listed = spark.createDataFrame(rows, CLIP)
    scanned = scan_clips(listed, counted_clip, 10.0).toPandas()
    touched(log)
    read = lambda where=None: clips.read_frames(spark, listed, "tests.test_sources:counted_clip", 10.0, split, where=where)
    cases = [
        ("ts >= 20 and ts < 21", 10 + 0 + 0, lambda d: d[(d.ts >= 20) & (d.ts < 21)]),
        ("frame_pos between 30 and 32", 3 * 3, lambda d: d[d.frame_pos.between(30, 32)]),
        ("video_id = 1", 91, lambda d: d[d.video_id == 1]),
        ("video_id = 1 and frame_number in (3, 5)", 3, lambda d: d[(d.video_id == 1) & d.frame_number.isin([3, 5])]),
        ("frame_number <= 2", 6, lambda d: d[d.frame_number <= 2]),
        ("video_id > 5", 0, lambda d: d[d.video_id > 5]),
        ("frame_pos = 7 and ts > 0.8", 1, lambda d: d[(d.frame_pos == 7) & (d.ts > 0.8)]),
        ("frame_pos = 3 or ts = 4", None, lambda d: d[(d.frame_pos == 3) | (d.ts == 4)]),
        ("width = 2 and frame_pos < 4 and frame_pos > 1.5", None, lambda d: d[(d.frame_pos < 4) & (d.frame_pos > 1.5)]),
    ]
    for where, most, want in cases:
        got = sorted((r.video_id, r.frame_pos, r.frame_number, r.ts, bytes(r.image)) for r in read(where).collect())
        n = touched(log)
        assert got == sorted((int(r.video_id), int(r.frame_pos), int(r.frame_number), r.ts, r.image) for r in want(scanned).itertuples()), where
        assert most is None or n <= most + 6, (where, n)  # a frame more at each end, for rounding of the clock
    read("ts >= 20 and ts < 21").explain("formatted")
    plan = capsys.readouterr().out.replace(" ", "")
    assert "PushedFilters:[" in plan and "GreaterThanOrEqual(ts,20.0),LessThan(ts,21.0)" in plan and ">=20" not in plan
    if split:
        assert read("video_id = 0").rdd.getNumPartitions() == 100
    # What is pushed to one DataFrame must not reach queries on it or on others.
    df = read("frame_pos < 5")
    assert df.where("frame_pos = 1").count() == 2 + 0 and df.count() == 5 + 5 and df.union(read("frame_pos = 2")).count() == 12
    assert df.where("frame_pos = 3 or ts = 0.2").count() == 3 and read().count() == len(scanned)


def test_more_clips_than_are_listed(spark, tmp_path, monkeypatch):
    from framelake.sources import clips

    monkeypatch.setattr(clips, "LISTED", 1)
    listed = spark.createDataFrame([(i, f"{tmp_path}/log#20", 0.0, 0.0, 1.0) for i in range(3)], CLIP)
    assert clips.read_frames(spark, listed, "tests.test_sources:counted_clip", 10.0, where="frame_pos >= 8").count() == 6


def test_numpy_clips(spark, tmp_path):
    from framelake.sources import clips

    rows = [(v, p, 2, 1, bytes([v, p, 0, 1, 2, 3])) for v in (1, 2) for p in (2, 0, 1)]
    df = spark.createDataFrame(rows, "video_id int, frame_pos long, width int, height int, image binary").repartition(3)
    clips.write_npy_clips(df, str(tmp_path))
    clips.write_npy_clips(df, str(tmp_path))
    assert np.load(tmp_path / "clip_2.npy").tolist() == [[[[2, p, 0], [1, 2, 3]]] for p in range(3)]
    listed = df.select("video_id").distinct().select("video_id", clips.clip_path(str(tmp_path), F.col("video_id")).alias("path"), *(F.lit(x).alias(n) for n, x in (("moment_time", 0.0), ("start_ts", 0.0), ("end_ts", 9.0))))
    got = clips.read_frames(spark, listed, "framelake.sources.clips:npy_clip", 1.0).where("frame_pos = 1 and video_id = 2").collect()
    assert [(r.frame_number, r.ts, r.width, r.height, bytes(r.image)) for r in got] == [(2, 2.0, 2, 1, bytes([2, 1, 0, 1, 2, 3]))]
    assert clips.read_frames(spark, listed, "framelake.sources.clips:npy_clip", 1.0, images=False).where("image is null").count() == 6


def test_clips_that_cannot_be_decoded(spark, tmp_path):
    from framelake.operators.frames import scan_clips

    def decoder(path, first):
        for i in range(first, 5):
            if path == "bad" and i == 3:
                raise OSError("cut")
            yield i, 1, 1, b"abc"

    listed = spark.createDataFrame([(0, "good", 0.0, 0.0, 9.0), (1, "bad", 0.0, 0.0, 9.0)], CLIP)
    got = scan_clips(listed, decoder, 1.0, max_frames=4, error="error").collect()
    assert sorted((r.video_id, r.frame_number or 0, r.error) for r in got) == [(0, 1, None), (0, 2, None), (0, 3, None), (0, 4, None), (1, 0, "OSError: cut"), (1, 1, None), (1, 2, None), (1, 3, None)]
    with pytest.raises(Exception, match="cut"):
        scan_clips(listed, decoder, 1.0).collect()


# Detection files: index, commits


def det_rows(spark, rows):
    """Rows (path, frame, index or None, keypoints) with values that tell them apart."""
    full = [(p, 1, f, i, *((float(f), i + 0.5, 2.0, 3.0, 0.25, 7, [(float(k), 1.0, 0.5) for k in range(n)]) if i is not None else [None] * 7)) for p, f, i, n in rows]
    return spark.createDataFrame(full, detbin.DETECTION_FILE)


def many_rows(files=("a.bin", "b.bin"), frames=300):
    return [(p, f, None if f % 7 == 0 else i, i % 3 * (f % 2)) for p in files for f in range(1, frames) for i in range(1 if f % 7 == 0 else f % 5 + 1)]


def flat(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.model_type, r.frame_number, -1 if r.det_index is None else r.det_index, r.cx, r.cy, r.confidence, r.class_id, None if r.keypoints is None else [tuple(k) for k in r.keypoints]) for r in df.collect())


def test_written_files_field_by_field(spark, tmp_path):
    df = det_rows(spark, many_rows())
    detbin.write_detections(df.repartition(5), str(tmp_path))
    for name in ("a.bin", "b.bin"):
        frames = {}
        for r in df.where(F.col("path") == name).collect():
            frames.setdefault(r.frame_number, []).extend([] if r.det_index is None else [(r.det_index, (r.cx, r.cy, r.w, r.h, r.confidence, r.class_id, [tuple(k) for k in r.keypoints]))])
        assert (tmp_path / name).read_bytes() == encode(1, [(f, [d for _, d in sorted(found)]) for f, found in sorted(frames.items())])
    assert flat(detbin.read_detections(spark, str(tmp_path), "FAILFAST")) == flat(df)


def test_index_splits_files_and_skips_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(detcodec, "ROWS", 50)
    (tmp_path / "plain.bin").write_bytes(encode(1, [(f, [DET] * (f % 3)) for f in range(400)]))
    data = encode(1, [(f, [POSE] * (f % 3)) for f in range(400)])
    (tmp_path / "half.bin").write_bytes(data[: len(data) // 2])
    for f in (tmp_path / "plain.bin", tmp_path / "half.bin"):
        detbin.Index.build(str(f)).write(str(f))
    with open(tmp_path / "half.bin", "ab") as f:  # someone appends
        f.write(data[len(data) // 2 :])
    (tmp_path / "bare.bin").write_bytes(data)
    want = flat(detbin.read_detections(spark, str(tmp_path)))
    df = detbin.read_frames_of(spark, str(tmp_path), split=4000)
    assert flat(df) == want and df.rdd.getNumPartitions() > 12
    some = detbin.read_frames_of(spark, str(tmp_path), 100, 110, split=4000)
    assert flat(some) == [r for r in want if 100 <= r[2] <= 110]
    part = [detbin.ranges(str(tmp_path / f), 100, 110) for f in ("plain.bin", "half.bin", "bare.bin")]
    read = [sum((r.end or (tmp_path / r.path).stat().st_size) - r.start for r in p) / (tmp_path / p[0].path).stat().st_size for p in part]
    assert read[0] < 0.2 and 0.4 < read[1] < 0.8 and read[2] > 0.99
    (tmp_path / "plain.bin").write_bytes(data[:9000])  # another file under the name: the index is not used
    assert detbin.Index.read(str(tmp_path / "plain.bin")) is None
    assert detbin.index_files(spark, str(tmp_path)) == 3 and detbin.index_files(spark, str(tmp_path)) == 1  # the rest of the cut file is no frame
    assert flat(detbin.read_frames_of(spark, str(tmp_path))) == flat(detbin.read_detections(spark, str(tmp_path)))


def test_writer_makes_and_extends_the_index(spark, tmp_path, monkeypatch):
    detbin.write_detections(det_rows(spark, many_rows()), str(tmp_path))
    detbin.write_detections(det_rows(spark, [("a.bin", 5000, 0, 2), ("c.bin", 1, None, 0)]), str(tmp_path))
    for name in ("a.bin", "b.bin", "c.bin"):
        index = detbin.Index.read(str(tmp_path / name))
        assert index.size == (tmp_path / name).stat().st_size and index.blocks["start"][0] == 4
    assert [(r.end - r.start) for r in detbin.ranges(str(tmp_path / "a.bin"), 5000)] == [4 * (2 + 7 + 6)]
    assert flat(detbin.read_frames_of(spark, str(tmp_path), 4000)) == [("a.bin", 1, 5000, 0, 5000.0, 0.5, 0.25, 7, [(0.0, 1.0, 0.5), (1.0, 1.0, 0.5)])]


def test_long_lists_are_parsed_once(spark, tmp_path):
    """A list of several files and blocks is numbered in its order, and its lines are read by one job only."""
    folder = tmp_path / "list"
    folder.mkdir()
    names = [f"clip_{i:05d}.mp4" for i in range(3000)]
    for k in range(3):
        (folder / f"part-{k:05d}.txt").write_text("".join(f"{n}\n# no\n" for n in names[1000 * k : 1000 * (k + 1)]))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        got = manifest.read_manifest(spark, str(folder), "plain")
        for f in folder.iterdir():
            f.unlink()  # what follows does not go back to the lines
        assert [tuple(r) for r in got.select("video_id", "path").orderBy("video_id").collect()] == list(enumerate(names))
    finally:
        spark.conf.set(key, before)


def test_detections_are_read_by_ranges(spark, tmp_path):
    """A large file is never one value of a row."""
    frame = np.zeros(2 + 1000 * 7, "<i4")
    frame[1] = 1000
    words = np.tile(frame, (1500, 1))
    words[:, 0] = np.arange(1500)
    (tmp_path / "a.bin").write_bytes(struct.pack("<i", 0) + words.tobytes())
    detbin.Index.build(str(tmp_path / "a.bin")).write(str(tmp_path / "a.bin"))
    df = detbin.read_detections(spark, f"file://{tmp_path}", "FAILFAST")
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.count("det_index"), F.countDistinct("frame_number")).first() == (1_500_000, 1500)
    assert detbin.read_detections(spark, str(tmp_path), max_frames=7).count() == 7000


def test_strict_reading_knows_the_frames_that_were_written(spark, tmp_path):
    rows = [("a.bin", 5, 0, 1), ("a.bin", 2_000_000, 0, 1), ("b.bin", 3_000_000, None, 0)]
    detbin.write_detections(det_rows(spark, rows), str(tmp_path))
    detbin.write_detections(det_rows(spark, [("a.bin", 4_000_000, 0, 1)]), str(tmp_path))
    assert [r[2] for r in flat(detbin.read_detections(spark, str(tmp_path), "FAILFAST"))] == [5, 2_000_000, 4_000_000, 3_000_000]
    assert [r[2] for r in flat(detbin.read_detections(spark, str(tmp_path), "FAILFAST", max_frames=2))] == [5, 2_000_000, 3_000_000]
    with open(tmp_path / "b.bin", "ab") as f:  # bytes of others are held to the usual numbers, with and without an index
        f.write(encode(0, [(3_000_001, [])])[4:])
    for _ in range(2):
        with pytest.raises(Exception, match="frame 300000"):
            detbin.read_detections(spark, str(tmp_path), "FAILFAST").collect()
        detbin.index_files(spark, str(tmp_path))


@pytest.mark.parametrize("step", range(7))
def test_commits_that_die_are_finished(spark, tmp_path, monkeypatch, step):
    """A commit is killed at one of its steps; whoever comes next finishes it, and nothing is there twice."""
    import os as real

    first, second = many_rows(frames=40), [(p, f + 100, i, n) for p, f, i, n in many_rows(("b.bin", "c.bin"), 30)]
    whole, out = str(tmp_path / "whole"), str(tmp_path / "out")
    for rows in (first, second):
        detbin.write_detections(det_rows(spark, rows), whole)
    detbin.write_detections(det_rows(spark, first), out)

    parts, writer = [], detbin.DetBinWriter({"path": out, "job": "two"}, False)
    for names in (("b.bin",), ("c.bin",)):
        t = det_rows(spark, [r for r in second if r[0] in names]).orderBy("path", "frame_number", "det_index").toArrow()
        parts.append(writer.write(iter(t.to_batches(max_chunksize=37))))
    calls = []

    class Dying:
        """os, but for the step-th change, which never comes."""

        def __getattr__(self, name):
            def counted(*a, **kw):
                calls.append(name)
                if len(calls) > step:
                    raise KeyboardInterrupt
                return getattr(real, name)(*a, **kw)

            return counted if name in ("replace", "remove", "fsync") else getattr(real, name)

    monkeypatch.setattr(detbin, "os", Dying())
    try:
        writer.commit(parts)
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(detbin, "os", real)
    note = real.path.exists(real.path.join(out, detbin.NOTE))
    got = flat(detbin.read_frames_of(spark, out))  # reading finishes a job whose note is written
    assert got == flat(detbin.read_detections(spark, whole if note or step > 4 else out)) and not real.path.exists(real.path.join(out, detbin.NOTE))
    if got != flat(detbin.read_detections(spark, whole)):
        assert got == flat(det_rows(spark, first))
    detbin.write_detections(det_rows(spark, second), out, job="two")  # repeated: done once
    assert flat(detbin.read_detections(spark, out)) == flat(detbin.read_detections(spark, whole))
    for name in ("a.bin", "b.bin", "c.bin"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "whole" / name).read_bytes()
        assert detbin.Index.read(real.path.join(out, name)).size == (tmp_path / "out" / name).stat().st_size


def test_pieces_of_a_file_are_put_together_in_order(spark, tmp_path, monkeypatch):
    rows = many_rows(("a.bin",), 60)
    detbin.write_detections(det_rows(spark, rows), str(tmp_path / "one"))
    monkeypatch.setattr(detbin, "PIECE", 10)
    writer, parts = detbin.DetBinWriter({"path": str(tmp_path / "two")}, True), []
    for odd in (1, 0):  # a task has pieces 1, 3 and 5, another 0, 2 and 4
        t = det_rows(spark, [r for r in rows if r[1] // 10 % 2 == odd]).orderBy("frame_number", "det_index").toArrow()
        parts.append(writer.write(iter(t.to_batches())))
    writer.commit(parts)
    assert (tmp_path / "two" / "a.bin").read_bytes() == (tmp_path / "one" / "a.bin").read_bytes()
    blocks = detbin.Index.read(str(tmp_path / "two" / "a.bin")).blocks
    assert (np.diff(blocks["start"]) > 0).all() and blocks["low"].tolist() == sorted(blocks["low"]) and {10, 20, 30, 40, 50} <= set(blocks["low"])


def test_files_of_numbers_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tensors, "STEP", 7)
    rng = np.random.default_rng(2)
    a = rng.normal(size=1000).astype("<f4")
    b = np.concatenate([a + (rng.random(1000) < 0.1) * rng.normal(size=1000) + 0, [1, 2]]).astype("<f4")
    a.tofile(tmp_path / "a")
    b.tofile(tmp_path / "b")
    read = tensors.read_blocks(spark, str(tmp_path / "a"), block=100)
    parts = sorted(read.collect())
    assert [v for r in parts for v in r["values"]] == a.tolist() and max(len(r["values"]) for r in parts) == 7 and read.rdd.getNumPartitions() == 10
    d = np.abs(a.astype(float) - b[:1000].astype(float))
    for block in (100, 1 << 20):
        r = tensors.diff_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), tol=0.5, block=block).first()
        assert (r.n, r.n_a, r.n_b, r.n_over) == (1000, 1000, 1002, int((d > 0.5).sum()))
        assert [r.max_abs, r.mean_abs, r.rms] == pytest.approx([d.max(), d.mean(), np.sqrt((d * d).mean())])
        top = tensors.top_differences(spark, str(tmp_path / "a"), str(tmp_path / "b"), 5, block=block).collect()
        assert [t.pos for t in top] == np.lexsort((np.arange(1000), -d))[:5].tolist() and top[0].abs_diff == d.max()
    for side, files in (("x", (a, b[:500], a[:0])), ("y", (b, a, a, a))):
        (tmp_path / side).mkdir()
        for i, v in enumerate(files):
            v.tofile(tmp_path / side / f"outputs_batch{i}.bin")
    rows = tensors.diff_folders(spark, str(tmp_path / "x"), str(tmp_path / "y"), tol=0.5, block=90).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n, r.n_over) for r in rows] == [(0, 1000, int((d > 0.5).sum())), (1, 500, int((d[:500] > 0.5).sum())), (2, 0, 0)]
    assert rows[1].mean_abs == pytest.approx(d[:500].mean()) and rows[2].max_abs is None
    (tmp_path / "c").write_bytes(b"abc")
    with pytest.raises(ValueError, match="3 bytes"):
        tensors.diff_files(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    (tmp_path / "d").write_bytes(b"")
    assert tensors.diff_files(spark, str(tmp_path / "a"), str(tmp_path / "d")).first().n == 0
