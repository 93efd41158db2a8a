"""Runs that are killed and taken up again, and what they leave behind."""

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from framelake.operators import application
from framelake.sources import clips as clip_files
from framelake.sources import config
from framelake.sources.clips import npy_clip

ENGINES = [{"name": n, "path": n, "type": t, "batch_size": 4, "input_width": 8, "input_height": 8, "conf_threshold": 0.25, "nms_threshold": 0.5, "roi_cropping": crops, "anchors": 1} for n, t, crops in (("a", "detection", False), ("b", "detection", True))]


def model():
    """One box of each image, as confident as its darkest pixel is bright; fails on images with a pixel of 250."""

    def predict(x):
        if (x >= 249 / 255).any():
            raise RuntimeError("too bright")
        n = len(x)
        return np.stack([np.full(n, 4.0), np.full(n, 4.0), np.full(n, 2.0), np.full(n, 2.0), x.reshape(n, -1).min(axis=1)], axis=1)

    return predict


@pytest.fixture
def videos(spark, tmp_path):
    """Five clips of 8 x 8 pixels with 3 to 7 frames, one of them unreadable, one with a frame that the models refuse."""
    rows = []
    for v in range(5):
        for p in range(3 + v):
            rows.append((v, p, 8, 8, bytes([250 if (v, p) == (2, 1) else 20 * p + 40]) * 192))
    df = spark.createDataFrame(rows, "video_id int, frame_pos long, width int, height int, image binary")
    clip_files.write_npy_clips(df, str(tmp_path / "in"))
    (tmp_path / "in" / "clip_4.npy").write_bytes(b"no clip")
    roi = "struct<x1:float,y1:float,x2:float,y2:float>"
    some = [(v, str(tmp_path / "in" / f"clip_{v}.npy"), 0.0, 0.0, 100.0, (0.25, 0.25, 0.75, 0.75) if v == 1 else None) for v in range(5)]
    return spark.createDataFrame(some, f"video_id int, path string, moment_time double, start_ts double, end_ts double, roi {roi}")


def go(spark, videos, out, engines=ENGINES, **kw):
    return application.run(spark, config.Config(list(engines)), lambda c: application.clip_scan(c, npy_clip, 1.0), {e["name"]: model for e in engines}, str(out), clips=videos, per_wave=2, **kw)


def rows_of(spark, out):
    return sorted((tuple(r) for r in application.results(spark, str(out)).drop("keypoints").collect()), key=str)


def test_killed_run_gives_what_one_run_gives(spark, videos, tmp_path, monkeypatch):
    done = go(spark, videos, tmp_path / "one")
    want = rows_of(spark, tmp_path / "one")
    frames = {(r[0], r[1], r[4]) for r in want}
    assert len(frames) == len(want) == 2 * (3 + 4 + 5 + 6 + 1)  # one box of each frame, one row of the unreadable clip
    counts = {(r.video_id, r.engine): (r.frames, r.detections, r.failed) for r in done.collect()}
    assert counts[2, "a"] == (5, 3, 1) and counts[3, "b"] == (6, 4, 0) and counts[4, "a"] == (0, 0, 1) and len(counts) == 10
    assert {r.wave for r in done.collect()} == {x.name.removeprefix("wave=") for x in (tmp_path / "one" / "detections").iterdir() if x.is_dir()}

    out, commit, calls = tmp_path / "two", application._write_commits, []

    def dies(rows, output):
        calls.append(1)
        if len(calls) in (2, 4):
            raise KeyboardInterrupt
        commit(rows, output)

    monkeypatch.setattr(application, "_write_commits", dies)
    for _ in range(2):  # each run commits one wave more and dies in the next, whose detections are written
        with pytest.raises(KeyboardInterrupt):
            go(spark, videos, out)
        part = rows_of(spark, out)
        assert part != want and set(part) < set(want)
    monkeypatch.setattr(application, "_write_commits", commit)
    go(spark, videos, out, max_waves=1)
    go(spark, videos, out)
    assert rows_of(spark, out) == want
    before = sorted(x.name for x in (out / "commits").iterdir())
    go(spark, videos, out)  # nothing is left to do
    assert sorted(x.name for x in (out / "commits").iterdir()) == before
    assert application.vacuum(spark, str(out)) == 2 and application.vacuum(spark, str(out)) == 0
    assert rows_of(spark, out) == want


def test_clips_are_decoded_once_for_all_engines(spark, videos, tmp_path):
    log = str(tmp_path / "log")

    def counting(path, first):
        for frame in npy_clip(path, first):
            with open(log, "a") as f:
                f.write("x\n")
            yield frame

    application.run(spark, config.Config(list(ENGINES)), lambda c: application.clip_scan(c, counting, 1.0), {e["name"]: model for e in ENGINES}, str(tmp_path / "out"), clips=videos)
    with open(log) as f:
        assert len(f.readlines()) == 18
    assert application.commits(spark, str(tmp_path / "out")).count() == 10


def test_models_run_in_several_tasks_however_small_the_frames(spark, videos, tmp_path):
    log = str(tmp_path / "log")

    def logging():
        predict = model()

        def told(x):
            with open(log, "a") as f:
                f.write(f"{TaskContext.get().partitionId()}\n")
            return predict(x)

        return told

    application.run(spark, config.Config(ENGINES[:1]), lambda c: application.clip_scan(c, npy_clip, 1.0), {"a": logging}, str(tmp_path / "out"), clips=videos)
    with open(log) as f:
        assert len(set(f)) > 1  # by bytes, a task would do for all of these frames


def test_failures_and_summary(spark, videos, tmp_path):
    go(spark, videos, tmp_path)
    bad = sorted(tuple(r) for r in application.failures(spark, str(tmp_path)).where("engine = 'a'").collect() if r.frame_number)
    assert bad == [(2, "a", 2, "RuntimeError: too bright")]
    lost = application.failures(spark, str(tmp_path)).where("frame_number is null").collect()
    assert {(r.video_id, r.engine) for r in lost} == {(4, "a"), (4, "b")} and all("ValueError" in r.error for r in lost)
    assert sorted((r.engine, r.clips, r.frames, r.failed) for r in application.summary(spark, str(tmp_path)).collect()) == [("a", 5, 18, 2), ("b", 5, 18, 2)]
    b = application.results(spark, str(tmp_path)).where("det_index = 0 and video_id = 1")
    assert {(r.engine, r.cx, r.w) for r in b.collect()} == {("a", 4.0, 2.0), ("b", 4.0, 1.0)}  # the crop of 4 pixels is shown twice as large


def test_new_engines_and_clips_are_done_alone(spark, videos, tmp_path):
    go(spark, videos.where("video_id < 2"), tmp_path, ENGINES[:1])
    first = {(r.video_id, r.engine): r.wave for r in application.commits(spark, str(tmp_path)).collect()}
    moved = videos.where("video_id < 3").withColumn("path", F.when(F.col("video_id") == 0, F.col("path")).otherwise(F.concat("path", F.lit(""))))
    go(spark, moved.withColumn("path", F.when(F.col("video_id") == 1, F.concat(F.lit("file://"), "path")).otherwise(F.col("path"))), tmp_path)
    then = {(r.video_id, r.engine): r.wave for r in application.commits(spark, str(tmp_path)).collect()}
    assert len(then) == 6 and then[0, "a"] == first[0, "a"] and then[1, "a"] != first[1, "a"]  # another path: done again, and the old rows are not read
    assert application.results(spark, str(tmp_path)).where("video_id = 1 and engine = 'a'").count() == 4


def test_nothing_to_do(spark, tmp_path):
    with pytest.raises(ValueError, match="no engine; no clip"):
        application.run(spark, config.Config(), lambda c: c, {}, str(tmp_path))
    assert application.results(spark, str(tmp_path)).count() == 0 and application.commits(spark, str(tmp_path)).count() == 0 and application.vacuum(spark, str(tmp_path)) == 0


def test_command_line(spark, videos, tmp_path, monkeypatch):
    monkeypatch.setattr(application.models, "onnx_graph", lambda path: {"inputs": [("x", [2, 3, 8, 8], "f")], "outputs": [("y", ["n", 5, 1], "f")]})
    monkeypatch.setattr(application.models, "onnx_model", lambda path: model)
    (tmp_path / "c.yaml").write_text("models: [{path: m.onnx, name: m, input_width: 8, input_height: 8, batch_size: 3}]\ndebug: {enabled: true, max_frames_per_video: 2}\n")
    argv = ["--config", str(tmp_path / "c.yaml"), "--output-dir", str(tmp_path / "out"), "--fps", "1", "--vacuum", "--videos", *(str(tmp_path / "in" / f"clip_{v}.npy") for v in range(4))]
    got = application.main(argv, npy_clip, spark).collect()
    assert [tuple(r) for r in got] == [("m", 4, 8, 0, 1)]  # the first two frames of each clip are too dark, or refused
