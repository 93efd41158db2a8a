"""Streams of growing detection files, batches across micro-batches, live rates."""

import time

import pytest
from pyspark.sql import functions as F

from framelake.operators.batching import batches
from framelake.streaming import detections, metrics
from tests.test_sources import DET, POSE, encode

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frames(lo, hi):
    return [(f, [POSE if f % 5 == 0 else DET] * (f % 3)) for f in range(lo, hi)]


def run(spark, folder, sink, **kw):
    q = detections.stream_detections(spark, str(folder), **kw).writeStream.format("parquet").option("path", f"{sink}/out").option("checkpointLocation", f"{sink}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return [p for p in q.recentProgress if p.numInputRows]


def rows_of(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.frame_number, -1 if r.det_index is None else r.det_index) for r in df.collect())


def want(*files):
    return sorted((name, f, i) for name, fs in files for f, found in fs for i in (range(len(found)) if found else [-1]))


def test_appended_frames_come_once(spark, tmp_path):
    folder, sink = tmp_path / "in", tmp_path / "sink"
    folder.mkdir()
    data = encode(0, frames(0, 40))
    (folder / "a.bin").write_bytes(data[:-13])  # the last frame is half written
    (folder / "b.bin").write_bytes(b"\0\0")  # not even a model type
    run(spark, folder, sink)
    read = lambda: rows_of(spark.read.parquet(f"{sink}/out"))
    assert read() == want(("a.bin", frames(0, 38)))  # frame 39 has no detections and is cut away whole
    with open(folder / "a.bin", "ab") as f:
        f.write(data[-13:] + encode(0, frames(40, 60))[4:])
    (folder / "b.bin").write_bytes(encode(0, frames(0, 9)))
    (folder / "c.bin").write_bytes(encode(0, []))
    run(spark, folder, sink)  # a restart goes on from its checkpoint
    every = want(("a.bin", frames(0, 60)), ("b.bin", frames(0, 9)))
    assert read() == every
    run(spark, folder, sink)
    assert read() == every


def test_bytes_of_a_micro_batch_are_limited(spark, tmp_path, monkeypatch):
    from framelake.sources import detcodec

    monkeypatch.setattr(detcodec, "ROWS", 4)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(encode(0, frames(0, 200)))
    r = detections.DetBinStream({"path": str(folder), "maxbytes": "2000", "progress": str(tmp_path / "progress")})
    offsets, seen = [r.initialOffset()], []
    for i in range(100):
        end = r.latestOffset()
        if end == offsets[-1]:
            break
        parts = r.partitions(offsets[-1], end)
        assert sum(p.end - p.start for p in parts) < 2000 + 4 * 250 * 5
        seen += [x for p in parts for b in r.read(p) for x in zip(b.column("frame_number").to_pylist(), b.column("det_index").to_pylist(), strict=True)]
        offsets.append(end)
        if i % 3 == 0:  # the query dies and is started again, with or without the last batch committed
            r = detections.DetBinStream({"path": str(folder), "maxbytes": "2000", "progress": str(tmp_path / "progress")})
            if i % 2:
                r.partitions(offsets[-2], offsets[-1])
    assert [(f, -1 if k is None else k) for f, k in seen] == [(f, k) for _, f, k in want(("a.bin", frames(0, 200)))] and len(offsets) > 5
    with pytest.raises(ValueError, match="progress"):
        detections.DetBinStream({"path": str(folder), "maxbytes": "1"})
    (folder / "a.bin").write_bytes(b"\0" * 8)
    with pytest.raises(ValueError, match="shorter"):
        r.latestOffset()


def test_limited_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, sink = tmp_path / "in", tmp_path / "sink"
    folder.mkdir()
    (folder / "a.bin").write_bytes(encode(0, frames(0, 40)))
    for n in (60, 80):
        for _ in range(3):
            run(spark, folder, sink, max_bytes=100_000, progress=str(tmp_path / "progress"))
        with open(folder / "a.bin", "ab") as f:
            f.write(encode(0, frames(n - 20, n))[4:])
    run(spark, folder, sink, max_bytes=100_000, progress=str(tmp_path / "progress"))
    assert rows_of(spark.read.parquet(f"{sink}/out")) == want(("a.bin", frames(0, 80)))


def test_finished_works_through_all_of_a_limited_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    more = [(f, [DET] * 3) for f in range(20_000)]
    (folder / "a.bin").write_bytes(encode(0, more))
    detections.finished(detections.stream_detections(spark, str(folder), 500_000, str(tmp_path / "progress")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want(("a.bin", more))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


SCHEMA = "engine string, pos long, v double"


@pytest.mark.parametrize("cuts", [(100,), (1, 2, 3, 40, 41, 100), (17, 50, 83, 100)])
def test_batches_go_on_over_micro_batches(spark, tmp_path, rocks, cuts):
    rows = [("ab"[i % 3 == 0], i, None if i % 7 == 0 else i / 2) for i in range(100)]
    whole = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r.engine, r.pos, r.v, r.batch, r.slot)
    at = 0
    for i, end in enumerate(cuts):  # one restart after each part
        spark.createDataFrame(rows[at:end], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at = end
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = detections.stream_batches(stream, 16, ["engine"], ["pos"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(key, got), key=str) == sorted(map(key, batches(whole, 16, ["engine"], ["pos"], "drop").collect()), key=str) and all(r.is_full for r in got)


def test_unfinished_batches_are_flushed(spark, tmp_path, rocks):
    rows = [("ab"[i % 3 == 0], i, i / 2) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = detections.stream_batches(stream, 16, ["engine"], ["pos"], "pad", 1500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    want = sorted((r.engine, r.pos, r.batch, r.slot) for r in batches(spark.createDataFrame(rows, SCHEMA), 16, ["engine"], ["pos"], "pad").collect())
    until, got = time.time() + 90, []
    while time.time() < until and len(got) < len(want):
        time.sleep(1)
        try:
            got = spark.read.schema(f"{SCHEMA}, batch long, slot long, is_full boolean").parquet(str(tmp_path / "out")).collect()
        except Exception:  # nothing is written yet
            got = []
    q.stop()
    assert sorted((r.engine, r.pos, r.batch, r.slot) for r in got) == want
    assert sum(not r.is_full for r in got) == 50 - 16 - 32


def test_rates_of_a_replay():
    t = lambda s: f"2024-01-01T00:00:{s:06.3f}+00:00"
    events = [(t(0), {}), (t(2), {"a.items": 10, "a.time": 50.0, "a.failed": 1}), (t(5), {"a.items": 20, "a.time": 40.0, "b.items": 5, "b.time": 5.0}), (t(9.5), {"a.items": 5, "a.time": 10.0}), (t(10), {"b.items": 10, "b.time": 5.0, "b.failed": 2})]
    got = [(r["engine"], r["items"], r["failed"], round(r["mean_time"], 4), round(r["rate"], 4), round(r["overall_rate"], 4)) for r in metrics.replay(events)]
    assert got == [("a", 30, 1, 3.0, 6.0, 6.0), ("b", 5, 0, 1.0, 1.0, 1.0), ("a", 35, 1, 2.8571, 1.0, 3.5), ("b", 15, 2, 0.6667, 2.0, 1.5)]


def test_live_metrics_of_a_query(spark, tmp_path):
    spark.createDataFrame([("ab"[i % 3 == 0], i, i / 2) for i in range(60)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    out = []
    listener = metrics.LiveMetrics(out.extend, 0.01)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = metrics.observed(stream.withColumn("bad", F.col("pos") == 7), ["a", "b"], latency="v", failed="bad")
        q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        until = time.time() + 30
        while time.time() < until and not any(r["items"] == 40 for r in out):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    last = {r["engine"]: r for r in out}
    assert (last["a"]["items"], last["b"]["items"], last["a"]["failed"], last["b"]["failed"]) == (40, 20, 1, 0)
    assert last["b"]["mean_time"] == pytest.approx(sum(i / 2 for i in range(0, 60, 3)) / 20) and all(r["rate"] >= 0 for r in out)
    assert sum(p["rows"] for p in listener.progress) == 60 and len([p for p in listener.progress if p["rows"]]) == 3
    metrics.json_lines(str(tmp_path / "log"))(out[:2])
    assert len((tmp_path / "log").read_text().splitlines()) == 2
