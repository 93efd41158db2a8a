"""Streams of detection files that grow, and engine batches that go on from one micro-batch to the next."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.sources.detbin import Range, _files, mapped, read_range, register
from framelake.sources.detcodec import walk
from framelake.sources.folders import local_folder

#: Bytes of a file that are looked through for whole frames in one step.
STEP = 4 << 20


def whole_frames(path: str, start: int, most: int) -> int:
    """Where the last whole frame ends that begins in the ``most`` bytes from ``start`` on (one frame at least, if there is a whole one); ``start`` if there is none."""
    data = mapped(path)
    end = max(start, 4)
    for _, _, _, at in walk(data, end, max_frames=0) if len(data) > end else ():
        if at > start:
            end = at
        if end - start >= most:
            break
    return end if len(data) >= 4 else start


class DetBinStream(DataSourceStreamReader):
    """Appended frames of the files below a folder, each once.

    An offset is a byte of each file, always the end of a whole frame, so half-written frames wait. With the option ``maxbytes`` a
    micro-batch gets about so many bytes; where reading stands is then kept in the file ``progress`` (required), since
    Spark does not tell a source after a restart from which offset it goes on before it asks for the next one. It is written when a batch is
    planned, so it is never behind what is committed. Files must not get shorter.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("maxbytes", 0))
        self.progress = local_folder(options["progress"]) if "progress" in options else None
        if self.most and not self.progress:
            raise ValueError("maxbytes needs progress, a file beside the query's checkpoint")
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}  # names may be anything, so they go as text

    def _planned(self) -> dict[str, int]:
        with suppress(FileNotFoundError, ValueError):
            with open(self.progress or "") as f:
                return json.load(f)
        return {}

    def latestOffset(self) -> dict:
        before = self._planned() if self.progress else {}
        ends = {f: max(n, self.seen.get(f, 0)) for f, n in before.items()} | {f: n for f, n in self.seen.items() if f not in before}
        left = self.most or float("inf")
        for f in _files(self.path):
            start = ends.get(f, 0)
            if os.path.getsize(f) < start:
                raise ValueError(f"{f} got shorter")
            if left > 0 and os.path.getsize(f) > max(start, 4):
                end = whole_frames(f, start, int(min(left, 1 << 62)))
                left -= end - start
                ends[f] = end
        self.seen = ends
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        if self.progress:
            part = f"{self.progress}.{uuid.uuid4().hex}"
            with open(part, "w") as f:
                json.dump({k: max(n, self._planned().get(k, 0)) for k, n in new.items()}, f)
            os.replace(part, self.progress)
        return [Range(f, max(old.get(f, 0), 4), n) for f, n in sorted(new.items()) if n > max(old.get(f, 0), 4)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition, False)


def stream_detections(spark: SparkSession, path: str, max_bytes: int = 0, progress: str | None = None) -> DataFrame:
    """A streaming DataFrame of the rows of detection files that are there and of those that are appended."""
    register(spark)
    source = spark.readStream.format("detbin")
    return (source.option("maxbytes", max_bytes).option("progress", progress) if max_bytes else source).load(path)


def finished(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Works through what a stream has, into Parquet files, and waits for the end; a later run with the same checkpoint goes on from there.

    In a run over what is available Spark asks a Python source for its end only once, so one that gives some bytes at a time (``maxbytes``) would end after its
    first micro-batch. The rest follows in a run that goes on until nothing new is found; streams with state, which timers may keep busy, are run again instead.
    """
    sinks = df.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    while True:
        q = sinks.trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        done = q.recentProgress
        if not any(p.numInputRows for p in done):
            return
        if not any(p.stateOperators for p in done):
            break
    q = df.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Batches


class _Batches(StatefulProcessor):
    """Rows of an unfinished batch wait in the state, at most one fewer than a batch has."""

    def __init__(self, schema: T.StructType, n: int, keys: list[str], order: list[str], flush_ms: int, tail: str) -> None:
        self.kind, self.n, self.keys, self.order, self.flush_ms, self.tail = schema, n, keys, order, flush_ms, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "batch long")
        self.rest = handle.getListState("rest", self.kind)

    def _out(self, rows: pd.DataFrame, first: int, whole: bool) -> pd.DataFrame:
        i = pd.RangeIndex(len(rows))
        return rows.reset_index(drop=True).assign(batch=first + i // self.n, slot=i % self.n, is_full=whole).astype({"batch": "int64", "slot": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([x for x in rows]).sort_values(self.order, kind="stable")
        held = [tuple(r) for r in self.rest.get()] if self.rest.exists() else []
        every = pd.concat([pd.DataFrame(held, columns=new.columns).astype(new.dtypes), new]) if held else new
        first = self.next.get()[0] if self.next.exists() else 0
        full = len(every) // self.n
        left = every.iloc[full * self.n :]
        self.next.update((first + full,))
        if len(left):
            self.rest.put([tuple(r) for r in left.astype(object).itertuples(index=False)])
        else:
            self.rest.clear()
        self._timer(timerValues, len(left) > 0)
        if full:
            yield self._out(every.iloc[: full * self.n], first, True)

    def _timer(self, timerValues, waits: bool) -> None:
        if self.flush_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if waits:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rest.get()] if self.rest.exists() else []
        self.rest.clear()
        if not held:
            return
        first = self.next.get()[0]
        self.next.update((first + 1,))
        if self.tail == "pad":
            yield self._out(pd.DataFrame(held, columns=self.kind.names), first, False)

    def close(self) -> None:
        pass


def stream_batches(df: DataFrame, n: int, keys: list[str], order: list[str], tail: str = "pad", flush_ms: int = 0) -> DataFrame:
    """``batch``, ``slot`` (both from 0) and ``is_full`` for rows of a stream: the batches that batching.batches() cuts, wherever the stream is cut.

    Rows of a key come in the order of ``order``, or are put into it inside a micro-batch. Full batches come out at once. An unfinished one waits in the state for more
    rows, over restarts too; after ``flush_ms`` milliseconds without any it comes out as it is (``pad``) or is dropped (``drop``). With 0 it waits on.
    Needs the RocksDB state store.
    """
    if tail not in ("pad", "drop"):
        raise ValueError(f"tail: {tail}")
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("is_full", T.BooleanType())])
    processor = _Batches(df.schema, n, keys, order, flush_ms, tail)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "processingTime" if flush_ms else "none")
