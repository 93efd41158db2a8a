"""Detection files: ``spark.read.format("detbin")`` and ``df.write.format("detbin")``; see detcodec for their layout.

The Python source opens and writes files in mounted folders and refuses other stores;
``read_detections`` takes it for mounted folders and Spark's binaryFile reader for other stores, ``write_parquet`` is the sink for any store.

Beside a file may lie an index, ``<file>.idx``: blocks of some rows with their first byte and their lowest and highest frame number. With
it a file is read by several tasks, and blocks outside of a range of frames are not read. The writer makes it, ``index_files`` adds it to files from elsewhere.
What was appended since is one block more; an index that does not fit its file is not used. Strict reading holds frames to the numbers that the
writer put down for their block; bytes that others wrote are held to detcodec.FRAMES.

A job's files change together. Tasks write parts; the commit first writes down what is to be done (``_commit``), then appends or renames, then takes the note
away. A job that dies in between is finished by whoever reads or writes the folder next, from that note, any number of times.
"""

from __future__ import annotations

import fcntl
import glob
import json
import mmap
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framelake.schemas import DETECTION_FILE
from framelake.sources.detcodec import FRAMES, NAMES, BadFile, encode_rows, model_type, rows, walk  # noqa: F401
from framelake.sources.folders import file_system, local_folder

#: Bytes that one task reads where an index allows it; frames of a file that one task writes.
SPLIT, PIECE = 16 << 20, 500_000
BLOCK = np.dtype([("start", "<i8"), ("low", "<i4"), ("high", "<i4")])
NOTE = "_commit"


def mapped(path: str) -> memoryview | bytes:
    """A file's bytes, read as they are asked for; unmapped with the last array on them."""
    with open(path, "rb") as f:
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if os.fstat(f.fileno()).st_size else b""


@contextmanager
def locked(folder: str) -> Iterator[None]:
    """One process at a time changes the files of a folder."""
    with open(os.path.join(folder, "_lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


# Index


@dataclass
class Index:
    blocks: np.ndarray
    size: int
    #: Whether the writer made all of it, from what it wrote.
    own: bool = False

    @staticmethod
    def mark(path: str, size: int) -> int:
        """Tells whether the first ``size`` bytes of a file are those that were indexed: a sum over its head and the bytes before the end."""
        with open(path, "rb") as f:
            head = f.read(min(size, 4096))
            f.seek(max(0, size - 4096))
            return zlib.crc32(f.read(min(size, 4096)), zlib.crc32(head))

    def write(self, path: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.savez(f, blocks=self.blocks, size=np.int64(self.size), mark=np.int64(self.mark(path, self.size)), own=np.bool_(self.own))
        os.replace(part, f"{path}.idx")

    @classmethod
    def read(cls, path: str) -> Index | None:
        try:
            with np.load(f"{path}.idx") as x:
                size = int(x["size"])
                if os.path.getsize(path) < size or cls.mark(path, size) != int(x["mark"]):
                    return None
                return cls(x["blocks"], size, "own" in x and bool(x["own"]))
        except (OSError, ValueError, KeyError):
            return None

    @classmethod
    def build(cls, path: str, strict: bool = False) -> Index:
        """Of the whole frames of a file; goes from head to head."""
        found, start = [], 4
        data = mapped(path)
        if model_type(data, strict) is not None:
            for numbers, _, _, end in walk(data, 4, strict):
                if end > start:
                    found.append((start, min(numbers), max(numbers)))
                    start = end
        return cls(np.array(found, BLOCK), start if found else 4)


def index_files(spark: SparkSession, path: str) -> int:
    """Writes an index for each file below a folder that has none that fits; one task a file. Says for how many."""
    names = spark.createDataFrame([(f,) for f in _files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                old = Index.read(p)
                if old is None or old.size < os.path.getsize(p):
                    Index.build(p).write(p)
                    yield pa.RecordBatch.from_arrays([pa.array([p])], ["path"])

    return names.repartition(max(1, names.count()), "path").mapInArrow(run, "path string").count()


# Reading


class Range(InputPartition):
    """Bytes of a file, from the head of a frame on; to the end of the file where ``end`` is 0. Frames are in ``frames``, as far as is known."""

    def __init__(self, path: str, start: int, end: int, frames: tuple[int, int] = FRAMES) -> None:
        super().__init__(None)
        self.path, self.start, self.end, self.frames = path, start, end, frames


def _files(path: str) -> list[str]:
    p = local_folder(path)
    if os.path.isdir(p):
        recover(p)
        return sorted(glob.glob(os.path.join(glob.escape(p), "**", "*.bin"), recursive=True))
    return sorted(glob.glob(p))


def ranges(path: str, low: int | None = None, high: int | None = None, split: int = SPLIT) -> list[Range]:
    """What has to be read of a file for some frames, in pieces of about ``split`` bytes."""
    index = Index.read(path)
    if index is None or not len(index.blocks):
        return [Range(path, 4, 0)]
    ends = np.append(index.blocks["start"][1:], index.size)
    keep = (index.blocks["high"] >= (low if low is not None else -(2**31))) & (index.blocks["low"] <= (high if high is not None else 2**31))
    out: list[Range] = []
    blocks = index.blocks[keep]
    for start, end, *frames in zip(blocks["start"].tolist(), ends[keep].tolist(), blocks["low"].tolist(), blocks["high"].tolist(), strict=True):
        if out and out[-1].end == start and end - out[-1].start <= split:
            out[-1].end = end
            if index.own:
                out[-1].frames = (min(out[-1].frames[0], frames[0]), max(out[-1].frames[1], frames[1]))
        else:
            out.append(Range(path, start, end, tuple(frames) if index.own else FRAMES))
    if os.path.getsize(path) > index.size:
        out.append(Range(path, index.size, 0))
    return out


def first_of(path: str) -> Range:
    """A file from its first frame on, in one piece."""
    index = Index.read(path)
    if index is None or not index.own or not len(index.blocks) or os.path.getsize(path) > index.size:
        return Range(path, 4, 0)
    return Range(path, 4, 0, (int(index.blocks["low"].min()), int(index.blocks["high"].max())))


def read_range(r: Range, strict: bool, max_frames: int = 0) -> Iterator[pa.RecordBatch]:
    data = mapped(r.path)
    if (kind := model_type(data, strict)) is None:
        return
    part = data[: r.end] if r.end else data
    for chunk in walk(part, r.start, strict, max_frames, r.frames):
        if chunk[0]:
            yield rows(r.path, part, kind, chunk)


class DetBinReader(DataSourceReader):
    """Options: mode, maxframes (of each file), minframe and maxframe (whole blocks; rows are filtered by read_frames_of)."""

    def __init__(self, options: dict) -> None:
        self.path, self.strict = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.max_frames = int(options.get("maxframes", 0))
        number = lambda k: int(options[k]) if k in options else None
        self.low, self.high, self.split = number("minframe"), number("maxframe"), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        if self.max_frames:
            return [first_of(f) for f in _files(self.path)]
        return [r for f in _files(self.path) for r in ranges(f, self.low, self.high, self.split)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_range(partition, self.strict, self.max_frames)


def read_frames_of(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, mode: str = "PERMISSIVE", split: int = SPLIT) -> DataFrame:
    """Rows of frames ``low`` to ``high`` of indexed files in a mounted folder: blocks without them are not read, others by several tasks."""
    register(spark)
    source = spark.read.format("detbin").option("mode", mode).option("split", split)
    for name, value in (("minframe", low), ("maxframe", high)):
        source = source.option(name, value) if value is not None else source
    df = source.load(path)
    df = df.where(F.col("frame_number") >= low) if low is not None else df
    return df.where(F.col("frame_number") <= high) if high is not None else df


def read_detections(spark: SparkSession, path: str, mode: str = "PERMISSIVE", max_frames: int = 0) -> DataFrame:
    """Rows of all files below a folder, from any store.

    In mounted folders the Python source reads them, by ranges of bytes where there is an index, and never holds a whole file. From other stores they come through
    Spark's own file reader: one task a file, each as a whole in memory and below 2 GB.
    """
    if file_system(spark, path)[0].getScheme() == "file" and _files(path):
        register(spark)
        return spark.read.format("detbin").option("mode", mode).option("maxframes", max_frames).load(path)
    strict = mode.upper() == "FAILFAST"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer()
                view = memoryview(data) if data is not None and data.size else b""
                if (kind := model_type(view, strict)) is None:
                    continue
                for chunk in walk(view, 4, strict, max_frames):
                    if chunk[0]:
                        yield rows(p, view, kind, chunk)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInArrow(run, DETECTION_FILE)


# Writing


@dataclass
class Written(WriterCommitMessage):
    #: File name, part, its first frame, model type, blocks as (start in the part without head, low, high).
    parts: list[tuple[str, str, int, int, list[tuple[int, int, int]]]]


def finish(folder: str, note: dict) -> None:
    """Does what a commit's note says. Doing it again, from wherever it broke off, ends the same way."""
    for name in note["remove"]:
        for f in (name, f"{name}.idx"):
            with suppress(FileNotFoundError):
                os.remove(os.path.join(folder, f))
    for name, size, parts in note["append"]:
        file = os.path.join(folder, name)
        with open(file, "r+b" if os.path.exists(file) else "w+b") as out:
            out.truncate(size)
            out.seek(size)
            for i, part in enumerate(parts):
                with open(os.path.join(folder, part), "rb") as new:
                    new.seek(4 if size or i else 0)
                    shutil.copyfileobj(new, out, 1 << 20)
            out.flush()
            os.fsync(out.fileno())
    for name, part in note["rename"]:
        if os.path.exists(source := os.path.join(folder, part)):
            os.replace(source, os.path.join(folder, name))
    for name, size, blocks in note["index"]:
        file = os.path.join(folder, name)
        old = Index.read(file) if size else Index(np.zeros(0, BLOCK), 4, True)
        if old is not None and old.size == max(4, size):  # else someone else's bytes are not indexed; index_files() does it
            Index(np.concatenate((old.blocks, np.array([tuple(b) for b in blocks], BLOCK))), os.path.getsize(file), old.own).write(file)
    if note.get("job"):
        open(os.path.join(folder, f"_done-{note['job']}"), "w").close()
    os.remove(os.path.join(folder, NOTE))
    for _, _, parts in note["append"]:  # not before: doing it again needs them
        for part in parts:
            os.remove(os.path.join(folder, part))


def _noted(folder: str) -> bool:
    try:
        with open(os.path.join(folder, NOTE)) as f:
            note = json.load(f)
    except FileNotFoundError:
        return False
    finish(folder, note)
    return True


def recover(folder: str) -> bool:
    """Finishes a job that died in its commit."""
    if not os.path.exists(os.path.join(folder, NOTE)):
        return False
    with locked(folder):
        return _noted(folder)


class DetBinWriter(DataSourceArrowWriter):
    """A part for each piece of a file that a task has rows of.

    Rows of a piece must be in one task, sorted by path, frame and index; they are written as they come.
    Appending adds frames behind those that a file has, overwriting replaces all files of the folder. With the option ``job`` a job
    that was committed under this name already changes nothing, so it can be repeated.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = local_folder(options["path"]), overwrite, options.get("job")
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        parts, out, now, size = [], None, None, 0
        rest: pa.Table | None = None

        def put(t: pa.Table) -> None:
            """Whole frames of one piece of a file."""
            nonlocal out, now, size
            name, frame = os.path.basename(t.column("path")[0].as_py()), t.column("frame_number")
            low, high = frame[0].as_py(), frame[-1].as_py()
            if (name, low // PIECE) != now:
                if out is not None:
                    out.close()
                now, size, kind = (name, low // PIECE), 0, t.column("model_type")[0].as_py()
                part = f".{uuid.uuid4().hex}.part"
                parts.append((name, part, low, kind, []))
                out = open(os.path.join(self.path, part), "wb")  # noqa: SIM115
                out.write(np.array([kind], "<i4").tobytes())
            data = encode_rows(t)
            out.write(data.tobytes())
            parts[-1][4].append((size, low, high))
            size += 4 * len(data)

        def flush(t: pa.Table, last: bool) -> pa.Table | None:
            if not t.num_rows:
                return None
            code = t.column("path").combine_chunks().dictionary_encode().indices.to_numpy()
            frame = t.column("frame_number").to_numpy()
            piece = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (frame[1:] // PIECE != frame[:-1] // PIECE))))
            heads = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (frame[1:] != frame[:-1]))))
            end = t.num_rows if last else int(heads[-1])
            cuts = [*piece[piece < end].tolist(), end]
            for a, b in zip(cuts, cuts[1:], strict=False):
                put(t.slice(a, b - a))
            return t.slice(end)

        for batch in batches:
            t = pa.Table.from_batches([batch]).select(NAMES)
            rest = flush(pa.concat_tables([rest, t]) if rest is not None else t, False)
        if rest is not None:
            flush(rest, True)
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with locked(self.path):
            self._commit(messages)

    def _commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _noted(self.path)
        if self.job and os.path.exists(os.path.join(self.path, f"_done-{self.job}")):
            self.abort(messages)
            return
        files: dict[str, list] = {}
        for p in sorted((p for m in messages if m for p in m.parts), key=lambda p: p[2]):
            files.setdefault(p[0], []).append(p)
        note = {"job": self.job, "remove": [], "append": [], "rename": [], "index": []}
        if self.overwrite:
            note["remove"] = sorted({os.path.basename(f) for f in glob.glob(os.path.join(glob.escape(self.path), "*.bin"))} - files.keys())
        for name, parts in files.items():
            file = os.path.join(self.path, name)
            size = 0 if self.overwrite or not os.path.exists(file) else os.path.getsize(file)
            if size:
                with open(file, "rb") as f:
                    head = int.from_bytes(f.read(4), "little", signed=True)
                if any(p[3] != head for p in parts):
                    self.abort(messages)
                    raise ValueError(f"{file} is of another model type than {parts[0][3]}")
            if not size and len(parts) == 1:
                note["rename"].append((name, parts[0][1]))
            else:
                note["append"].append((name, size, [p[1] for p in parts]))
            at, blocks = max(4, size), []
            for p in parts:
                blocks += [(at + b[0], b[1], b[2]) for b in p[4]]
                at += os.path.getsize(os.path.join(self.path, p[1])) - 4
            note["index"].append((name, size, blocks))
        part = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(part, "w") as f:
            json.dump(note, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, os.path.join(self.path, NOTE))
        finish(self.path, note)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for p in m.parts if m else ():
                with suppress(FileNotFoundError):
                    os.remove(os.path.join(self.path, p[1]))


class DetBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "detbin"

    def schema(self) -> StructType:
        return DETECTION_FILE

    def reader(self, schema: StructType) -> DataSourceReader:
        return DetBinReader(self.options)

    def streamReader(self, schema: StructType):
        from framelake.streaming.detections import DetBinStream

        return DetBinStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DetBinWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DetBin)


def write_detections(df: DataFrame, path: str, mode: str = "append", job: str | None = None) -> None:
    """One task for each PIECE of a file, in frame order. ``append`` adds frames to files that are there, ``overwrite`` starts anew; a ``job`` of a name is done once."""
    register(df.sparkSession)
    dealt = df.select(*NAMES).repartition("path", F.floor(F.col("frame_number") / PIECE)).sortWithinPartitions("path", "frame_number", "det_index")
    out = dealt.write.format("detbin").mode(mode)
    (out.option("job", job) if job else out).save(path)


def write_parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    """The canonical sink, for any store: Parquet by (video_id, engine), which ``df`` has besides the columns of a detection file.

    Rows are brought together by video and engine, so a folder has few files; Spark commits the job as a whole.
    """
    df.repartition("video_id", "engine", F.floor(F.col("frame_number") / 100_000)).sortWithinPartitions("video_id", "engine", "frame_number").write.partitionBy("video_id", "engine").mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Detections of write_parquet(); filters on video_id and engine read only their folders."""
    return spark.read.parquet(path)
