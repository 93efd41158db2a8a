"""Bytes of detection files, a chunk of rows at a time.

Layout, little-endian: int32 model type once; then for each frame int32 number, int32 count and
for each detection 4 float32 box, float32 confidence, int32 class, int32 keypoint count and 3 float32
for each keypoint. Every field has four bytes, so a file is an array of words: ``walk`` goes from head to head, all values are
taken from the array at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from framelake.schemas import DETECTION_FILE

NAMES = DETECTION_FILE.names
#: Rows of a chunk; words of a frame's head and of a detection without keypoints.
ROWS, FRAME, DETECTION = 16_384, 2, 7
#: Frame numbers that strict reading takes in bytes of which nothing else is known.
FRAMES = (0, 1_000_000)
_POINT = pa.struct([pa.field(c, pa.float32()) for c in ("x", "y", "confidence")])
ARROW = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("model_type", "frame_number", "det_index")), *((c, pa.float32()) for c in ("cx", "cy", "w", "h", "confidence")), ("class_id", pa.int32()), ("keypoints", pa.list_(_POINT))])


class BadFile(ValueError):
    """A detection file that strict reading refuses."""


def model_type(data: memoryview | bytes, strict: bool) -> int | None:
    if len(data) < 4:
        if strict:
            raise BadFile("no model type")
        return None
    kind = int.from_bytes(data[:4], "little", signed=True)
    if strict and not 0 <= kind <= 10:
        raise BadFile(f"model type {kind}")
    return kind


def walk(data: memoryview | bytes, start: int, strict: bool = False, max_frames: int = 0, frames_in: tuple[int, int] = FRAMES) -> Iterator[tuple[list[int], list[int], list[int], int]]:
    """Chunks of rows (frame numbers, indexes or -1 for a frame without detections, first words) from byte ``start`` on, and where the chunk's last whole frame ends.

    Strict reading checks ranges (frame numbers: ``frames_in``, both ends included) and refuses cut files; otherwise reading stops where a file is cut.
    """
    size = len(data)
    words = memoryview(data)[: size // 4 * 4].cast("i")
    n, at, frames = len(words), start // 4, 0
    numbers, indexes, places, end = [], [], [], start
    low, high = max(0, frames_in[0]), frames_in[1]

    def cut(where: str) -> None:
        if strict:
            raise BadFile(f"cut in {where}")

    while 4 * at < size and (not max_frames or frames < max_frames):
        if at + FRAME > n:
            cut("a frame head")
            break
        number, count = words[at], words[at + 1]
        if strict and not (low <= number <= high and 0 <= count <= 10_000):
            raise BadFile(f"frame {number} with {count} detections")
        at += FRAME
        frames += 1
        if count <= 0:
            numbers.append(number)
            indexes.append(-1)
            places.append(at)
        whole = True
        for i in range(count):
            if at + DETECTION > n:
                cut("a detection")
                whole = False
                break
            points = words[at + 6]
            if points < 0 or at + DETECTION + 3 * points > n:
                cut("keypoints")
                whole = False
                break
            numbers.append(number)
            indexes.append(i)
            places.append(at)
            at += DETECTION + 3 * points
        if not whole:
            break
        end = 4 * at
        if len(numbers) >= ROWS:
            yield numbers, indexes, places, end
            numbers, indexes, places = [], [], []
    if numbers:
        yield numbers, indexes, places, end


def rows(path: str, data: memoryview | bytes, kind: int, chunk: tuple[list[int], list[int], list[int], int]) -> pa.RecordBatch:
    numbers, indexes, places, _ = chunk
    words = np.frombuffer(data, "<i4", len(data) // 4)
    index = np.array(indexes, np.int32)
    none = index < 0
    at = np.array(places, np.int64)
    inside = np.where(none, 0, at)
    take = lambda k, kind: words[np.minimum(inside + k, len(words) - 1)].view(kind)
    points = np.where(none, 0, take(6, np.int32)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(3 * points)))
    flat = words[np.arange(ends[-1]) + np.repeat(at + DETECTION - ends[:-1], 3 * points)].view(np.float32)
    keypoints = pa.StructArray.from_arrays([pa.array(flat[k::3]) for k in range(3)], fields=list(_POINT))
    offsets = pa.array((ends // 3).astype(np.int32), mask=np.append(none, False))
    columns = [
        pa.array([path], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), pa.array(np.full(len(at), kind, np.int32)), pa.array(np.array(numbers, np.int32)), pa.array(index, mask=none),
        *(pa.array(take(k, np.float32), mask=none) for k in range(5)), pa.array(take(5, np.int32), mask=none), pa.ListArray.from_arrays(offsets, keypoints),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def parse(data: bytes, strict: bool = False, max_frames: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of a file."""
    if (kind := model_type(data, strict)) is None:
        return
    for chunk in walk(data, 4, strict, max_frames):
        if chunk[0]:
            yield rows("", data, kind, chunk)


def encode_rows(t: pa.Table) -> np.ndarray:
    """The words of whole frames (rows ordered by frame), without the model type."""
    column = lambda c: t.column(c).combine_chunks()
    frame, index = column("frame_number").to_numpy(), column("det_index")
    there = index.is_valid().to_numpy(zero_copy_only=False)
    number = lambda c, kind: column(c).fill_null(0).to_numpy().astype(kind).view(np.int32)
    keypoints = column("keypoints")
    points = np.where(there, keypoints.value_lengths().fill_null(0).to_numpy(), 0).astype(np.int64)
    starts = np.ones(len(frame), bool)
    starts[1:] = frame[1:] != frame[:-1]
    first = np.flatnonzero(starts)
    size = np.where(there, DETECTION + 3 * points, 0) + FRAME * starts
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int32)
    out[at[first]], out[at[first] + 1] = frame[first], np.add.reduceat(there.astype(np.int32), first) if len(first) else 0
    body = (at + FRAME * starts)[there]
    for k, (c, kind) in enumerate([*((c, "<f4") for c in ("cx", "cy", "w", "h", "confidence")), ("class_id", "<i4")]):
        out[body + k] = number(c, kind)[there]
    n = points[there]
    out[body + 6] = n
    if n.sum():
        rows_of = keypoints.filter(pa.array(there))
        flat = rows_of.flatten()
        xyz = np.stack([flat.field(k).fill_null(0).to_numpy().astype("<f4") for k in range(3)], axis=1).ravel().view(np.int32)
        end = np.cumsum(3 * n)
        out[np.arange(end[-1]) + np.repeat(body + DETECTION - (end - 3 * n), 3 * n)] = xyz
    return out
