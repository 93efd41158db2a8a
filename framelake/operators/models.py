"""The model seam: batched inference, image letterboxing, and a deterministic stand-in model."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def infer(df: DataFrame, tensor: str, make_predict: Callable, batch_size: int, shape: list[int], out: str = "output", error: str | None = None) -> DataFrame:
    """``out`` holds the flat model output of each row; ``make_predict`` loads the model once a worker.

    With ``error`` a failing batch does not end the job: it is halved until the rows that fail are
    found (see halved()); these have a null output and the failure's text in that column, all others a null there.
    """
    name, size = uuid.uuid4().hex, math.prod(shape)

    @F.arrow_udf("struct<y:array<float>,e:string>")
    def run(v: pa.Array) -> pa.Array:
        # The numbers of an Arrow batch are one array for the model and one from it: no objects for rows.
        predict, values = loaded(name, make_predict), v.flatten().to_numpy(zero_copy_only=False)
        if v.null_count or len(values) != len(v) * size or (np.diff(v.offsets.to_numpy()) != size).any():
            raise ValueError(f"tensors must have {size} values each, {shape}")
        ys, failed = [], []
        for a in range(0, len(v), batch_size):
            x = np.array(values[a * size : (a + batch_size) * size]).reshape(-1, *shape)  # the model's own, it may write there
            y, e = halved(predict, x) if error is not None else (outputs(predict, x), [""] * len(x))
            ys += y
            failed += e
        ends = np.concatenate(([0], np.cumsum([len(y) for y in ys]))).astype(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ys) if ys else np.zeros(0, np.float32)))
        return pa.StructArray.from_arrays([flat, pa.array(failed, pa.string())], ["y", "e"])

    rows, fine = df.withColumn("_r", run(F.col(tensor))), F.col("_r.e") == ""
    if error is None:
        return rows.withColumn(out, F.col("_r.y")).drop("_r")
    return rows.withColumn(out, F.when(fine, F.col("_r.y"))).withColumn(error, F.when(~fine, F.col("_r.e"))).drop("_r")


#: Models of this worker, by the name of their use; as many as LOADED stay.
_MODELS: dict[str, Callable] = {}
LOADED = 3


def loaded(name: str, make_predict: Callable) -> Callable:
    """The model of a use, made at most once while it stays."""
    if name not in _MODELS:
        while len(_MODELS) >= LOADED:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[name] = make_predict()
    return _MODELS[name]


def stub_model(channels: int, anchors: int) -> Callable:
    """A model for tests: sums blocks of its input."""

    def make() -> Callable:
        def predict(x: np.ndarray) -> np.ndarray:
            flat = x.reshape(len(x), -1).astype(np.float64)
            size = channels * anchors
            return np.stack([flat[:, i::size].sum(axis=1) for i in range(size)], axis=1).astype(np.float32)

        return predict

    return make


def outputs(predict: Callable, x: np.ndarray) -> list[np.ndarray]:
    """The flat output of each row."""
    y = np.asarray(predict(x))
    if len(y) != len(x):
        raise ValueError(f"{len(y)} outputs for {len(x)} inputs")
    return list(y.reshape(len(x), -1).astype(np.float32))


def halved(predict: Callable, x: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    """Outputs and failures ("" for none) of rows, by halving what fails: f bad rows of n take some 2 f log2(n / f) runs more."""
    try:
        return outputs(predict, x), [""] * len(x)
    except Exception as e:  # any failure of a model is a failed batch
        if len(x) == 1:
            return [np.zeros(0, np.float32)], [f"{type(e).__name__}: {e}"]
        (y0, e0), (y1, e1) = halved(predict, x[: len(x) // 2]), halved(predict, x[len(x) // 2 :])
        return y0 + y1, e0 + e1


def onnx_model(path: str) -> Callable:
    """A model file run by onnxruntime, with its first input and output."""

    def make() -> Callable:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def predict(x: np.ndarray) -> np.ndarray:
            y = session.run(None, {name: x.astype(np.float32)})[0]
            return y.reshape(len(x), -1)

        return predict

    return make


def adding_model(width: int) -> bytes:
    """A model file (protocol buffer, opset 13) with input x and output y = x + x of n rows of ``width`` < 128 floats; shows that the runtime is there."""

    def field(number: int, value: int | str | bytes) -> bytes:
        if isinstance(value, int):
            return bytes([number << 3, value])
        data = value.encode() if isinstance(value, str) else value
        size = [len(data)] if len(data) < 128 else [len(data) & 127 | 128, len(data) >> 7]
        return bytes([number << 3 | 2, *size]) + data

    dims = field(1, field(2, "n")) + field(1, field(1, width))
    value = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))
    node = field(1, "x") + field(1, "x") + field(2, "y") + field(4, "Add")
    graph = field(1, node) + field(2, "g") + field(11, value("x")) + field(12, value("y"))
    return field(1, 8) + field(8, field(1, "") + field(2, 13)) + field(7, graph)


def onnx_graph(path: str) -> dict[str, list[tuple[str, list, str]]]:
    """Names, shapes and types of a model's inputs and outputs."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    return {side: [(v.name, list(v.shape), v.type) for v in values] for side, values in (("inputs", session.get_inputs()), ("outputs", session.get_outputs()))}


def letterbox_pixels(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """BGR bytes (H, W, 3) as RGB floats (3, height, width) in 0..1: bilinear, zero padding, integer centring."""
    oh, ow = image.shape[:2]
    scale = min(width / ow, height / oh)
    nw, nh = max(1, int(ow * scale)), max(1, int(oh * scale))
    grid = lambda n, o: np.clip((np.arange(n) + 0.5) * o / n - 0.5, 0, o - 1)
    y, x = grid(nh, oh), grid(nw, ow)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, oh - 1), np.minimum(x0 + 1, ow - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    src = image[:, :, ::-1].astype(np.float32)
    top = src[y0][:, x0] * (1 - fx) + src[y0][:, x1] * fx
    low = src[y1][:, x0] * (1 - fx) + src[y1][:, x1] * fx
    out = np.zeros((height, width, 3), np.float32)
    py, px = (height - nh) // 2, (width - nw) // 2
    out[py : py + nh, px : px + nw] = top * (1 - fy) + low * fy
    return (out / 255).transpose(2, 0, 1)


def crop(image: Column, w: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The pixels of a region of raw BGR bytes; the whole image where the region is null."""

    @F.pandas_udf("binary")
    def run(b: pd.Series, ws: pd.Series, *box: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or pd.isna(r[0]) else np.frombuffer(x, np.uint8).reshape(-1, int(i), 3)[int(r[1]) : int(r[3]), int(r[0]) : int(r[2])].tobytes() for x, i, *r in zip(b, ws, *box, strict=True)])

    return run(image, w, x1, y1, x2, y2)


def letterbox(image: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """The model input of raw BGR bytes, as array<float>."""
    @F.pandas_udf("array<float>")
    def run(b: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else letterbox_pixels(np.frombuffer(x, np.uint8).reshape(int(j), int(i), 3), width, height).ravel() for x, i, j in zip(b, ws, hs, strict=True)])

    return run(image, w, h)
