"""Dense model output: slicing, transposing, decoding, profiles and differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.geometry import keypoint_confidence


def batch_slice(t: Column, item: Column | int, channels: int, anchors: int) -> Column:
    """Values of one batch item."""
    size = channels * anchors
    start = (F.lit(item) if isinstance(item, int) else item) * size + 1
    return F.slice(t, start, size)


def to_anchor_rows(t: Column, channels: int, anchors: int) -> Column:
    """Channel-major values as an array of arrays, one for each anchor (no shuffle)."""
    return F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), lambda a: F.array(*(F.get(t, a + c * anchors) for c in range(channels))))


def decode(t: Column, anchors: int, keypoints: int = 0, normalise: bool = True) -> Column:
    """Channel-major output of one frame as an array of detections.

    Channels: cx, cy, w, h, confidence (as it is, no sigmoid), then x, y, confidence of each keypoint.
    """
    at = lambda c, a: F.get(t, a + c * anchors)
    conf = keypoint_confidence if normalise else (lambda c: c)

    def one(a: Column) -> Column:
        points = F.array(*(F.struct(at(5 + 3 * k, a).alias("x"), at(6 + 3 * k, a).alias("y"), conf(at(7 + 3 * k, a)).alias("confidence")) for k in range(keypoints)))
        base = [a.cast("long").alias("anchor"), *(at(c, a).alias(n) for c, n in enumerate(("cx", "cy", "w", "h", "confidence"))), F.lit(0).alias("class_id")]
        return F.struct(*base, *([points.alias("keypoints")] if keypoints else []))

    return F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), one)


def decode_frames(df: DataFrame, tensor: str, anchors: int, keypoints: int = 0, threshold: float | None = None, outer: bool = False) -> DataFrame:
    """One row for each anchor; the threshold is applied before rows are made, and a confidence that is no number is below it.

    A frame without output (null) has no anchors. With ``outer`` frames without any row get one of nulls.
    """
    found = F.when(F.col(tensor).isNotNull(), decode(F.col(tensor), anchors, keypoints))
    if threshold is not None:
        found = F.filter(found, lambda d: (d["confidence"] >= F.lit(threshold).cast("float")) & ~F.isnan(d["confidence"]))
    rest = [c for c in df.columns if c != tensor]
    return df.select(*rest, (F.explode_outer if outer else F.explode)(found).alias("d")).select(*rest, "d.*")


#: Values of a tensor from which on decode_any() works on whole batches.
WIDE = 2048


def pack(tensor: Column) -> Column:
    """An array<float> as little-endian bytes of fixed width."""

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        values = v.values.cast(pa.float32())
        values = values.fill_null(float("nan")) if values.null_count else values
        ends = v.offsets.to_numpy().astype(np.int64) * 4
        if ends[-1] - ends[0] >= 1 << 31:
            raise ValueError("tensors of one batch have more than 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        mask = pa.py_buffer(np.packbits(v.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if v.null_count else None
        data = values.buffers()[1]  # the numbers of the batch as they lie, no copy of them
        data = data.slice(4 * values.offset + int(ends[0])) if data is not None else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.binary(), len(v), [mask, pa.py_buffer((ends - ends[0]).astype(np.int32)), data])

    return run(tensor)


def decode_packed(df: DataFrame, tensor: str, anchors: int, keypoints: int = 0, threshold: float | None = None, outer: bool = False) -> DataFrame:
    """What decode_frames() gives, for tensors as bytes of float32 (or arrays of numbers) with any number of anchors.

    A batch of tensors is one numpy array; the threshold is put to its confidences first, and only
    anchors that pass are ever made into rows. Tensors must have the size that ``anchors`` and ``keypoints`` say; null ones have no anchors.
    """
    kind = df.schema[tensor].dataType
    packed = isinstance(kind, T.BinaryType)
    number = T.FloatType() if packed else kind.elementType
    rest = [c for c in df.columns if c != tensor]
    channels = 5 + 3 * keypoints
    point = T.StructType([T.StructField("x", number), T.StructField("y", number), T.StructField("confidence", T.DoubleType())])
    fields = [T.StructField("anchor", T.LongType()), *(T.StructField(c, number) for c in ("cx", "cy", "w", "h", "confidence")), T.StructField("class_id", T.IntegerType()), *([T.StructField("keypoints", T.ArrayType(point))] if keypoints else [])]
    schema = T.StructType([*(df.schema[c] for c in rest), *fields])
    dtype = np.dtype("<f8" if isinstance(number, T.DoubleType) else "<f4")
    least = None if threshold is None else dtype.type(np.float32(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (32 << 20) // (channels * anchors * dtype.itemsize))
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                column = b.column(tensor)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                some = column.take(pa.array(there))
                at = some.offsets.to_numpy() if not packed else np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
                values = np.frombuffer(some.buffers()[2] or b"", "<f4", offset=int(at[0]) if len(at) else 0)[: (int(at[-1]) - int(at[0])) // 4] if packed else some.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
                unit = 4 if packed else 1
                if len(some) and (np.diff(at) != channels * anchors * unit).any():
                    raise ValueError(f"tensors of {sorted(set((np.diff(at) // unit).tolist()))} values, not {channels} x {anchors}")
                x = values.reshape(len(some), channels, anchors)
                conf = x[:, 4]
                keep = ~np.isnan(conf) & (conf >= least) if least is not None else np.ones(conf.shape, bool)
                i, j = np.nonzero(keep)
                row = there[i]
                if outer:
                    none = np.setdiff1d(np.arange(b.num_rows), row)
                    order = np.argsort(np.concatenate((row, none)), kind="stable")
                    row, real = np.concatenate((row, none))[order], order < len(i)
                    pick = lambda v, order=order: np.concatenate((v, np.zeros(len(none), v.dtype)))[order]  # noqa: B023, E731
                else:
                    real, pick = np.ones(len(i), bool), lambda v: v
                out = [pa.array(pick(j).astype(np.int64), mask=~real), *(pa.array(pick(x[i, c, j]), mask=~real) for c in range(5)), pa.array(np.zeros(len(row), np.int32), mask=~real)]
                if keypoints:
                    k = x[:, 5:].reshape(len(some), keypoints, 3, anchors)[i, :, :, j]  # rows x keypoints x 3
                    c = k[:, :, 2].astype(np.float64)
                    c = np.where(c > 1, np.clip(c / 255, 0, 1), c)
                    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v).ravel()) for v in (k[:, :, 0], k[:, :, 1], c)], ["x", "y", "confidence"])
                    ends = np.concatenate(([0], np.cumsum(np.where(real, keypoints, 0))))
                    out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(~real, False)), flat))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in rest), *out], [f.name for f in schema.fields])

    return df.select(*rest, tensor).mapInArrow(run, schema)


def decode_any(df: DataFrame, tensor: str, anchors: int, keypoints: int = 0, threshold: float | None = None, outer: bool = False) -> DataFrame:
    """decode_packed() for bytes and for large tensors, decode_frames(), which stays in the JVM, for small ones."""
    wide = (5 + 3 * keypoints) * anchors > WIDE or isinstance(df.schema[tensor].dataType, T.BinaryType)
    return (decode_packed if wide else decode_frames)(df, tensor, anchors, keypoints, threshold, outer)


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation and counts above levels."""
    v = F.col(value)
    over = lambda t: F.count_if(v > t).alias(f"over_{str(t).replace('.', '_')}")
    return df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v != 0).alias("nonzero"), over(0.01), over(0.1), over(0.2))


def top_confidence(df: DataFrame, k: int = 20, confidence: str = "confidence", ties: tuple[str, ...] = ("anchor",)) -> DataFrame:
    """The ``k`` most confident rows; of equal ones the larger tie keys come first."""
    return df.orderBy(F.desc(confidence), *(F.desc(c) for c in ties)).limit(k)


def pair_elements(a: DataFrame, b: DataFrame, keys: list[str], tensor: str = "tensor") -> DataFrame:
    """Rows (keys, pos, a, b, diff) of tensors with equal keys, up to the shorter length."""
    both = a.select(*keys, F.col(tensor).alias("_a")).join(b.select(*keys, F.col(tensor).alias("_b")), keys)
    n = F.least(F.size("_a"), F.size("_b"))
    pairs = F.zip_with(F.slice("_a", 1, n), F.slice("_b", 1, n), lambda x, y: F.struct(x.cast("double").alias("a"), y.cast("double").alias("b")))
    return both.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, F.col("pos").cast("long").alias("pos"), "p.a", "p.b", (F.col("p.a") - F.col("p.b")).alias("diff"))


def tensor_diff(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-6, tensor: str = "tensor", per_key: bool = True) -> DataFrame:
    """Largest, mean and root-mean-square difference, count and share above ``tol``."""
    d = F.abs("diff")
    aggs = [F.count("*").alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rms"), F.count_if(d > tol).alias("n_over"), (F.count_if(d > tol) / F.count("*")).alias("share_over")]
    pairs = pair_elements(a, b, keys, tensor)
    return pairs.groupBy(*keys).agg(*aggs) if per_key else pairs.agg(*aggs)


def tensor_topn(a: DataFrame, b: DataFrame, keys: list[str], n: int, shape: list[int], tensor: str = "tensor") -> DataFrame:
    """The ``n`` largest absolute differences with their coordinates in ``shape``."""
    rows = pair_elements(a, b, keys, tensor).withColumn("abs_diff", F.abs("diff")).orderBy(F.desc("abs_diff"), *keys, "pos").limit(n)
    step = 1
    for i in range(len(shape) - 1, -1, -1):
        rows = rows.withColumn(f"dim{i}", (F.floor(F.col("pos") / step) % shape[i]).cast("long"))
        step *= shape[i]
    return rows
