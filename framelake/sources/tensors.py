"""Headerless float dumps."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.sources.folders import local_folder


def read_tensors(spark: SparkSession, path: str, batch: int, channels: int, pattern: str = "outputs_batch*.bin", dtype: str = "<f4") -> DataFrame:
    """Rows (path, item, channels, anchors, tensor) of all dumps below ``path``; sizes must divide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = data.as_py()
                x = np.frombuffer(raw, dtype)
                if len(raw) % np.dtype(dtype).itemsize or not len(x) or len(x) % (batch * channels):
                    raise ValueError(f"{p}: {len(raw)} bytes are no {batch} x {channels} tensors")
                rows = x.reshape(batch, -1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([p] * batch), pa.array(range(batch), pa.int32()), pa.array([channels] * batch, pa.int32()), pa.array([rows.shape[1] // channels] * batch, pa.int32()), pa.array(list(rows), pa.list_(pa.float32()))], ["path", "item", "channels", "anchors", "tensor"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, item int, channels int, anchors int, tensor array<float>")


def read_tensor(spark: SparkSession, path: str, dtype: str = "<f4", shape: list[int] | None = None) -> DataFrame:
    """Rows (path, shape, tensor), whole files as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                x = np.frombuffer(data.as_py(), dtype).astype(np.float64)
                if shape and int(np.prod(shape)) != len(x):
                    raise ValueError(f"{p}: {len(x)} values do not fit {shape}")
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([shape or [len(x)]], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float64()))], ["path", "shape", "tensor"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, shape array<int>, tensor array<double>")


#: Values of a block, and of what is compared at once.
BLOCK_VALUES, STEP = 4 << 20, 1 << 18


def is_file(path: str) -> bool:
    return os.path.isfile(local_folder(path))


def blocks(spark: SparkSession, n: int, block: int) -> DataFrame:
    """Ranges [start, end) of n values, one for each task."""
    count = -(-n // block)
    return spark.range(0, count, 1, max(1, min(count, 10_000))).select((F.col("id") * block).alias("start"), F.least((F.col("id") + 1) * block, F.lit(n)).alias("end"))


def read_blocks(spark: SparkSession, path: str, dtype: str = "<f4", block: int = BLOCK_VALUES) -> DataFrame:
    """Rows (start, values) of a file of numbers in a mounted folder, by ranges of bytes: no task and no row holds the whole file. A cut last number is an error."""
    file, kind = local_folder(path), np.dtype(dtype)
    size = os.path.getsize(file)
    if size % kind.itemsize:
        raise ValueError(f"{path}: {size} bytes are no {dtype} numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in zip(b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
                for at in range(start, end, STEP):
                    x = np.fromfile(file, kind, min(STEP, end - at), offset=at * kind.itemsize).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x], pa.list_(pa.float64()))], ["start", "values"])

    return blocks(spark, size // kind.itemsize, block).mapInArrow(run, "start bigint, values array<double>")


def diff_files(spark: SparkSession, a: str, b: str, dtype: str = "<f4", tol: float = 1e-6, block: int = BLOCK_VALUES) -> DataFrame:
    """One row (n, max_abs, mean_abs, rms, n_over, share_over, n_a, n_b): differences of two files of numbers up to the shorter one.

    A task reads the same range of both, so nothing is shuffled but sums.
    """
    ranges, read, n_a, n_b = _ranges_of_both(spark, a, b, dtype, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in read(batches):
            d = np.abs(x - y)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (len(d), d.max(), d.sum(), (d * d).sum(), int((d > tol).sum()))], ["n", "most", "total", "squares", "over"])

    sums = ranges.mapInArrow(run, "n bigint, most double, total double, squares double, over bigint").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.max, "most"), (F.sum, "total"), (F.sum, "squares"), (F.sum, "over"))))
    n = F.coalesce("n", F.lit(0))
    return sums.select(n.alias("n"), F.col("most").alias("max_abs"), (F.col("total") / F.col("n")).alias("mean_abs"), F.sqrt(F.col("squares") / F.col("n")).alias("rms"), F.coalesce("over", F.lit(0)).alias("n_over"), (F.col("over") / F.col("n")).alias("share_over"), F.lit(n_a).alias("n_a"), F.lit(n_b).alias("n_b"))


def diff_folders(spark: SparkSession, a: str, b: str, pattern: str = "outputs_batch*.bin", dtype: str = "<f4", tol: float = 1e-6, block: int = BLOCK_VALUES) -> DataFrame:
    """Rows (ordinal, a, b, n, max_abs, mean_abs, rms, n_over): the i-th file of one mounted folder against the i-th of the other, by name, up to the shorter list and the shorter file of a pair.

    File names are listed on the driver; every task reads ranges of both files of a pair, so files may be of any size.
    """
    kind = np.dtype(dtype)
    names = [sorted(glob.glob(os.path.join(glob.escape(local_folder(p)), "**", pattern), recursive=True)) for p in (a, b)]
    pairs = [(i, x, y, min(os.path.getsize(x), os.path.getsize(y)) // kind.itemsize) for i, (x, y) in enumerate(zip(*names, strict=False))]
    listed = spark.createDataFrame(pairs, "ordinal bigint, a string, b string, n bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(block).cast("long")))
    ranges = listed.withColumn("start", starts).withColumn("end", F.least(F.col("start") + block, F.col("n")))
    total = sum(-(-p[3] // block) for p in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, y, _, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(start, end, STEP):
                    u, v = (np.fromfile(f, kind, min(STEP, end - at), offset=at * kind.itemsize).astype(np.float64) for f in (x, y))
                    d = np.abs(u - v)
                    yield pa.RecordBatch.from_arrays([pa.array([z]) for z in (i, len(d), d.max(), d.sum(), (d * d).sum(), int((d > tol).sum()))], ["ordinal", "k", "most", "total", "squares", "over"])

    sums = ranges.repartition(max(1, min(total, 10_000))).mapInArrow(run, "ordinal bigint, k bigint, most double, total double, squares double, over bigint")
    each = sums.groupBy("ordinal").agg(F.max("most").alias("max_abs"), (F.sum("total") / F.sum("k")).alias("mean_abs"), F.sqrt(F.sum("squares") / F.sum("k")).alias("rms"), F.sum("over").alias("n_over"))
    return listed.join(each, "ordinal", "left").select("ordinal", "a", "b", "n", "max_abs", "mean_abs", "rms", F.coalesce("n_over", F.lit(0)).alias("n_over"))


def top_differences(spark: SparkSession, a: str, b: str, n: int, dtype: str = "<f4", block: int = BLOCK_VALUES) -> DataFrame:
    """Rows (pos, a, b, abs_diff): the ``n`` largest differences of two files, of equal ones the first; each range sends its ``n`` largest."""
    ranges, read, n_a, n_b = _ranges_of_both(spark, a, b, dtype, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x, y in read(batches):
            d = np.abs(x - y)
            best = np.lexsort((np.arange(len(d)), -d))[:n] if len(d) <= 4 * n else None
            if best is None:
                least = np.partition(d, len(d) - n)[len(d) - n]
                some = np.flatnonzero(d >= least)
                best = some[np.lexsort((some, -d[some]))[:n]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (best + at, x[best], y[best], d[best])], ["pos", "a", "b", "abs_diff"])

    return ranges.mapInArrow(run, "pos bigint, a double, b double, abs_diff double").orderBy(F.desc("abs_diff"), "pos").limit(n)


def _ranges_of_both(spark: SparkSession, a: str, b: str, dtype: str, block: int):
    files, kind = [local_folder(p) for p in (a, b)], np.dtype(dtype)
    sizes = [os.path.getsize(f) for f in files]
    for f, s in zip(files, sizes, strict=True):
        if s % kind.itemsize:
            raise ValueError(f"{f}: {s} bytes are no {dtype} numbers")
    n = [s // kind.itemsize for s in sizes]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for start, end in zip(batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True):
                for at in range(start, end, STEP):
                    yield at, *(np.fromfile(f, kind, min(STEP, end - at), offset=at * kind.itemsize).astype(np.float64) for f in files)

    return blocks(spark, min(n), block), read, *n


def numbered(files: DataFrame, by: str = "path") -> DataFrame:
    """``ordinal`` by name, to pair the i-th file of one folder with that of another."""
    names = files.select(by).distinct().withColumn("ordinal", F.row_number().over(W.orderBy(by)) - 1)  # file names, not rows
    return files.join(names, by)


def tee(df: DataFrame, path: str) -> DataFrame:
    """Writes a copy and goes on from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dumps(df: DataFrame, path: str, batch: str = "batch", item: str = "slot", tensor: str = "tensor", name: str = "outputs_batch%06d.bin", dtype: str = "<f4") -> None:
    """One headerless file for each batch, its items in order; a repeated task writes the same file again."""
    folder = local_folder(path)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, part = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(part, os.path.join(folder, name % now))

        for b in batches:
            for k, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now:
                    close()
                    now, part = k, os.path.join(folder, f".{uuid.uuid4().hex}")
                    out = open(part, "wb")  # noqa: SIM115
                out.write(np.asarray(values.values, dtype).tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    df.select(batch, tensor, item).repartition(batch).sortWithinPartitions(batch, item).mapInArrow(run, "n int").count()
