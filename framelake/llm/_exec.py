"""Shared plumbing of the text operators: scratch tables, partition counts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows and bytes; keys that are held to be hot at most.
BROADCAST_ROWS, BROADCAST_BYTES, HOT_KEYS = 300_000, 48 << 20, 20_000


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one is set only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
        else:
            if not (spark.sparkContext.master + "[").startswith("local["):
                raise ValueError("spark.checkpoint.dir must be a folder that all executors share")
            root = tempfile.mkdtemp(prefix="framelake-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/framelake-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of saved()."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parts(df: DataFrame, size: Column | None = None, factor: float = 1.0, mb: int = 24) -> int:
    """Partitions of about ``mb`` MB for ``factor`` times the bytes that ``df`` has, spark.sql.shuffle.partitions at least.

    ``size`` gives each row's bytes and is summed over all rows, so compression and repetitive
    texts do not matter; without it rows are counted as 100 bytes each.
    """
    total = df.agg(F.sum(size) if size is not None else F.count("*") * 100).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total * factor) // (mb << 20)))


def text_bytes(name: str) -> Column:
    return F.octet_length(F.col(name).cast("string")).cast("long")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side may be broadcast: by its rows, and by its bytes, since nothing bounds a text."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return n <= rows and (total or 0) <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is within the bounds; else Spark joins by sort and merge."""
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def join_unique(many: DataFrame, side: DataFrame, keys: list[str], n: str, hot: int = 100_000) -> DataFrame:
    """Left join of ``many`` with ``side``, which has one row for each key and in ``n`` how many rows of ``many`` have it.

    A small side is broadcast. Of a large one only keys that very many rows have (``hot`` at least, and so many that there are
    no more than HOT_KEYS of them) are broadcast, all others are merged, so no key's rows meet in one task. ``many`` is read twice then and should be a table.
    """
    if fits(side):
        return many.join(F.broadcast(side.drop(n)), keys, "left")
    hot = max(hot, (side.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    often = side.where(F.col(n) >= hot).drop(n)
    if not fits(often, HOT_KEYS + 1):  # keys of unbounded length
        return many.join(side.drop(n).hint("merge"), keys, "left")
    rest = many.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(side.where(F.col(n) < hot).drop(n).hint("merge"), keys, "left")
    return many.join(F.broadcast(often), keys).unionByName(rest)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them: about ``limit`` bytes, or one run."""
    rest: pa.Table | None = None
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            t = pa.Table.from_batches([batch.slice(at, step)])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = run_starts([t.column(k).to_numpy() for k in keys])[-1]
            if last:
                yield t.slice(0, last).combine_chunks()
            rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def binary_rows(col: pa.ChunkedArray | pa.Array, dtype: type) -> list[np.ndarray]:
    """Each value of a binary column as an array, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].tolist()
    data = memoryview(col.buffers()[2] or b"")
    return [np.frombuffer(data[a:b], dtype) for a, b in zip(at, at[1:], strict=False)]


def run_starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal values begin."""
    change = np.zeros(len(cols[0]), bool)
    change[:1] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def split_blob(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of flat[at[i]:at[i+1]] (numbers, or rows of them), without a Python loop; below 2 GB."""
    flat = np.ascontiguousarray(flat)
    width = flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(flat)])
