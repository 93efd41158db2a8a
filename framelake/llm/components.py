"""Connected components by alternating large-star and small-star steps; nothing on the driver.

Before each pair of steps every partition replaces its own edges by a star of each class
that it sees, so few rounds are needed. Once no more than ``SMALL`` edges are left they fit in one partition,
and the same contraction there ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._exec import drop, saved


#: Edges (two numbers each) that one task may hold: about 16 MB.
SMALL = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that edges (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    nodes, which = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = nodes[least_labels(which[: len(u)], which[len(u) :], len(nodes))]
    hit = nodes > low
    yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(low[hit])], ["u", "v"])


def _saved(edges: DataFrame) -> DataFrame:
    """Distinct edges, contracted within the partitions of the shuffle that makes them distinct."""
    return saved(edges.distinct().mapInArrow(_stars, "u bigint, v bigint"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    Each step is an aggregation with map-side combine and an equi-join, so a node
    with very many neighbours is never gathered in one task. Self links and nulls
    are left out; an empty input gives an empty result.
    """
    e = _saved(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v"))
    while not (small := e.count() <= SMALL) and not _done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _saved(moved.unionByName(low.select("u", F.col("m").alias("v"))))
        drop(e)
        e = new
    if small:
        e = saved(e.coalesce(1).mapInArrow(_stars, "u bigint, v bigint"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _done(e: DataFrame) -> bool:
    """Whether every node has one edge upwards at most and none that has one is pointed at."""
    up = e.select(F.col("u").alias("x"), F.lit(1).alias("is_u"), F.lit(0).alias("is_v"))
    ends = up.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("is_u"), F.lit(1).alias("is_v")))
    return not ends.groupBy("x").agg(F.sum("is_u").alias("n_u"), F.max("is_v").alias("n_v")).where("n_u + n_v > 1 and n_u > 0").limit(1).count()
