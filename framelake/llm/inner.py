"""Operator 13: exact top-k by integer inner product, term at a time.

A component is a term, a vector's rounded component its weight. In a task the candidates come in
blocks of ``BLOCK`` rows, each turned into postings: for each term the rows that have it, and their weights. A
query is a sparse row (its terms with weight); each of its terms adds the weighted postings to a dense array of
scores, a partition of that array gives the block's best, and these are merged with the best of the blocks before.
Nothing is pruned, so the result is exact.

Queries and candidates are dealt to a grid of cells: a cell is one group of queries (``QUERY_BYTES``
at most) against one share of the candidates. A query is sent once for each share, a candidate once for each group of queries;
groups are as large as memory allows, and shares as many as keep a task's work near ``WORK`` products.
Candidates stream past the queries of their cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.llm._exec import run_starts, saved
from framelake.llm._vectors import matrix

BLOCK, QUERY_BYTES, WORK = 16384, 32 << 20, 1 << 35
LEAST, MOST = -(2**63), 2**63 - 1


def finite(v: Column) -> Column:
    """Not null, and without null or non-finite components; zero vectors count."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as 64-bit numbers, or Python's where one is too large for that."""
    if not len(x) or np.abs(x).max() * scale < 2.0**53:
        return np.floor(scale * x).astype(np.int64)
    return np.array([math.floor(scale * v) if abs(v) < 2.0**53 else scale * int(v) for v in x.tolist()], object)


def sparse(at: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and weights of each row."""
    rows = [values[a:b] for a, b in zip(at, at[1:], strict=False)]
    return [(t := np.flatnonzero(r), r[t]) for r in rows]


def postings(at: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """For each term its rows (all: a slice) and their weights."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(values)) - np.repeat(at[:-1], size)
    there = np.flatnonzero(values != 0)
    there = there[np.argsort(term[there], kind="stable")]
    row, term, weight = row[there], term[there], values[there]
    cuts = np.append(run_starts([term]), len(term))
    out = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[int(term[a])] = (slice(None) if b - a == len(size) else row[a:b], weight[a:b].copy())
    return out


class Best:
    """The ``k`` best candidates of one query so far."""

    __slots__ = ("k", "own", "ids", "scores")

    def __init__(self, k: int, own: int) -> None:
        self.k, self.own = k, own
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype == object:
            scores = np.array([min(MOST, max(LEAST, s)) for s in scores.tolist()], np.int64)
        n = self.k + 1  # the query's own row may be among them
        if len(scores) > n:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            if len(self.ids) == self.k:
                least = max(least, self.scores[-1])
            take = np.flatnonzero(scores >= least)
            ids, scores = ids[take], scores[take]
        other = ids != self.own
        ids, scores = np.concatenate((self.ids, ids[other])), np.concatenate((self.scores, scores[other]))
        order = np.lexsort((ids, ~scores))[: self.k]  # ~s = -s - 1, which has no overflow
        self.ids, self.scores = ids[order], scores[order]


def search_block(queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best], ids: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """All queries against one block of candidates."""
    lists = postings(at, values)
    most = int(np.abs(values).max(initial=0)) * int(np.diff(at).max(initial=0)) if len(values) else 0
    for (terms, weights), b in zip(queries, best, strict=True):
        exact = values.dtype != object and weights.dtype != object and most * int(np.abs(weights).max(initial=0)) < 2**62
        scores = np.zeros(len(ids), np.int64 if exact else object)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if t in lists:
                rows, weight = lists[t]
                scores[rows] += w * (weight if exact else weight.astype(object))
        b.add(ids, scores)


def _search(k: int, scale: int):
    """Queries of a cell come first and are kept, its candidates stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, best, held, n = None, [], [], [], 0

        def block() -> None:
            nonlocal held, n
            if held and queries:
                ids, flat, size = (np.concatenate([h[i] for h in held]) for i in range(3))
                search_block(queries, best, ids, np.concatenate(([0], np.cumsum(size))), whole(flat, scale))
            held, n = [], 0

        def results() -> Iterator[pa.RecordBatch]:
            block()
            if some := [b for b in best if len(b.ids)]:
                cols = [np.concatenate([np.full(len(b.ids), b.own) for b in some]), np.concatenate([b.ids for b in some]), np.concatenate([b.scores for b in some])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            cell, asks, ids = (b.column(c).to_numpy() for c in ("cell", "asks", "vec_id"))
            flat, at = matrix(b.column("embedding"))
            cuts = np.append(run_starts([cell, asks]), b.num_rows)
            for s, e in zip(cuts, cuts[1:], strict=False):
                if cell[s] != now:
                    yield from results()
                    now, queries, best = cell[s], [], []
                if asks[s]:
                    queries += sparse(at[s : e + 1] - at[s], whole(flat[at[s] : at[e]], scale))
                    best += [Best(k, i) for i in ids[s:e].tolist()]
                    continue
                for x in range(s, e, BLOCK):
                    y = min(e, x + BLOCK)
                    held.append((ids[x:y], flat[at[x] : at[y]], np.diff(at[x : y + 1])))
                    n += y - x
                    if n >= BLOCK:
                        block()
        yield from results()

    return run


def grid(n: int, asks: int, wide: int, least: int) -> tuple[int, int]:
    """Groups of queries, and shares of the candidates."""
    groups = max(1, -(-asks * wide * 8 // QUERY_BYTES))
    return groups, max(1, -(-max(least, -(-n * asks * wide // WORK)) // groups))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest scores for each of ``queries``.

    Both have (vec_id, embedding). A component x counts as floor(scale * x); the score is the inner product of
    these integers, ties go to smaller vec_ids, and a vector with the query's own vec_id is no candidate.
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; zero and empty vectors do.
    Of vectors of different lengths the longer one's further components count nothing. Rows that repeat a vec_id
    count once (their least vector). Scores beyond 64 bits count as the largest or smallest 64-bit number. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
        return saved(df.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))

    mine, asks = rows(vectors), rows(queries)
    n, (m, wide) = mine.count(), asks.agg(F.count("*"), F.max(F.size("embedding"))).first()
    groups, shares = grid(n, m, wide or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    side = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    cell = lambda df, group, share: df.withColumn("g", group).withColumn("s", share).select((F.col("g") * shares + F.col("s")).cast("int").alias("cell"), "vec_id", "embedding")
    theirs = cell(asks, side(groups), every(shares)).withColumn("asks", F.lit(1))
    both = cell(mine, every(groups), side(shares)).withColumn("asks", F.lit(0)).unionByName(theirs)
    dealt = both.repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("cell", F.desc("asks"))
    found = dealt.mapInArrow(_search(k, scale), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
