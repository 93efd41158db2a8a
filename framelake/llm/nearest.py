"""Operator 8: nearest neighbours by randomly rotated one-bit codes with error bounds.

Rows are dealt to cells around centres (a few rounds of k-means on a bounded sample, ``SAMPLE``; every row is
indexed). In its cell a vector is taken from the cell's centre, normalised, turned by a random orthogonal
matrix into ``bits`` dimensions and kept as one bit each, with two correction scalars: its
length and its inner product with its own code. A query is turned likewise and rounded to
``planes`` bits, so its inner product with a code is a few popcounts. The estimate divided by
the correction scalar has a known error; every vector whose smallest possible distance is
within the best ``k`` found so far is measured exactly, so a wrong estimate costs time, not
results, but for the ``epsilon`` standard errors of the bound.

Each row is sent once, to its cell. A query first goes to its nearest cells; the distance of
its ``k``-th neighbour there then rules out cells whose ball (centre and largest distance of a row) lies
further away, and goes along to the other cells as a bound. Queries stream past the rows of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.llm._exec import run_starts, saved
from framelake.llm._vectors import by_length, matrix, one_row_each

#: Rows of a cell that one task holds at most, and at least where there are enough; larger cells are split.
ROWS, LEAST = 32768, 1024
#: Rows for each cell on average, vectors that the centres are fitted on, and cells that every query visits.
CELL, SAMPLE, FIRST = 4096, 20_000, 2


def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """``d`` orthonormal rows of ``bits`` dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, d, bits])).standard_normal((bits, d)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """One-bit codes of the rows of a matrix around a centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.x, self.turn, self.centre, bits = x, turn, centre, turn.shape[1]
        y = x - self.centre
        self.norm = np.sqrt((y * y).sum(axis=1))
        y = (y / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn
        sign = y > 0
        self.packed = np.packbits(sign, axis=1, bitorder="little").view(np.uint64).T.copy()
        self.ones = sign.sum(axis=1)
        own = np.maximum(np.abs(y).sum(axis=1) / np.sqrt(bits), 1e-9)  # <code, vector>
        self.spread = np.sqrt(np.maximum(0, 1 - own * own)) / own / np.sqrt(bits - 1)
        self.own = own

    def nearest(self, q: np.ndarray, k: int, epsilon: float, planes: int, skip: np.ndarray, ids: np.ndarray, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the ``k`` nearest rows of distance ``bound`` at most, but for those in ``skip``; ties to smaller ids."""
        bits = self.turn.shape[1]
        c = q - self.centre
        length = np.sqrt((c * c).sum())
        y = (c / (length or 1)) @ self.turn
        low, step = y.min(), (y.max() - y.min()) / (2**planes - 1) or 1.0
        level = np.rint((y - low) / step).astype(np.uint64)
        dot = np.zeros(len(self.x), np.int64)
        for p in range(planes):
            plane = np.packbits((level >> np.uint64(p)) & np.uint64(1) == 1, bitorder="little").view(np.uint64)
            for w, word in enumerate(plane):
                dot += np.bitwise_count(self.packed[w] & word).astype(np.int64) << p
        total = float(level.sum())
        # <code, query>, the code being +-1/sqrt(bits) and the query low + step * level
        inner = (step * (2 * dot - total) + low * (2 * self.ones - bits)) / np.sqrt(bits)
        cosine = inner / self.own
        error = epsilon * self.spread + step / self.own  # rounding moves the product by less than a step
        base, scale = self.norm**2 + length**2, 2 * self.norm * length
        guess = base - scale * cosine
        least = base - scale * np.minimum(1, cosine + error)
        guess[skip] = least[skip] = np.inf
        if not (m := min(k, len(guess) - len(skip))):
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.argpartition(guess, m - 1)[:m]
        worst = min(((self.x[first] - q) ** 2).sum(axis=1).max(), bound * bound)
        rows = np.flatnonzero(least <= worst * (1 + 1e-9) + 1e-12)
        exact = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], exact))[:m]
        return rows[best], exact[best]


def centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Cell centres by k-means."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = cell_distances(sample, c).argmin(axis=1)
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def cell_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T)))


def _assign(known: dict[int, np.ndarray]):
    """(vec_id, embedding, cell, far): the nearest centre of its length, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, at = matrix(b.column("embedding"))
            cell, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for rows, x in by_length(at, flat):
                d = x.shape[1]
                c = known.get(d, np.zeros((1, d)))
                cell[rows] = (d << 16) + cell_distances(x, c).argmin(axis=1)
                far[rows] = np.sqrt(((x - c[cell[rows] & 0xFFFF]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell), pa.array(far)], ["vec_id", "embedding", "cell", "far"])

    return run


def _visits(known: dict[int, np.ndarray], cells: dict[int, tuple[int, float]], first: int, rest: bool):
    """Queries once for each part of each cell that they visit: the nearest ``first`` ones, or all further ones whose ball is within their bound."""
    by_length_of = {d: np.array(sorted(x for x in cells if x >> 16 == d)) for d in {x >> 16 for x in cells}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, at = matrix(b.column("embedding"))
            bound = b.column("bound").to_numpy()
            for rows, x in by_length(at, flat):
                d = x.shape[1]
                if d not in by_length_of:
                    continue
                own = by_length_of[d]
                c = known.get(d, np.zeros((1, d)))[own & 0xFFFF]
                far = cell_distances(x, c)
                order = np.argsort(far, axis=1, kind="stable")
                goes = np.zeros(far.shape, bool)
                np.put_along_axis(goes, order[:, :first], True, axis=1)
                if rest:
                    radius = np.array([cells[x][1] for x in own.tolist()])
                    goes = ~goes & (far - radius[None] <= bound[rows][:, None] * (1 + 1e-9) + 1e-6)
                i, j = np.nonzero(goes)
                split = np.array([cells[x][0] for x in own.tolist()])[j]
                i, j = np.repeat(i, split), np.repeat(j, split)
                part = np.arange(len(i)) - np.repeat(np.cumsum(split) - split, split)
                take = pa.array(rows[i])
                yield pa.RecordBatch.from_arrays([pa.array(own[j]), pa.array(part.astype(np.int32)), b.column("vec_id").take(take), b.column("embedding").take(take), b.column("bound").take(take)], ["cell", "part", "vec_id", "embedding", "bound"])

    return run


def _search(known: dict[int, np.ndarray], k: int, expand: int, epsilon: float, planes: int, seed: int):
    """Rows of a part of a cell come first and are kept, its queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        now, held, codes, names, where = None, [], None, np.zeros(0, np.int64), {}

        def close() -> None:
            nonlocal codes, names, where
            if held:
                x = np.concatenate([h[1] for h in held])
                names = np.concatenate([h[0] for h in held])
                d = x.shape[1]
                if d not in turns:
                    turns[d] = rotation(d, 64 * -(-d * expand // 64), seed)
                codes = Codes(x, known.get(d, np.zeros((1, d)))[now[0] & 0xFFFF], turns[d])
                where = dict(zip(names.tolist(), range(len(names)), strict=True))
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy() for c in ("cell", "part", "asks", "vec_id", "bound")}
            flat, at = matrix(b.column("embedding"))
            cuts = np.append(run_starts([cols["cell"], cols["part"], cols["asks"]]), b.num_rows)
            out = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = (int(cols["cell"][s]), int(cols["part"][s]))
                if key != now:
                    now, codes = key, None
                    held.clear()
                x = flat[at[s] : at[e]].reshape(e - s, -1)
                if not cols["asks"][s]:
                    held.append((cols["vec_id"][s:e].copy(), x))
                    continue
                close()
                if codes is None:
                    continue
                for i in range(s, e):
                    own = where.get(int(cols["vec_id"][i]))
                    r, dist = codes.nearest(x[i - s], k, epsilon, planes, np.array([own] if own is not None else [], np.int64), names, cols["bound"][i])
                    out.append((np.full(len(r), cols["vec_id"][i]), names[r], dist))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, expand: int = 4, epsilon: float = 3.0, planes: int = 8, seed: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` to each of ``queries``, nearest first.

    Both have (vec_id, embedding). ``score`` is the Euclidean distance of the original vectors
    in double precision, ties go to smaller vec_ids, and a vector with the query's own vec_id
    is no candidate. Vectors that are null, zero or hold null or non-finite components take no
    part; vectors of another length are no candidates. Rows that repeat a vec_id count once (their least vector).
    """
    spark = vectors.sparkSession
    rows, asks = saved(one_row_each(vectors, "vec_id", "embedding")), saved(one_row_each(queries, "vec_id", "embedding"))
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / max(1, n)))).limit(2 * SAMPLE)
    flat, at = matrix(some.select("embedding").toArrow().column("embedding"))
    known = {x.shape[1]: centres(x, min(1024, max(1, n * len(x) // len(at) // CELL)), seed) for _, x in by_length(at, flat) if len(x) >= 64}
    placed = saved(rows.mapInArrow(_assign(known), f"vec_id bigint, embedding {rows.schema['embedding'].dataType.simpleString()}, cell bigint, far double"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_part = min(ROWS, max(LEAST, n // (2 * least)))  # small inputs are dealt to all tasks as well
    # 1024 cells for each of at most SAMPLE / 32 frequent lengths, and one for each other length
    cells = {r.cell: (-(-r.n // per_part), r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    n_parts = max(least, sum(p for p, _ in cells.values()))
    splits = F.create_map(*[F.lit(v) for c, (p, _) in cells.items() if p > 1 for v in (c, p)]) if any(p > 1 for p, _ in cells.values()) else None
    parts_of = F.coalesce(splits[F.col("cell")], F.lit(1)) if splits is not None else F.lit(1)
    mine = placed.select("cell", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int").alias("part"), "vec_id", "embedding", F.lit(float("inf")).alias("bound"), F.lit(0).alias("asks"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    kind = rows.schema["embedding"].dataType.simpleString()

    def search(asks: DataFrame, rest: bool) -> DataFrame:
        theirs = asks.mapInArrow(_visits(known, cells, FIRST, rest), f"cell bigint, part int, vec_id bigint, embedding {kind}, bound double").withColumn("asks", F.lit(1))
        both = mine.unionByName(theirs).repartition(n_parts, "cell", "part").sortWithinPartitions("cell", "part", "asks")
        found = both.mapInArrow(_search(known, k, expand, epsilon, planes, seed), "query_id bigint, vec_id bigint, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = saved(search(asks.withColumn("bound", F.lit(float("inf"))), False))
    if len(cells) > FIRST:
        bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        asks = saved(asks.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
        near = near.unionByName(search(asks, True)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
