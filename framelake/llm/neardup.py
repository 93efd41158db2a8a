"""Operator 1: near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine is a distance: ``|a - b|**2 = 2 - 2 cos``. Each of
``tables`` hash tables cuts ``WIDTH``-wide steps along ``projections`` random Gaussian
directions; a bucket is one combination of steps, as a 32-bit number. The number of projections follows the
number of vectors (about ``LOAD`` unrelated ones in a bucket: comparing these in one matrix product
costs less than sending vectors to more tables), the number of tables follows
from the chance of a pair right at the threshold to be found (``recall``).

To a bucket go 16-bit roundings of the normalised vectors. Their products are within a proven
margin of the cosine: pairs above it are links, pairs below are none, and the few inside the margin are
checked on the original vectors in double precision. A pair that meets in several tables is
counted in the first of them: the buckets of the pair in earlier tables are worked out again from the rounded vectors. Equal vectors stand for one, with a weight. Buckets of more
than ``BLOCK`` vectors are checked block against block, so no task gets an unbounded group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _text
from framelake.llm._exec import binary_rows, join_unique, parts, run_starts, saved, small, whole_groups
from framelake.llm._vectors import by_length, matrix, one_row_each
from framelake.llm.components import components

BLOCK, LOAD, WIDTH = 16384, 4096, 4.0
#: Vectors are rounded to multiples of 1 / GRID.
GRID = 32767


def collision(distance: float, width: float) -> float:
    """The chance of two points to share a step of one p-stable projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def sizes(n: int, cosine: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """Projections a table, and tables."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(2.0, n / LOAD)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def margin(d: int) -> float:
    """How far the float product of two rounded vectors of ``d`` components may be from their cosine."""
    return 2.1 * math.sqrt(d) / (2 * GRID) + d * 2.0**-22 + 1e-6


class Tables:
    """The hash tables for rounded vectors of ``d`` components.

    Projections are whole numbers and so are rounded vectors: products and sums are exact, in whatever order they are
    taken, and a bucket can be worked out again anywhere. So a vector goes to a table without its buckets in the others.
    """

    def __init__(self, d: int, k: int, tables: int, width: float, seed: int) -> None:
        self.d, self.k = d, k
        scale = 2 ** min(16, 52 - 15 - 3 - max(1, d - 1).bit_length())
        rng = np.random.Generator(np.random.PCG64([seed, d]))
        self.planes = np.rint(rng.standard_normal((d, tables * k)) * scale)
        self.shift = np.rint(rng.uniform(0, width, tables * k) * scale * GRID)
        self.width = width * scale * GRID

    def keys(self, code: np.ndarray, tables: int) -> np.ndarray:
        """The buckets of rounded vectors (rows of ``code``) in the first ``tables`` tables, as 32-bit numbers."""
        n = tables * self.k
        step = np.floor((code.astype(np.float64) @ self.planes[:, :n] + self.shift[:n]) / self.width).astype(np.int64).view(np.uint64).reshape(len(code), tables, self.k)
        h = np.full((len(code), tables), self.d, np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(self.k):
            h = _text.mix(h + step[:, :, j])
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def known_tables(k: int, tables: int, width: float, seed: int) -> Callable[[int], Tables]:
    return functools.cache(lambda d: Tables(d, k, tables, width, seed))


def _keys(k: int, tables: int, width: float, seed: int):
    """(vec_id, weight, code, keys): the rounded vector, and its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known_tables(k, tables, width, seed)
        for b in batches:
            if not b.num_rows:
                continue
            flat, at = matrix(b.column("embedding"))
            keys, code = np.zeros((b.num_rows, tables), np.int32), [b""] * b.num_rows
            for rows, x in by_length(at, flat):
                rounded = np.rint(unit(x) * GRID).astype(np.int16)
                keys[rows] = of(x.shape[1]).keys(rounded, tables)
                for i, r in zip(rows.tolist(), rounded, strict=True):
                    code[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("weight"), pa.array(code, pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))], ["vec_id", "weight", "code", "keys"])

    return run


def link_block(code: np.ndarray, weight: np.ndarray, of: Tables, table: int, half: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each rounded vector of a bucket: weight of its links that no earlier table has, and its class (as a row number);
    and the pairs inside the margin that no earlier table has.

    ``half`` tells the two blocks of a large bucket apart; only pairs across them are checked.
    """
    x = code.astype(np.float32) / np.float32(GRID)
    n, edge = len(x), margin(x.shape[1])
    keys, known = np.zeros((n, table), np.int32), np.zeros(n, bool)  # only of vectors that are in a pair
    links, label = np.zeros(n, np.int64), np.arange(n)
    unsure = [(label[:0], label[:0])]
    step = max(16, min(256, (1 << 20) // n))
    for a in range(0, n, step):
        near = x[a : a + step] @ x[a:].T
        i, j = np.nonzero(near >= cosine - edge)
        value = near[i, j]
        i, j = i + a, j + a
        keep = i < j
        if half is not None:
            keep &= half[i] != half[j]
        i, j, value = i[keep], j[keep], value[keep]
        if not len(i):
            continue
        ask = np.unique(np.concatenate((i, j)))
        ask = ask[~known[ask]]
        if table and len(ask):
            keys[ask], known[ask] = of.keys(code[ask], table), True
        new = np.ones(len(i), bool)
        for part in range(0, len(i), 1 << 16):
            some = slice(part, part + (1 << 16))
            new[some] = ~(keys[i[some]] == keys[j[some]]).any(axis=1)
        sure = value >= cosine + edge
        unsure.append((i[new & ~sure], j[new & ~sure]))
        i, j, new = i[sure], j[sure], new[sure]
        np.add.at(links, i[new], weight[j[new]])
        np.add.at(links, j[new], weight[i[new]])
        while True:  # classes so far, with these pairs
            old = label.copy()
            low = np.minimum(label[i], label[j])
            for end in (label[i], label[j]):
                np.minimum.at(label, end, low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == old).all():
                break
    return links, label, *(np.concatenate(c) for c in zip(*unsure, strict=True))


#: Vectors of different lengths may have equal bucket numbers: the length belongs to the bucket.
BUCKET = ["t", "key", "d", "a", "b"]


def _links(cosine: float, k: int, tables: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known_tables(k, tables, width, seed)
        for t in whole_groups(batches, BUCKET):
            vec, weight, table, d, a, b, own = (t.column(c).to_numpy() for c in ("vec_id", "weight", "t", "d", "a", "b", "own"))
            cuts = np.append(run_starts([t.column(c).to_numpy() for c in BUCKET]), t.num_rows)
            codes = binary_rows(t.column("code"), np.int16)
            out = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s < 2:
                    continue
                code = np.concatenate(codes[s:e]).reshape(e - s, -1)
                n, label, i, j = link_block(code, weight[s:e], of(int(d[s])), int(table[s]), own[s:e] if a[s] != b[s] else None, cosine)
                ids = vec[s:e]
                low = ids.copy()
                np.minimum.at(low, label, ids)
                low = low[label]
                hit = np.flatnonzero((n > 0) | (low != ids))
                if len(hit):
                    out.append((ids[hit], n[hit], low[hit], np.zeros(len(hit), bool)))
                if len(i):
                    out.append((ids[i], np.zeros(len(i), np.int64), ids[j], np.ones(len(i), bool)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["vec_id", "n", "low", "unsure"])

    return run


def _exact(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Of pairs (vec_id, low) the links by double-precision cosine, both ways round: (vec_id, n, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (one, at), (two, _) = matrix(b.column("one")), matrix(b.column("two"))
            link = np.zeros(b.num_rows, bool)
            for rows, x in by_length(at, one):
                y = two[at[rows][:, None] + np.arange(x.shape[1])]
                link[rows] = (unit(x) * unit(y)).sum(axis=1) >= cosine
            v, w, wv, ww = (b.column(c).to_numpy()[link] for c in ("vec_id", "low", "w_one", "w_two"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((v, w), (ww, wv), (w, v))], ["vec_id", "n", "low"])

    side = lambda key, name: vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias(name), F.col("weight").alias(f"w_{name}"))
    return pairs.join(side("vec_id", "one"), "vec_id").join(side("low", "two"), "low").mapInArrow(run, "vec_id bigint, n bigint, low bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vec_id of ``vectors`` (vec_id, embedding).

    Links are pairs found with a double-precision cosine of at least ``cosine``; a pair at the
    threshold is found with chance ``recall``, closer ones with more. Vectors that are null,
    zero or hold null or non-finite components, and vectors of different lengths, link with
    nothing. Rows that repeat a vec_id count once (their least vector); rows with a null vec_id give a row with
    nulls. Other columns are ignored.
    """
    # Equal vectors are told by 128 bits, so that vectors themselves are no keys of a shuffle.
    hashed = one_row_each(vectors, "vec_id", "embedding").withColumn("e1", F.xxhash64(F.lit(1), "embedding")).withColumn("e2", F.xxhash64(F.lit(2), "embedding"))
    good = saved(hashed)
    reps = good.groupBy("e1", "e2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    chosen = saved(good.select("vec_id", "embedding").join(small(saved(reps.select("vec_id", "weight"))), "vec_id"))
    n = chosen.count()
    k, tables = sizes(n, cosine, recall)
    keyed = saved(chosen.mapInArrow(_keys(k, tables, WIDTH, seed), "vec_id bigint, weight bigint, code binary, keys array<int>"))
    length = (F.octet_length("code") / 2).cast("int").alias("d")
    each = keyed.select(length, F.posexplode("keys").alias("t", "key"))
    large = each.groupBy("t", "key", "d").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("t", "key", "d", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = small(saved(large))
    rows = keyed.select("vec_id", "weight", "code", length, F.posexplode("keys").alias("t", "key")).join(large, ["t", "key", "d"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "key", "d", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), "own", "vec_id", "weight", "code")
    n_parts = parts(keyed, F.octet_length("code") + 44, tables)
    found = saved(rows.repartition(n_parts, *BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(_links(cosine, k, tables, WIDTH, seed), "vec_id bigint, n bigint, low bigint, unsure boolean"))
    links, pairs = found.where("not unsure").drop("unsure"), found.where("unsure").select("vec_id", "low")
    if pairs.limit(1).count():
        links = saved(links.unionByName(_exact(pairs, chosen, cosine)))
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = components(links, "vec_id", "low")
    per_rep = reps.join(counts, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per_rep = per_rep.where("weight > 1 or component is not null").select("e1", "e2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), "weight")
    linked = join_unique(good.select("vec_id", "e1", "e2"), saved(per_rep), ["e1", "e2"], "weight").select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
