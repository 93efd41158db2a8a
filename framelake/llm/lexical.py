"""Operator 11: ranked lexical search, document at a time over sharded compressed postings.

``build_index`` reads the texts once and writes an index without any shuffle: a map task gathers some ``SEGMENT`` bytes of
documents, orders them by doc_id and writes for each term a row with the term's postings (place in the segment and
occurrences, as differences in variable-length bytes), and one row with the segment's documents.
The numbers that weights need (documents, terms, documents of a term) are sums over these rows.

``search`` joins the index with the terms of the queries and deals the postings that it needs by segment. A task is a shard. For each of its
segments one heap merges the postings of all query terms by doc_id; a document at a time, the terms met add to the scores of the
queries that have them, and scores that beat the worst of a query's ``k`` go to its bounded heap, by score, then doc_id.
A window merges the shards' results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.llm._exec import binary_rows, parts, run_starts, saved, split_blob, whole_groups
from framelake.llm._text import WORD_CLASSES, Words, slices, strings

#: Bytes of text of a segment (one document at least), queries that are scored together, and bytes of query terms that are broadcast at most.
SEGMENT, QUERIES, BROADCAST = 8 << 20, 1000, 16 << 20
#: The same class as WORD_CLASSES["alnum"] once A-Z is lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "segment bigint, term string, n bigint, total bigint, bytes bigint, body binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers, seven bits a byte, the low ones first, all bytes but a number's last with the high bit; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > j)
        out[start[rows] + j] = (values[rows] >> 7 * j & 127) | np.where(size[rows] > j + 1, 128, 0)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128) + 1
    start = np.concatenate(([0], end[:-1])).astype(np.int64)
    size = end - start
    out = np.zeros(len(end), np.int64)
    for j in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > j)
        out[rows] |= (data[start[rows] + j].astype(np.int64) & 127) << 7 * j
    return out


def words_of(w: Words) -> pa.Array:
    """The words as strings, without a Python loop."""
    inside = w.data[WORD_CLASSES["alnum"][w.data]] if len(w.data) else w.data
    at = np.concatenate(([0], np.cumsum(w.end - w.start))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(w.start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(inside))])


def segment_rows(ids: np.ndarray, text: pa.Array, segment: int) -> Iterator[pa.RecordBatch]:
    """The index rows of some documents."""
    order = np.argsort(ids, kind="stable")
    ids, w = ids[order], Words(text.take(pa.array(order)), "alnum", lower=True)
    size = w.counts
    coded = words_of(w).dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), size)
    both, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + doc, return_counts=True)
    term, doc = both // max(1, len(ids)), both % max(1, len(ids))
    at = run_starts([term]) if len(term) else np.zeros(0, np.int64)
    step = np.diff(doc, prepend=0)
    step[at] = doc[at]
    data, width = pack(np.stack((step, times), axis=1).ravel())
    ends = np.concatenate(([0], np.cumsum(width)))[np.append(2 * at, 2 * len(term))]
    df = np.diff(np.append(at, len(term)))
    rows = lambda n, terms, df, total, wide, body: pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), terms, pa.array(df), pa.array(total), pa.array(wide), body], ["segment", "term", "n", "total", "bytes", "body"])
    docs = np.stack((ids, size)).tobytes()
    yield rows(1, pa.nulls(1, pa.string()), np.array([(size > 0).sum()]), np.array([size.sum()]), np.array([len(docs)]), pa.array([docs], pa.binary()))
    if len(at):
        yield rows(len(at), coded.dictionary.take(pa.array(term[at])), df, np.add.reduceat(times, at), np.diff(ends), split_blob(data, ends))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, done = [], 0, 0
    first = TaskContext.get().partitionId() << 32

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n, done
        ids, text = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
        held, n, done = [], 0, done + 1
        yield from segment_rows(ids, text, first + done)

    for whole in batches:
        for b in slices(whole, "text", SEGMENT):
            held.append((b.column("doc_id").to_numpy(), strings(b.column("text"))))
            n += held[-1][1].nbytes
            if n >= SEGMENT:
                yield from flush()
    if held:
        yield from flush()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder: for each segment a row for each term, and one with a null term for its documents.

    ``n`` is the number of documents with the term (with any term), ``total`` that of occurrences, ``bytes`` the size of ``body``, so that
    statistics need not read it. Null texts have no terms. Every row is a
    document, repeated ids too; rows without doc_id are left out.
    """
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(_index, INDEX))


def terms_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


class Heaps:
    """The ``k`` best (score, doc_id) of each query of a group."""

    def __init__(self, k: int) -> None:
        self.k, self.heaps = k, {}

    def level(self, item: int) -> int:
        """The score below which nothing more is taken."""
        heap = self.heaps.get(item, [])
        return heap[0][0] if len(heap) == self.k else 1

    def offer(self, item: int, score: int, doc_id: int) -> int:
        heap = self.heaps.setdefault(item, [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -doc_id))
        elif (score, -doc_id) > heap[0]:
            heapq.heapreplace(heap, (score, -doc_id))
        return self.level(item)


class Postings:
    """The postings of a segment for the terms of a group of queries."""

    def __init__(self, docs: np.ndarray, bodies: list[np.ndarray], weights: np.ndarray, items: list[np.ndarray], times: list[np.ndarray], n_docs: int, n_terms: int) -> None:
        self.ids, size = docs.reshape(2, -1)
        m = 100 - 25 + 25 * size * n_docs // max(1, n_terms)
        flat = [unpack(b).reshape(-1, 2) for b in bodies]
        self.docs = [np.cumsum(p[:, 0]) for p in flat]
        self.gains = [w * (1_000_000_000 * p[:, 1] // (1000 * p[:, 1] + 12 * m[d])) for p, d, w in zip(flat, self.docs, weights.tolist(), strict=True)]
        self.items, self.times = items, times

    def search(self, heaps: Heaps) -> None:
        """Document at a time: one heap of cursors, one for each term."""
        n = len(self.docs)
        names, place = np.unique(np.concatenate(self.items), return_inverse=True)
        size = np.array([len(i) for i in self.items])
        first, times = np.cumsum(size) - size, np.concatenate(self.times).astype(np.int64)
        start = np.concatenate(([0], np.cumsum([len(d) for d in self.docs])))[:-1]
        gains, seen = np.concatenate(self.gains), np.zeros(n, np.int64)
        least = np.array([heaps.level(i) for i in names.tolist()], np.int64)
        score = np.zeros(len(names), np.int64)

        def score_document(doc: int, terms: list[int]) -> None:
            t = np.array(terms)
            gain = gains[start[t] + seen[t]]
            seen[t] += 1
            s = size[t]
            entry = np.arange(s.sum()) + np.repeat(first[t] - (np.cumsum(s) - s), s)
            score[:] = 0
            np.add.at(score, place[entry], np.repeat(gain, s) * times[entry])
            for q in np.flatnonzero(score >= least).tolist():
                least[q] = heaps.offer(int(names[q]), int(score[q]), int(self.ids[doc]))

        now, terms = -1, []
        for key in heapq.merge(*((d * n + t).tolist() for t, d in enumerate(self.docs))):
            doc, term = divmod(key, n)
            if doc != now:
                if terms:
                    score_document(now, terms)
                now, terms = doc, []
            terms.append(term)
        if terms:
            score_document(now, terms)


def _search(k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for t in whole_groups(batches, ["segment", "part"]):
            cuts = np.append(run_starts([t.column("segment").to_numpy(), t.column("part").to_numpy()]), t.num_rows)
            weights = t.column("weight").to_numpy()
            bodies = binary_rows(t.column("body"), np.uint8)
            lists = [(c := t.column(name).combine_chunks()).values.to_numpy() for name in ("items", "times")]
            at = c.offsets.to_numpy()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if weights[s] >= 0 or e - s < 2:
                    continue  # no term of these queries is in the segment
                items, times = ([x[at[i] : at[i + 1]] for i in range(s + 1, e)] for x in lists)
                Postings(bodies[s].view(np.int64), bodies[s + 1 : e], weights[s + 1 : e], items, times, n_docs, n_terms).search(heaps)
        rows = [(i, score, -doc) for i, heap in heaps.heaps.items() for score, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["item_id", "score", "doc_id"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each of ``queries`` (item_id, text).

    With N documents that have terms, L terms in all, df documents with a term and n terms in a document, a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25 n N div L, and each occurrence of the term in the query gives a
    document with tf of it w * (10**9 tf div (1000 tf + 12 m)). Equal scores go by doc_id. Queries without terms, or whose terms no document has, have
    no rows; rows that repeat an item_id count once (their least text), rows without one not at all. Other columns are ignored.
    """
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    groups = -(-asked.count() // QUERIES) or 1
    each = asked.select(F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("part"), "item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("part", "term", "item_id").agg(F.count("*").alias("times"))
    terms = each.groupBy("part", "term").agg(F.sort_array(F.collect_list(F.struct("item_id", "times"))).alias("e")).select("part", "term", F.col("e.item_id").alias("items"), F.col("e.times").alias("times"))
    terms = saved(terms)

    def side(df: DataFrame, size: Column) -> DataFrame:
        return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df.hint("merge")

    postings, docs = index.where("term is not null"), index.where("term is null")
    n_docs, n_terms = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    words = terms.select("term").distinct()
    counts = saved(postings.select("term", "n", "bytes").join(side(words, F.octet_length("term") + 16), "term").groupBy("term").agg(F.sum("n").alias("df"), F.sum("bytes").alias("bytes")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = saved(terms.join(counts.select("term", weight.alias("weight")), "term").where("weight > 0"))
    hits = postings.join(side(weighted, F.octet_length("term") + 16 * F.size("items") + 64), "term").select("segment", "part", "weight", "items", "times", "body")
    none = F.array().cast("array<bigint>")
    heads = docs.select("segment", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(-1).cast("long").alias("weight"), none.alias("items"), none.alias("times"), "body")
    n_parts = parts(counts, F.col("bytes"), groups)
    dealt = hits.unionByName(heads).repartition(n_parts, "segment", "part").sortWithinPartitions("segment", "part", "weight")
    found = dealt.mapInArrow(_search(k, n_docs, n_terms), "item_id bigint, score bigint, doc_id bigint")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
