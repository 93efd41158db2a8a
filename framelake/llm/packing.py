"""Operator 6: best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Items of equal length are alike, so the packing is worked out on the histogram of piece
lengths: at most ``capacity`` numbers, however many documents there are. Sets of items that
provably dominate every other set with the same largest item are fixed for good, many bins
at a time; what is left is packed best-fit decreasing. The plan is a short list of
(length, first rank, how many, first sequence, offset); each piece finds its place by its
rank among the pieces of its length, counted shard by shard so that a common length does
not end in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.llm import _text
from framelake.llm._exec import parts, saved

#: Chunks whose ids a worker remembers.
CACHE = 200_000


class ByteBpe:
    """Ids of texts, as little-endian uint32 bytes, equal to those of the tokenizers library.

    Texts are cut at single spaces: there the byte-level pattern always begins a new word,
    except where a space and more white space follow each other; such texts are encoded whole.
    Chunks that are new to the worker are encoded together, joined by spaces, and told apart
    by the byte lengths of their tokens.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        byte = {chr(b) if b in printable else chr(next(rest)): b for b in range(256)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        # The pattern of the vocabulary file, its white space spelled out.
        s = r"\p{White_Space}"
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|{s}+(?!\P{{White_Space}})|{s}+"
        bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = bpe._core_bpe.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self._gap = re.compile(r" \s").search
        self._tags = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Ids of " " + chunk; no chunk is empty or begins with white space."""
        if not chunks:
            return
        new = list(chunks)
        text = " " + " ".join(new)
        ids = np.array(self._encode(text), "<u4")
        data = np.frombuffer(text.encode(), np.uint8)
        total = np.cumsum(self.size[ids])
        end = np.cumsum(np.array([len(c.encode()) + 1 for c in new]))
        at = [0, *(np.searchsorted(total, end) + 1).tolist()]
        assert len(data) == end[-1] == total[-1] and (total[np.array(at[1:]) - 1] == end).all()
        flat = ids.tobytes()
        self.known.update(zip(new, [flat[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        plan: list[list] = []
        new: set[str] = set()
        for text in texts:
            parts = [text] if self._tags is None or not any(x in text for x in self.special) else self._tags(text)
            plan.append(own := [])
            for x in parts:
                if x in self.special:
                    own.append(np.array([self.special[x]], "<u4").tobytes())
                elif x and (self._gap(x) or x[0].isspace() or x[-1] == " "):
                    own.append(self.whole(x))
                elif x:
                    first, *rest = x.split(" ")
                    own += (self.whole(first), rest)
                    new.update(rest)
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in own]) for own in plan]

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            for part in _text.slices(batch, "text", 1 << 20):
                rows = []
                for i, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(_text.strings(part.column("text")).to_pylist()), strict=True):
                    ids += stop
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), *[ids[4 * a : 4 * b]] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)], names)

    return run


class _Lengths:
    """How many items of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {w: c for w, c in counts.items() if c}
        self.order = sorted(self.n)

    def take(self, w: int, c: int) -> None:
        self.n[w] -= c
        if not self.n[w]:
            del self.n[w]
            self.order.pop(bisect_left(self.order, w))

    def smallest(self, k: int, but: int) -> list[int]:
        """The k smallest lengths, one item of length ``but`` left out."""
        out: list[int] = []
        for w in self.order:
            out += [w] * min(k, self.n[w] - (w == but))
            if len(out) >= k:
                break
        return out[:k]

    def largest_pair(self, room: int, but: int) -> int:
        """The largest sum of two items that fits in ``room``, one item of length ``but`` left out; 0 if none does."""
        best, lo, hi = 0, 0, bisect_right(self.order, room) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room or self.n[b] == (b == but):
                hi -= 1
            elif lo == hi and self.n[a] - (a == but) < 2:
                break
            else:
                if self.n[a] > (a == but):
                    best = max(best, a + b)
                lo += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Bins (lengths, how many such bins) that some best packing has, and what is left to pack.

    For an item w let k be the longest item that fits beside it. {w} alone is best if nothing
    fits; {w, k} dominates every other set with w if it fills the bin, if no two items fit
    beside w, or if no three do and k is no shorter than any pair that fits.
    """
    left, fixed = _Lengths(counts), []
    for w in sorted(counts, reverse=True):
        while w in left.n:
            room = capacity - w
            small = left.smallest(3, w)
            if not small or small[0] > room:
                fixed.append(([w], left.n[w]))
                left.take(w, left.n[w])
                break
            k = left.order[bisect_right(left.order, room) - 1]
            if k == w and left.n[w] < 2:
                k = left.order[bisect_right(left.order, room) - 2]
            pair = len(small) > 1 and small[0] + small[1] <= room
            triple = len(small) > 2 and sum(small) <= room
            if w + k != capacity and pair and (triple or left.largest_pair(room, w) > k):
                break
            m = left.n[w] // 2 if k == w else min(left.n[w], left.n[k])
            if w + k != capacity and pair:
                m = 1  # the pairs that fit may be others next time
            fixed.append(([w, k], m))
            left.take(w, m)
            left.take(k, m)
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: bins of like contents are filled together."""
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(items: list[int], n: int, room: int) -> None:
        if not room:
            done.append((items, n))
        elif n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((items, n))

    for w in sorted(counts, reverse=True):
        c = counts[w]
        while c:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put([w] * each, c // each, capacity - each * w)
                if c % each:
                    put([w] * (c % each), 1, capacity - (c % each) * w)
                break
            room = rooms[at]
            items, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            used = min(n, c)
            put(items, n - used, room)
            put([*items, w], used, room - w)
            c -= used
    return done + [x for xs in open_bins.values() for x in xs]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ordered by first rank."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    rank = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int]]] = {w: [] for w in counts}
    sequence = 0
    for items, n in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for w in items:
            rows[w].append((rank[w], sequence, offset))
            rank[w] += n
            offset += w
        sequence += n
    return {w: np.array(r, np.int64) for w, r in rows.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                rows = where[int(w)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                seq[at], off[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            keep = [c for c in b.schema.names if c not in ("rank", "shard", "base")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    A document is its ids and then ``end``. Only longer ones than ``capacity`` are cut, into
    pieces of that length, of which the first may be shorter. Null and empty texts are the
    one id ``end``. Every row is packed, repeated rows and null doc_ids too; other columns
    are ignored. ``with_ids`` adds the ids themselves (little-endian uint32).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    pieces = saved(docs.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), cols))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    shards = parts(pieces)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    sums = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    base = sums.select("length", "shard", (F.sum("n").over(W.partitionBy("length").orderBy("shard")) - F.col("n")).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(base, ["length", "shard"]).withColumn("rank", F.col("own").cast("long") + F.col("base")).drop("own")
    return ranked.select(*(x.split()[0] for x in cols.split(", ")), "rank").mapInArrow(_place(plan(counts, capacity)), f"{cols}, sequence_id bigint, offset bigint")
