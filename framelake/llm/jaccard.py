"""Operator 3: exact join of documents by the Jaccard similarity of their word n-grams.

A document's set holds its distinct ``k``-word shingles, as 64-bit hashes. Two sets
link when ``den * |A & B| >= num * |A | B|``. Equal sets are one set from the first step on,
named by a hash of it (``sid``). Steps:

1. Half of the hash space (``h < 2**63``) is checked for shingles that only one set
   has. A set with more such shingles than ``n - ceil(t * n)`` cannot link at all;
   most sets end here. The rest keep a prefix of ``n - ceil(t * n) + 1`` shingles
   in one global order (unshared first, then by frequency): linked sets have one in common.
2. Sets that meet at a prefix shingle and are of like size form candidate clusters,
   found by a star on the smallest sid of each (shingle, size class), never as pairs.
3. Inside a cluster an index from prefix shingle to posting blocks, ordered by place and size,
   is read with whole blocks skipped where the place or size rules a link out. A set is asked for
   answers at a similarity that is lower by 1/``NEAR``; sets that differ from it by no more than that are never
   looked up themselves: by the triangle inequality of the Jaccard distance their answers are among
   its own, and each overlap follows from its overlap by the shingles that only one of both has.
   Pairs of sets that are in one class already need no answer.
4. Clusters of more than ``BLOCK`` sets are dealt to blocks. Each block is joined by itself, then
   one set of each class that came out; then the sets outside of a cluster's largest class
   are compared with all its blocks. Near copies so are sent a few times, however many there are.

``jaccard_links`` counts all links in full, block against block: a set's overlaps with all others are
kept, and the most similar set that is left takes them over in the same way.

Set identity and links are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _text
from framelake.llm._exec import binary_rows, drop, join_unique, parts, run_starts, saved, small, text_bytes, whole_groups
from framelake.llm._shared import Pack, gather, meet, pack_answers
from framelake.llm.components import components

#: Sets, and their shingles, of one cluster that are compared in one task.
BLOCK, BLOCK_TOKENS = 512, 2_000_000
#: Sets whose distance is one part of so many, or less, share their answers.
NEAR = 20
HALF = np.uint64(1 << 63)


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row (lower-cased A-Z, words between ASCII white space)."""
    w = _text.Words(col, "space", lower=True)
    h = w.hashes()
    g, at = w.grams(h, k)
    out = []
    for i, n in enumerate(w.counts):
        if n >= k:
            s = np.sort(g[at[i] : at[i + 1]])
            out.append(s[run_starts([s])])
        else:
            out.append(np.array([w.whole(h, i)] if n else [], np.uint64))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shingles that a set of n has in common with any set it links to."""
    return -(-num * n // den)


def _sign(s: np.ndarray) -> tuple[int, int]:
    a = _text.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = _text.mix(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_SENT = "part int, keys binary, owners binary, counts binary, to int, ids binary, sizes binary, shared binary, doc_id bigint, text_hash bigint, n bigint, s1 bigint, s2 bigint, n_half bigint, tail binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_TYPES = [{"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}[x.split()[1]] for x in _SENT.split(", ")]
_TOLD = ", ".join(_SENT.split(", ")[4:])
_SETS = "doc_id bigint, text_hash bigint, n bigint, s1 bigint, s2 bigint, left int, shared binary, tail binary"


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    """Rows of some of the columns; the others are null."""
    cols = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(len(rows), t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _flush(pack: Pack) -> Iterator[pa.RecordBatch]:
    rows, known = pack.flush()
    if rows:
        yield _batch(rows, "part", "keys", "owners", "counts")
    if answers := pack_answers(known, pack.parts):
        yield _batch([(a[0], *a) for a in answers], "part", "to", "ids", "sizes", "shared")


def _send(k: int, num: int, den: int, n_parts: int):
    """A narrow row for each document; of each set that is new to the task its shingles, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = Pack(n_parts), set()
        for batch in batches:
            for part in _text.slices(batch, "text"):
                docs, sets, keys, owners = [], [], [], []
                for i, h, s in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), shingle_sets(part.column("text"), k), strict=True):
                    s1, s2 = _sign(s)
                    docs.append((i % n_parts, i % n_parts, i, h, len(s), s1, s2))
                    if len(s) and (s1, s2) not in seen:
                        seen.add((s1, s2))
                        half = s[: np.searchsorted(s, HALF)]
                        need = len(s) - least_overlap(len(s), num, den) + 1
                        sets.append((s1 % n_parts, s1 % n_parts, len(s), s1, s2, len(half), s[len(half) : need].tobytes()))
                        keys.append(half)
                        owners.append(np.full(len(half), s1))
                if len(seen) > 200_000:
                    seen.clear()
                yield _batch(docs, "part", "to", "doc_id", "text_hash", "n", "s1", "s2")
                if sets:
                    yield _batch(sets, "part", "to", "n", "s1", "s2", "n_half", "tail")
                    if pack.add(np.concatenate(keys), np.concatenate(owners)):
                        yield from _flush(pack)
        yield from _flush(pack)

    return run


def _tell(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            done = batch.column("to").is_valid()
            if (own := batch.filter(done)).num_rows:
                yield own.select(_NAMES[4:])
            rest = batch.filter(pc.invert(done))
            rows += zip(*(rest.column(c).to_pylist() for c in ("keys", "owners", "counts")), strict=True)
        if answers := pack_answers(meet(rows)[0], n_parts):
            yield _batch(answers, "to", "ids", "sizes", "shared").select(_NAMES[4:])

    return run


def _prefixes(num: int, den: int):
    """Documents as they came; one row for each set (without doc_id): if it can link at all, how long its prefix is
    without unshared shingles (``left``), its shared shingles of the lower half, and further ones in case these are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, sets = [], {}
        for b in batches:
            docs = b.filter(b.column("doc_id").is_valid())
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in ("doc_id", "text_hash", "n", "s1", "s2")), *(pa.nulls(docs.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary()))], [x.split()[0] for x in _SETS.split(", ")])
            rest = b.filter(pc.and_(b.column("doc_id").is_null(), b.column("ids").is_valid()))
            answers += zip(*(rest.column(c).to_pylist() for c in ("ids", "sizes", "shared")), strict=True)
            own = b.filter(b.column("n_half").is_valid())
            for n, s1, s2, nh, tail in zip(*(own.column(c).to_pylist() for c in ("n", "s1", "s2", "n_half", "tail")), strict=True):
                sets[s1, s2, n] = nh, tail
        ids, values, at = gather(answers)
        place = dict(zip(ids.tolist(), range(len(ids)), strict=True))
        rows, size = [], 0
        for (s1, s2, n), (nh, tail) in sets.items():
            j = place.get(s1)
            got = np.unique(values[at[j] : at[j + 1]]) if j is not None else values[:0]
            left = n - least_overlap(n, num, den) + 1 - (nh - len(got))
            if left > 0:
                rows.append((None, None, n, s1, s2, left, got.tobytes(), tail[: 8 * max(0, left - len(got))]))
                size += 8 * len(got) + len(tail)
            if len(rows) == 10_000 or size > 32 << 20:
                yield _set_rows(rows)
                rows, size = [], 0
        if rows:
            yield _set_rows(rows)

    return run


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _SETS.split(", ")])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle that a prefix may be made of."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            got = [np.frombuffer(x, np.int64) for c in ("shared", "tail") for x in b.column(c).to_pylist()]
            each = [len(x) for x in got]
            rep = lambda c, b=b, each=each: pa.array(np.repeat(np.tile(b.column(c).to_numpy(), 2), each))
            last = np.repeat(np.arange(2) == 1, b.num_rows)
            yield pa.RecordBatch.from_arrays([rep("sid"), rep("n"), rep("left"), pa.array(np.repeat(last, each)), pa.array(np.concatenate(got))], ["sid", "n", "left", "last", "token"])


def _postings(lone: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, size, sid) of all prefixes, each under two size classes: sets that link have one in common.

    A prefix takes the rarest shingles first, by the power of two of their frequency among
    the sets that are left; equal ones by hash.
    """
    tokens = lone.mapInArrow(_tokens, "sid bigint, n bigint, left int, last boolean, token bigint")
    common = tokens.where("not last").groupBy("token").agg(F.count("*").alias("df")).where("df > 2").select("token", F.floor(F.log2("df")).cast("int").alias("often"))
    rank = F.when(F.col("last"), 99).otherwise(F.coalesce("often", F.lit(0)))
    ordered = tokens.join(small(saved(common)), "token", "left").groupBy("sid", "n", "left").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "token"))).alias("t"))
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")
    prefix = ordered.select("sid", size.alias("size"), F.explode(F.slice("t", 1, F.col("left"))).alias("t"))
    return prefix.select(F.col("t.token").alias("token"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), "sid")


def _members(k: int):
    """The sets of candidates, each once a task, however many rows repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in _text.slices(batch, "text"):
                rows, size = [], 0
                for s, sid, *other in zip(shingle_sets(part.column("text"), k), *(part.column(x).to_pylist() for x in ("sid", "cluster", "blocks", "own")), strict=True):
                    if sid in seen:
                        continue
                    seen.add(sid)
                    rows.append((sid, *other, s.tobytes()))
                    size += s.nbytes
                    if size > 8 << 20:
                        yield _member_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _member_rows(rows)
                if len(seen) > 200_000:
                    seen.clear()

    return run


_MEMBERS = "sid bigint, cluster bigint, blocks int, own int, tokens binary"


def _member_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _MEMBERS.split(", ")])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def local_ranks(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as sorted ranks in the order of frequency among these sets, and how many ranks only one set has (the lowest)."""
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    ranks = rank[which]
    return [np.sort(ranks[a:b]) for a, b in zip(at, at[1:], strict=False)], int((count == 1).sum())


class Index:
    """Postings of prefix shingles in blocks of ``width`` places; each block has its sets by size.

    Shingles that only one set has come before all others and are left out, so places count from behind them.
    """

    def __init__(self, sets: list[np.ndarray], lone: int, which: list[int], num: int, den: int, width: int = 8) -> None:
        self.sets, self.lone, self.num, self.den, self.width = sets, lone, num, den, width
        entries: dict[int, dict[int, tuple[list[int], list[int]]]] = defaultdict(dict)
        for x in sorted(which, key=lambda x: len(sets[x])):
            for j, t in self.prefix(x):
                sizes, there = entries[t].setdefault(j // width, ([], []))
                sizes.append(len(sets[x]))
                there.append(x)
        self.entries = entries

    def prefix(self, y: int) -> Iterator[tuple[int, int]]:
        """Place and rank of its shingles that linked sets have to share one of."""
        r = self.sets[y]
        first = int(np.searchsorted(r, self.lone))
        return enumerate(r[first : len(r) - least_overlap(len(r), self.num, self.den) + 1].tolist(), first)

    def hits(self, y: int) -> dict[int, int]:
        """Sets that may link to ``y``, and how many prefix shingles they share."""
        n = len(self.sets[y])
        smallest = least_overlap(n, self.num, self.den)
        out: dict[int, int] = {}
        for j, t in self.prefix(y):
            for block, (sizes, there) in self.entries.get(t, {}).items():
                # From its first common shingle on, a pair shares n - max(places) at most; that bounds the partner's size.
                largest = (n - max(j, block * self.width)) * (self.num + self.den) // self.num - n
                if largest < sizes[0] or sizes[-1] < smallest:
                    continue
                for x in there[bisect_left(sizes, smallest) : bisect_right(sizes, largest)]:
                    out[x] = out.get(x, 0) + 1
        return out


def link_classes(ids: list[int], sets: list[np.ndarray], num: int, den: int, classes: list[int] | None = None, asks: list[bool] | None = None) -> tuple[list[int], int]:
    """The smallest id of each set's class, and how many sets were looked up in the index.

    ``classes`` are those known before. With ``asks`` only pairs of a set that asks and one that does not are compared.
    """
    n = len(ids)
    ranks, lone = local_ranks(sets)
    # Answers at the lower similarity are those of all near sets as well.
    shares = 2 * den < NEAR * num <= (NEAR - 1) * den  # else near sets might not link
    lower = (NEAR * num - den, NEAR * den) if shares else (num, den)
    index = Index(ranks, lone, [x for x in range(n) if not (asks and asks[x])], *lower)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(classes or []):
        root[find(i)] = find(first.setdefault(c, i))
    at_least = lambda o, a, b, num, den: den * o >= num * (a + b - o)
    done, probes = [False] * n, 0
    order = sorted((x for x in range(n) if asks is None or asks[x]), key=lambda i: (len(sets[i]), ids[i]))
    for y in order:
        if done[y]:
            continue
        done[y] = True
        probes += 1
        ry = ranks[y]
        hits = index.hits(y)
        answers: list[tuple[int, int]] = []
        for x in sorted(hits, key=lambda x: (-hits[x], x)):
            if find(x) == find(y):
                continue  # in one class already, whether this pair links or not
            o = common(ranks[x], ry)
            if at_least(o, len(ry), len(ranks[x]), num, den):
                root[find(y)] = find(x)
            elif at_least(o, len(ry), len(ranks[x]), *lower):
                answers.append((x, o))
        if not shares:
            continue
        if asks is None:
            most = max(hits.values(), default=0)
            near = [z for z in hits if not done[z] and NEAR * hits[z] >= (NEAR - 4) * most]
        else:
            near = [z for z in order if not done[z] and find(z) == find(y)]
        for z in near:
            rz = ranks[z]
            if not at_least(common(rz, ry), len(rz), len(ry), NEAR - 1, NEAR):
                continue
            done[z] = True
            root[find(z)] = find(y)
            gone, new = np.setdiff1d(ry, rz, True), np.setdiff1d(rz, ry, True)
            for x, o in answers:
                if find(x) != find(z) and at_least(o - common(gone, ranks[x]) + common(new, ranks[x]), len(rz), len(ranks[x]), num, den):
                    root[find(z)] = find(x)
    low: dict[int, int] = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(n)], probes


def _verify(num: int, den: int):
    """Links (set, smallest set of its class) of each group of (cluster, a, b); a row's ``label`` is its class so far, ``asks`` tells two sides apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cluster", "a", "b"]):
            cuts = np.append(run_starts([t.column(c).to_numpy() for c in ("cluster", "a", "b")]), t.num_rows)
            ids, label, asks = (t.column(c).to_pylist() for c in ("sid", "label", "asks"))
            sets = binary_rows(t.column("tokens"), np.uint64)
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = list({(ids[i], asks[i]): i for i in range(a, b)}.values())
                sides = None if asks[a] is None else [asks[i] for i in at]
                if sides is not None and (all(sides) or not any(sides)):
                    continue
                own = [ids[i] for i in at]
                found, _ = link_classes(own, [sets[i] for i in at], num, den, [label[i] for i in at], sides)
                out += [(i, m) for i, m in zip(own, found, strict=True) if i != m]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _joined(held: DataFrame, n_parts: int, num: int, den: int) -> DataFrame:
    """Links (a, b) inside each group of (cluster, a, b) of rows (cluster, a, b, sid, label, asks, tokens)."""
    return held.repartition(n_parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(_verify(num, den), "a bigint, b bigint")


def _cluster_links(where: DataFrame, members: Callable[[DataFrame], DataFrame], n_parts: int, num: int, den: int) -> DataFrame:
    """Links that give the classes of all clusters; ``where`` says which set is in which cluster, ``members`` gives such sets (_MEMBERS)."""
    none, zero = F.lit(None).cast("boolean"), F.lit(0)
    alone = members(where).select("cluster", F.col("own").alias("a"), zero.alias("b"), "sid", F.col("sid").alias("label"), none.alias("asks"), "tokens")
    links = saved(_joined(alone, n_parts, num, den))
    large = where.where("blocks > 1")
    if not large.limit(1).count():
        return links
    large = saved(members(large).dropDuplicates(["sid"]))

    def labelled(links: DataFrame) -> DataFrame:
        c = components(links)
        return large.join(c.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("label", F.coalesce("component", "sid")).drop("component")

    # One set of each class of each block. Classes of two blocks meet here if these two sets link; if they do not, below.
    first = labelled(links).where("sid = label")
    many = first.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    first = first.join(small(saved(many)), "cluster").select("cluster", F.pmod(F.xxhash64("sid", F.lit(1)), "many").cast("int").alias("a"), zero.alias("b"), "sid", "label", none.alias("asks"), "tokens")
    links = saved(links.unionByName(_joined(first, n_parts, num, den)))
    # What is not in a cluster's largest class against all blocks.
    now = saved(labelled(links))
    counts = now.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    rest = largest.withColumn("asking", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).where("asking > 0").select("cluster", "largest", "asking")
    both = now.join(small(saved(rest)), "cluster")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = both.select("cluster", F.col("own").alias("a"), all_of("asking").alias("b"), "sid", "label", F.lit(False).alias("asks"), "tokens")
    askers = both.where("label <> largest").select("cluster", all_of("blocks").alias("a"), F.pmod(F.xxhash64("sid", F.lit(2)), "asking").cast("int").alias("b"), "sid", "label", F.lit(True).alias("asks"), "tokens")
    return links.unionByName(_joined(told.unionByName(askers), n_parts, num, den))


def link_counts(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, cross: bool, num: int, den: int) -> np.ndarray:
    """The copies of all sets that each set links to; only those of the other block if cross.

    ``overlap`` holds what one set has in common with every set. The most similar set that is left
    takes it over and changes it by the postings of the shingles that only one of both has.
    """
    size = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    codes = [which[a:b] for a, b in zip(at, at[1:], strict=False)]
    order = np.argsort(which, kind="stable")
    holders, edge = np.repeat(np.arange(len(sets)), size)[order], np.searchsorted(which[order], np.arange(int(which.max()) + 2))

    def held(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        return np.bincount(np.concatenate([holders[:0], *(holders[edge[t] : edge[t + 1]] for t in tokens.tolist())]), minlength=len(sets))

    counts, left = np.zeros(len(sets), np.int64), np.ones(len(sets), bool)
    last, overlap = -1, np.zeros(len(sets), np.int64)
    for _ in sets:
        near = np.where(left & (overlap > 0), overlap, 0)
        y = int(near.argmax()) if near.any() else int(left.argmax())
        gone, new = (np.setdiff1d(codes[last], codes[y], True), np.setdiff1d(codes[y], codes[last], True)) if last >= 0 else (codes[y][:0], codes[y])
        overlap = overlap - held(gone) + held(new) if len(gone) + len(new) < size[y] else held(codes[y])
        links = den * overlap >= num * (size + size[y] - overlap)
        links[y] = False
        if cross:
            links &= own != own[y]
        counts[y] = copies[links].sum()
        left[y] = False
        last = y
    return counts


def _count(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cluster", "a", "b"]):
            cuts = np.append(run_starts([t.column(c).to_numpy() for c in ("cluster", "a", "b")]), t.num_rows)
            ids, copies, own, one, two = (t.column(c).to_numpy() for c in ("sid", "copies", "own", "a", "b"))
            sets = binary_rows(t.column("tokens"), np.uint64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = np.array(list({int(ids[i]): i for i in range(a, b)}.values()))
                n = link_counts([sets[i] for i in at], copies[at], own[at], one[a] != two[a], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(n)], ["sid", "others"])

    return run


def _candidates(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Callable[[DataFrame], DataFrame], int]:
    """Steps 1 and 2: rows (doc_id, text_hash, n, s1, s2) of all documents with an id, sizes of those without, sets with how many
    documents have them, which candidate set is in which cluster, a function for such sets themselves (_MEMBERS), partitions."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    some = docs.where("doc_id is not null")
    n_parts = parts(docs, text_bytes("text"), 1.5)
    to = lambda c: F.expr(f"pmod({c}, {n_parts})")
    told = some.mapInArrow(_send(k, num, den, n_parts), _SENT).repartitionById(n_parts, to("part")).mapInArrow(_tell(n_parts), _TOLD)
    every = saved(told.repartitionById(n_parts, to("to")).mapInArrow(_prefixes(num, den), _SETS))
    own, sets = every.where("doc_id is not null").select("doc_id", "text_hash", "n", "s1", "s2"), every.where("doc_id is null")

    lone = sets.select(F.col("s1").alias("sid"), "n", "left", "shared", "tail")
    post = saved(_postings(lone, num, den))
    stars = post.groupBy("token", "size").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").drop("high")
    clusters = saved(components(post.join(stars, ["token", "size"]).where("sid > low").select(F.col("sid").alias("a"), F.col("low").alias("b"))))
    drop(post)
    reps = own.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"))
    found = clusters.select(F.col("node").alias("sid"), F.col("component").alias("cluster")).join(sets.select(F.col("s1").alias("sid"), "s2", "n"), "sid")
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    dealt = join_unique(found, saved(found.groupBy("cluster").agg(many.alias("blocks"), F.count("*").alias("rows"))), ["cluster"], "rows")
    where = dealt.withColumn("own", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).join(reps.withColumnRenamed("s1", "sid"), ["sid", "s2", "n"])
    where = saved(where.select("sid", "cluster", "blocks", "own", "first.doc_id", "first.text_hash"))

    def members(rows: DataFrame) -> DataFrame:
        return some.join(small(rows), ["doc_id", "text_hash"]).select("sid", "cluster", "blocks", "own", "text").mapInArrow(_members(k), _MEMBERS)

    nameless = docs.where("doc_id is null").mapInArrow(_sizes(k), "doc_id bigint, n_shingles bigint")
    return own, nameless, reps, where, members, n_parts


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, component_id) of all documents with an id, and sizes of those without."""
    own, nameless, reps, where, members, n_parts = _candidates(docs, k, num, den)
    class_of = components(_cluster_links(where, members, n_parts, num, den)).select(F.col("node").alias("s1"), "component")
    reps = saved(reps.select("s1", "s2", "n", "first.doc_id", "copies").join(class_of, "s1", "left"))
    low = reps.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    linked = join_unique(reps.where("component is not null"), saved(low), ["component"], "rows").select("s1", "s2", "n", F.col("low").alias("component_id"), "copies")
    copied = reps.where("component is null and copies > 1").select("s1", "s2", "n", F.col("doc_id").alias("component_id"), "copies")
    out = join_unique(own, saved(linked.unionByName(copied)), ["s1", "s2", "n"], "copies")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), nameless


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the own one included.
    Null, empty or wordless texts have an empty set and link with nothing; rows with a
    null doc_id come back with a null component_id and link with nothing. Rows that repeat
    a doc_id are each judged by their own text: with one text they come out alike, with
    different ones each has its own size and class. Other columns are ignored.
    """
    out, nameless = _classes(docs, k, num, den)
    return out.drop("text_hash").unionByName(nameless.withColumn("component_id", F.lit(None).cast("long")))


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, n_links), one for each row of ``docs``, as in jaccard_classes().

    n_links is the number of other rows that the row itself links to, equal ones
    included; those that it reaches only through others are not counted. It is 0 for empty sets and null ids.
    """
    own, nameless, reps, where, members, n_parts = _candidates(docs, k, num, den)
    members = saved(members(where)).join(reps.select(F.col("s1").alias("sid"), "copies"), "sid")
    pair = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("a", F.least("own", "j")).withColumn("b", F.greatest("own", "j"))
    counts = pair.repartition(n_parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(_count(num, den), "sid bigint, others bigint").groupBy("sid").agg(F.sum("others").alias("others"))
    linked = reps.join(counts, reps.s1 == counts.sid, "left").select("s1", "s2", "n", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "copies")
    out = join_unique(own, saved(linked.where("n_links > 0")), ["s1", "s2", "n"], "copies").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.unionByName(nameless.withColumn("n_links", F.lit(0).cast("long")))


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                n = [len(s) for s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_shingles"])

    return run


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each class; all columns and rows with a null id stay.

    Of rows that repeat a doc_id each goes or stays by the class of its own text; those of the smallest
    doc_id of a class are one document and stay.
    """
    gone = _classes(docs, k, num, den)[0].where("component_id < doc_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = small(saved(gone))
    same = (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"])
    return docs.join(gone, same, "left_anti")
