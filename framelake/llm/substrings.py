"""Operator 5: removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

A window is ``window`` consecutive words. Its anchor is the smallest hash of the
``ANCHOR``-word grams inside it, so equal windows have equal anchors wherever they stand. A
document falls into segments, runs of windows with one anchor; the segments that share an
anchor make up one reference block, and what a document can have in common with others by
windows lies in the blocks of its own anchors. So a document is parsed against each block that can
hold a factor of it, and against no other.

1. Anchors that only one document has end here: one shuffle of packed blobs (_shared).
2. Each block is indexed by a suffix array of its segments (``parse``). Every segment is
   factored greedily: from a window that a document of smaller doc_id has as well, the factor
   is the longest match in such a document, one place of it being the reference. The next factor
   begins at the first window across the factor's boundary that has a reference again, so
   passages that run on from one reference to another lose nothing.
3. Factors cover ``window`` words at least and are the duplicate spans; a document's factors from all
   blocks are put together and their words removed.

A map task first parses its documents against each other, and only windows without a factor
go on, so a passage in very many documents sends its own windows once a flush. The windows
around it, different in every document, still share its anchors: windows at hot anchors (a
bounded list, see ``HOT``) are segments of their own, dealt by their own hash and not by the anchor.
The texts are read once for the anchors and shuffled once; the later passes read the same exchange. Windows are compared
by 64-bit hash, inside a block only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import _text
from framelake.llm._exec import binary_rows, parts, run_starts, saved, split_blob, text_bytes
from framelake.llm._shared import HOT_FLUSHES, Pack, gather, meet, pack_answers

ANCHOR = 5
#: Windows that a map task holds before it parses them against each other and passes them on.
FLUSH = 1_000_000
#: At most so many anchors are treated as hot (8 MB); if more qualify, the threshold is doubled until they fit.
HOT = 1_000_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : len(x) - size + 1]) if size < w else m


def windows(col: pa.Array, window: int) -> tuple[_text.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hash and anchor of each window, and window offsets by row."""
    w = _text.Words(col, "space")
    h = w.hashes()
    whole, first = w.grams(h, window)
    k = min(ANCHOR, window)
    grams, at = w.grams(h, k)
    if not len(whole):
        return w, whole, whole, first
    low = sliding_min(grams, window - k + 1)
    # windows of row i are the first of its grams: drop those that run on into the next row
    each = np.diff(first)
    place = np.repeat(at[:-1] - first[:-1], each) + np.arange(first[-1])
    return w, whole, low[place], first


def ranks(x: np.ndarray) -> np.ndarray:
    """1, 2, ... for the different values in order."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none; by pointer jumping."""
    x = np.concatenate(([np.iinfo(np.int64).min], x))
    at = np.maximum(np.arange(len(x)) - 1, 0)
    left = np.arange(1, len(x))
    while len(left := left[x[at[left]] >= x[left]]):
        at[left] = at[at[left]]
    return at[1:] - 1


def parse(key: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all segments: start, length (in windows), and the place of the reference.

    ``key`` has the windows of all segments, ``first`` the offsets of the segments and ``doc`` their
    documents. References lie in documents of smaller number; among the longest matches that
    which is next in the suffix array is taken.
    """
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none
    size = np.diff(first)
    owner = np.repeat(doc, size)
    order = np.argsort(key, kind="stable")
    at = run_starts([key[order]])
    each = np.diff(np.append(at, len(key)))
    low, high = np.minimum.reduceat(owner[order], at), np.maximum.reduceat(owner[order], at)
    later, live = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = owner[order] > np.repeat(low, each)
    live[order] = np.repeat(low < high, each)
    if not later.any():
        return none, none, none
    # Only windows that two documents have can be part of a match; the others end the suffixes before them.
    left = np.zeros(len(key), np.int64)  # live windows from here on in the segment
    end = np.repeat(first[1:], size)
    dead = np.flatnonzero(~live)
    if len(dead):
        stop = np.searchsorted(dead, np.arange(len(key)))
        end = np.minimum(end, np.where(stop < len(dead), dead[np.minimum(stop, len(dead) - 1)], len(key)))
    left = np.maximum(end - np.arange(len(key)), 0)
    level = np.zeros(len(key), np.int64)
    level[order] = np.repeat(np.arange(1, len(at) + 1), each)
    level[~live] = 0
    levels, step = [level], 1
    while step < left.max():
        after = np.zeros(len(key), np.int64)
        more = np.flatnonzero(left > step)
        after[more] = level[more + step]
        some = np.flatnonzero(live)
        new = np.zeros(len(key), np.int64)
        new[some] = ranks(level[some] * (len(key) + 1) + after[some])
        levels.append(level := new)
        step *= 2
    suffixes = np.flatnonzero(live)
    suffixes = suffixes[np.argsort(level[suffixes], kind="stable")]
    length, source = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for turn in (1, -1):
        own = suffixes[::turn]
        near = nearest_smaller(owner[own])
        some = np.flatnonzero((near >= 0) & later[own])
        p, q = own[some], own[near[some]]
        same = np.zeros(len(p), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            fits = np.flatnonzero((left[p] >= same + (1 << k)) & (left[q] >= same + (1 << k)))
            same[fits] += (levels[k][p[fits] + same[fits]] == levels[k][q[fits] + same[fits]]).astype(np.int64) << k
        longer = same > length[p]
        length[p[longer]], source[p[longer]] = same[longer], q[longer]
    # The next window with a reference, in the same segment.
    place = np.where(later, np.arange(len(key)), len(key))
    following = np.append(np.minimum.accumulate(place[::-1])[::-1], len(key))
    out, now, stop = [], first[:-1], first[1:]
    while True:
        now = following[now]
        inside = now < stop
        now, stop = now[inside], stop[inside]
        if not len(now):
            break
        out.append(now)
        now = now + length[now]
    start = np.sort(np.concatenate(out))
    return start, length[start], source[start]


_ASK = "part int, keys binary, owners binary, counts binary, to int, ids binary, sizes binary, values binary"
_ANSWER = "to int, ids binary, sizes binary, values binary"
_TYPE = {"int": pa.int32(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple], *names: str) -> pa.RecordBatch:
    """Rows of some columns of a schema; the others are null."""
    cols = dict(zip(names, zip(*rows, strict=True), strict=True))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], _TYPE[t]) if c in cols else pa.nulls(len(rows), _TYPE[t]) for c, t in fields], [c for c, _ in fields])


def _answers(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None, n_parts: int, schema: str) -> Iterator[pa.RecordBatch]:
    if rows := pack_answers(found, n_parts):
        if schema == _ANSWER:
            yield _batch(schema, rows, "to", "ids", "sizes", "values")
        else:
            yield _batch(schema, [(r[0], *r) for r in rows], "part", "to", "ids", "sizes", "values")


def _split(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[pa.RecordBatch, list[tuple]]:
    """What is an answer already, and the rest."""
    done = batch.column("to").is_valid()
    rest = batch.filter(pc.invert(done))
    return batch.filter(done).select(["to", "ids", "sizes", "values"]), list(zip(*(rest.column(c).to_pylist() for c in names), strict=True))


def _anchors(window: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack(n_parts)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, known = pack.flush()
            if rows:
                yield _batch(_ASK, rows, "part", "keys", "owners", "counts")
            yield from _answers(known, n_parts, _ASK)

        for batch in batches:
            for part in _text.slices(batch, "body"):
                _, _, anchor, first = windows(part.column("body"), window)
                if not len(anchor):
                    continue
                owner = np.repeat(part.column("id").to_numpy(), np.diff(first))
                at = run_starts([anchor, owner])
                if pack.add(anchor[at], owner[at]):
                    yield from flush()
        yield from flush()

    return run


def _tell(n_parts: int):
    """Shared anchors by document; the hot ones and their weights in rows to no partition (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            own, rest = _split(batch, ("keys", "owners", "counts"))
            if own.num_rows:
                yield own
            rows += rest
        shared, hot, weight = meet(rows)
        yield from _answers(shared, n_parts, _ANSWER)
        if len(hot):
            yield _batch(_ANSWER, [(-1, hot.tobytes(), weight.astype(np.int64).tobytes())], "to", "ids", "sizes")

    return run


def _hot_anchors(told: DataFrame) -> np.ndarray:
    """The hottest anchors of all, HOT at most."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(64, np.int64)
        for b in batches:
            for w in binary_rows(b.column("sizes"), np.int64):
                n += np.bincount(np.log2(w).astype(np.int64), minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(n)], ["bits", "n"])

    rows = told.where("to = -1").select("ids", "sizes")
    by = dict(rows.select("sizes").mapInArrow(histogram, "bits bigint, n bigint").groupBy("bits").agg(F.sum("n")).collect())
    n = np.array([by.get(i, 0) for i in range(64)])
    if not n.sum():
        return np.zeros(0, np.uint64)
    bits = next(i for i in range(65) if n[i:].sum() <= HOT)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, w in zip(binary_rows(b.column("ids"), np.uint64), binary_rows(b.column("sizes"), np.int64), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k[w >= 1 << bits].tobytes()], pa.binary())], ["keys"])

    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.keys, np.uint64) for r in rows.mapInArrow(above, "keys binary").collect())]))


def _gather(width: int):
    """All that was found for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, at = gather([r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "values")), strict=True)], width)
        a = 0
        while a < len(ids):
            b = min(len(ids), a + 10_000, max(a + 1, int(np.searchsorted(at, at[a] + (1 << 21), "right")) - 1))  # 48 MB, or one document
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), split_blob(values[at[a] : at[b]], at[a : b + 1] - at[a])], ["id", "found"])
            a = b

    return run


def _by_document(doc: np.ndarray, row: np.ndarray, place: np.ndarray, length: np.ndarray, source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Factors by document: (row, start * 2**32 + length in words, document of the reference)."""
    if not len(doc):
        return None
    by = np.argsort(doc, kind="stable")
    at = run_starts([doc[by]])
    values = np.stack([row.view(np.uint64), (place << 32 | (length + window - 1)).astype(np.uint64), source.view(np.uint64)], axis=1)
    return doc[by][at], values[by], np.append(at, len(by))


_SENT = "part int, keys binary, docs binary, rows binary, places binary, counts binary, to int, ids binary, sizes binary, values binary"


def segments(key: np.ndarray, anchor: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Offsets of runs of consecutive windows at one anchor of one document; windows that stand ``alone`` are runs of their own."""
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | alone[1:]
    return np.flatnonzero(new)


def _index(window: int, n_parts: int, hot: np.ndarray):
    """Sends segments at shared anchors to their blocks; first parses the task's documents against each other."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, anchor, doc, row, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        alone = np.zeros(len(key), bool)
        if len(hot):
            alone = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        first = segments(key, anchor, doc, row, place, alone)
        start, length, source = parse(key, doc[first[:-1]], first)
        yield from _answers(_by_document(doc[start], row[start], place[start], length, doc[source], window), n_parts, _SENT)
        edge = np.zeros(len(key) + 1, np.int64)
        edge[start] += 1
        np.add.at(edge, start + length, -1)
        rest = np.cumsum(edge[:-1]) == 0
        key, anchor, doc, row, place, alone = (x[rest] for x in (key, anchor, doc, row, place, alone))
        first = segments(key, anchor, doc, row, place, alone)
        at = first[:-1]
        part = ((np.where(alone[at], key[at], anchor[at]) >> np.uint64(24)) % np.uint64(n_parts)).astype(np.int64)
        size, by = np.diff(first), np.argsort(part, kind="stable")
        # the windows in the order of the segments' partitions
        end = np.cumsum(size[by])
        take = np.repeat(at[by] - (end - size[by]), size[by]) + np.arange(len(key))
        key, doc, row, place, size, part = key[take], doc[at][by], row[at][by], place[at][by], size[by], part[by]
        cuts = np.append(run_starts([part]), len(part))
        first = np.concatenate(([0], end))
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = slice(a, b)
            rows.append((int(part[a]), key[first[a] : first[b]].tobytes(), doc[x].tobytes(), row[x].tobytes(), place[x].astype(np.uint32).tobytes(), size[x].astype(np.uint32).tobytes()))
        if rows:
            yield _batch(_SENT, rows, "part", "keys", "docs", "rows", "places", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in _text.slices(batch, "body"):
                _, whole, anchor, first = windows(part.column("body"), window)
                ids, rows = part.column("id").to_numpy(), part.column("row").to_numpy()
                for i, known in enumerate(binary_rows(part.column("found"), np.uint64)):
                    a, b = first[i], first[i + 1]
                    if a == b or not len(known):
                        continue
                    near = np.minimum(np.searchsorted(known, anchor[a:b]), len(known) - 1)
                    at = np.flatnonzero(known[near] == anchor[a:b])
                    held.append((whole[a:b][at], anchor[a:b][at], np.full(len(at), ids[i]), np.full(len(at), rows[i]), at))
                    n += len(at)
                if n >= FLUSH:
                    n = 0
                    yield from flush(held)
        yield from flush(held)

    return run


def _factor(window: int, n_parts: int):
    """Parses all segments of the partition's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            own, rest = _split(batch, ("keys", "docs", "rows", "places", "counts"))
            if own.num_rows:
                yield own
            rows += rest
        if not rows:
            return
        key, doc, row, place, size = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.uint64, np.int64, np.int64, np.uint32, np.uint32)))
        rows.clear()
        first = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        start, length, source = parse(key, doc, first)
        own, ref = np.searchsorted(first, start, "right") - 1, np.searchsorted(first, source, "right") - 1
        yield from _answers(_by_document(doc[own], row[own], place[own].astype(np.int64) + start - first[own], length, doc[ref], window), n_parts, _ANSWER)

    return run


def removed(words: _text.Words, found: list[np.ndarray]) -> np.ndarray:
    """Which words spans (start * 2**32 + length) cover."""
    edge = np.zeros(len(words.start) + 1, np.int32)
    for i, spans in enumerate(found):
        if len(spans):
            s = (spans >> np.uint64(32)).astype(np.int64) + words.first[i]
            np.add.at(edge, s, 1)
            np.add.at(edge, s + (spans & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_text(words: _text.Words, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space."""
    data, keep = words.data.copy(), ~gone
    row = np.repeat(np.arange(len(words.first) - 1), words.counts)[keep]
    start, end = words.start[keep], words.end[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    inner = end[:-1][row[1:] == row[:-1]] if len(row) else end
    mask[inner] = True
    data[inner] = 0x20
    out = data[mask]
    at = np.concatenate(([0], np.cumsum(mask)))[words.at].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))])


def _own(part: pa.RecordBatch) -> list[np.ndarray]:
    """The factors of each row: those of its document that were found in its text."""
    if pa.types.is_null(part.column("found").type) or part.column("found").null_count == part.num_rows:
        return [np.zeros((0, 3), np.uint64)] * part.num_rows
    every = (x.reshape(-1, 3) for x in binary_rows(part.column("found"), np.uint64))
    return [x[x[:, 0] == r] for x, r in zip(every, part.column("row").to_numpy().view(np.uint64), strict=True)]


def _cut(original: bool):
    """Cut texts; with ``original`` texts that lose nothing stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "body"):
                w = _text.Words(part.column("body"), "space")
                gone = removed(w, [x[:, 1] for x in _own(part)])
                lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
                kept = kept_text(w, gone)
                if original:
                    kept = pc.if_else(pa.array(lost > 0), kept, part.column("body"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w.counts), pa.array(lost), kept, part.column("rest")], ["doc_id", "n_words", "n_removed", "kept", "rest"])

    return run


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        own = _own(part)
        each = [len(x) for x in own]
        flat = np.concatenate([np.zeros((0, 3), np.uint64), *own])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), each)), pa.array((flat[:, 1] >> np.uint64(32)).astype(np.int64)), pa.array((flat[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(flat[:, 2].view(np.int64))], ["doc_id", "start", "length", "source_id"])


def _parsed(docs: DataFrame, window: int, rest: list[str]) -> DataFrame:
    """Rows (id, row, body, rest, found) of all documents; ``rest`` is a struct of further columns."""
    text = F.col("text").cast("string")
    extra = F.struct(*(F.col(f"`{c}`") for c in rest or ["doc_id"]))
    # New names and no constants: else one use of the exchange of texts is rewritten, and it is done twice.
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("body"), extra.alias("rest"))
    n = parts(docs, text_bytes("body"), 2)
    named = docs.where("id is not null")
    by_id = named.repartition(n, "id")
    to = lambda c: F.expr(f"pmod({c}, {n})")

    def for_documents(answers: DataFrame, width: int) -> DataFrame:
        return answers.repartitionById(n, to("to")).mapInArrow(_gather(width), "id bigint, found binary").repartition(n, "id").hint("shuffle_hash")

    told = saved(named.mapInArrow(_anchors(window, n), _ASK).repartitionById(n, to("part")).mapInArrow(_tell(n), _ANSWER))
    hot = _hot_anchors(told)
    indexed = by_id.join(for_documents(told.where("to >= 0"), 1), "id").mapInArrow(_index(window, n, hot), _SENT)
    found = indexed.repartitionById(n, to("part")).mapInArrow(_factor(window, n), _ANSWER)
    done = by_id.join(for_documents(found, 3), "id", "left")
    return done.unionByName(docs.where("id is null").withColumn("found", F.lit(None).cast("binary")))


def _cut_rows(docs: DataFrame, window: int, rest: list[str], original: bool = False) -> DataFrame:
    both = _parsed(docs, window, rest)
    schema = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, kept string").add("rest", both.schema["rest"].dataType)
    return both.mapInArrow(_cut(original), schema)


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of ``docs`` (doc_id, text).

    ``kept`` holds the words that stay, joined by one space. The document with the smallest
    doc_id keeps a passage. Null and empty texts have no words. Rows with a null doc_id
    neither lose words nor make others lose them. Rows that repeat a doc_id, with the same text
    or another, are each cut on their own by what smaller doc_ids have, never by each other.
    Other columns are ignored.
    """
    return _cut_rows(docs, window, []).drop("rest")


def find_factors(docs: DataFrame, window: int = 13) -> DataFrame:
    """Rows (doc_id, start, length, source_id): the factors themselves, in words from 0, and the document each refers to."""
    return _parsed(docs, window, []).mapInArrow(_factors, "doc_id bigint, start bigint, length bigint, source_id bigint")


def cut_documents(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with ``text`` (and n_chars, if there) of rows that lose words replaced; the rest is unchanged.

    Rows are treated as in remove_repeats(); other columns may have any name.
    """
    others = [c for c in docs.columns if c != "text"]
    cut = _cut_rows(docs, window, others, original=True)
    new = {c: F.col(f"rest.`{c}`") for c in others} | {"text": F.col("kept")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return cut.select(*(new[c].alias(c) for c in docs.columns))
