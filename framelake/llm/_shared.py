"""Which 64-bit keys occur under two different owners: one shuffle of packed blobs.

``Pack`` collects (key, owner) entries of a map task and turns them into one row
for each target partition. Keys that a flush has already seen under two owners
are shared for certain: their owners are told at once, and only one mark goes on,
so a key in very many rows sends a few bytes from each flush, never one row each.
``meet`` is the receiving side. Both are exact. Answers travel back packed as well: one
row for each partition of owners (``pack_answers``), put together again by ``gather``.
"""

from __future__ import annotations

import numpy as np

from framelake.llm._exec import run_starts

#: Stands for "some owner who needs no answer"; the next number for many of them.
ANY = np.iinfo(np.int64).min
MANY = ANY + 1
#: Entries that a map task holds before it passes them on (about 50 MB while sorting).
FLUSH = 1_000_000
#: A key is hot from so many flushes, or from so many owners in one flush, on.
HOT_FLUSHES, HOT_OWNERS = 64, 100


def by_owner(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners in order, sorted keys, offsets of each owner's keys."""
    order = np.lexsort((keys, owners))
    k, o = keys[order], owners[order]
    at = run_starts([o])
    return o[at], k, np.append(at, len(k))


class Pack:
    def __init__(self, parts: int) -> None:
        self.parts, self.keys, self.owners, self.n = parts, [], [], 0

    def add(self, keys: np.ndarray, owners: np.ndarray) -> bool:
        """True when it is time to flush."""
        self.keys.append(keys)
        self.owners.append(owners)
        self.n += len(keys)
        return self.n >= FLUSH

    def flush(self) -> tuple[list[tuple[int, bytes, bytes, bytes]], tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """Rows (part, keys, owners, how many keys each owner has here), and what is known to be shared, by owner."""
        if not self.n:
            return [], None
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        self.keys, self.owners, self.n = [], [], 0
        order = np.argsort(keys)
        k, o = keys[order], owners[order]
        at = run_starts([k])
        each = np.diff(np.append(at, len(k)))
        two = np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)
        shared = np.zeros(len(keys), bool)
        shared[order] = np.repeat(two, each)
        known = by_owner(keys[shared], owners[shared]) if shared.any() else None
        k, o = k[at], np.where(two, np.where(each >= HOT_OWNERS, MANY, ANY), o[at])  # one entry of each key
        part = (k >> np.uint64(24)) % np.uint64(self.parts)
        by = np.lexsort((o, part))
        k, o, part = k[by], o[by], part[by]
        cuts = np.append(run_starts([part]), len(part))
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.append(run_starts([o[a:b]]), b - a)
            rows.append((int(part[a]), k[a:b].tobytes(), o[a:b][at[:-1]].tobytes(), np.diff(at).astype(np.uint32).tobytes()))
        return rows, known


def meet(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray] | None, np.ndarray, np.ndarray]:
    """Of the rows of one partition: what is shared, by owner; hot keys and their number of flushes."""
    if not rows:
        return None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
    owners = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.uint32)) for r in rows])
    order = np.argsort(keys)
    k = keys[order]
    at = run_starts([k])
    each = np.diff(np.append(at, len(k)))
    # Each flush sends a key once, so two entries mean two flushes; equal owners (repeated rows) do not count.
    o = owners[order]
    two = (np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)) | (np.maximum.reduceat(o, at) <= MANY)
    weight = each + HOT_FLUSHES * np.add.reduceat((o == MANY).astype(np.int64), at)
    hot = weight >= HOT_FLUSHES
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(two, each)
    hit &= owners > MANY
    return (by_owner(keys[hit], owners[hit]) if hit.any() else None), k[at][hot], weight[hot]


def pack_answers(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None, parts: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Rows (to, owners, sizes, values), one for each of ``parts`` partitions of owners; values are 64-bit, or rows of these."""
    if found is None:
        return []
    ids, values, at = found
    to, size = ids % parts, np.diff(at)
    order = np.argsort(to, kind="stable")
    size = size[order]
    end = np.cumsum(size)
    take = np.repeat(at[:-1][order] - (end - size), size) + np.arange(end[-1])
    ids, to, values = ids[order], to[order], values[take]
    cuts = np.append(run_starts([to]), len(to))
    start = np.concatenate(([0], end))
    return [(int(to[a]), ids[a:b].tobytes(), size[a:b].astype(np.uint32).tobytes(), values[start[a] : start[b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


def gather(rows: list[tuple[bytes, bytes, bytes]], width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, values (sorted, if they are single numbers), and offsets of each owner's values, of all answers of a partition."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    owners = np.concatenate([np.repeat(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.uint32)) for r in rows])
    values = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
    if width == 1:
        return by_owner(values, owners)
    order = np.argsort(owners, kind="stable")
    o = owners[order]
    at = run_starts([o])
    return o[at], values.reshape(-1, width)[order], np.append(at, len(o))
