"""Operator 12: fill-in-the-middle texts from a sparse scan for class changes and sentinels.

A unit is a run of ASCII letters or one other character. One Aho-Corasick automaton reads a
text's characters as a few symbols (letters, others, and each character that a sentinel has) and reports two
kinds of events: an ASCII letter next to a character of the other class, and a sentinel. Between two changes
units need no looking at: a gap of letters is one unit, a gap of others as many as
it has characters. Running sums over the gaps give the number of units, and the place where the k-th
unit ends is found by binary search in them.

The state of an automaton is fixed by as many last characters as its longest pattern has, so
all places of a batch take their transitions at once, one round of lookups for each character of that pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._text import raw, slices, strings

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a state reports: a change of class, and from the second bit on the sentinels.
CHANGE = 1


def automaton(patterns: dict[tuple[int, ...], int], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(states x symbols) transitions with failures resolved, and what each state reports."""
    go, tells = [[-1] * symbols], [0]
    for pattern, what in patterns.items():
        s = 0
        for x in pattern:
            if go[s][x] < 0:
                go[s][x] = len(go)
                go.append([-1] * symbols)
                tells.append(0)
            s = go[s][x]
        tells[s] |= what
    back, queue = [0] * len(go), [0]
    for s in queue:  # by depth, so the state to fall back to is done before
        tells[s] |= tells[back[s]]
        for x in range(symbols):
            t, other = go[s][x], go[back[s]][x] if s else 0
            if t < 0:
                go[s][x] = other
            else:
                back[t] = other
                queue.append(t)
    return np.array(go, np.uint16), np.array(tells, np.uint8)


class Scanner:
    """The automaton for some sentinels."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS) -> None:
        own = sorted(set("".join(sentinels)))
        letter = lambda c: c.isascii() and c.isalpha()
        if len(sentinels) > 7 or any(ord(c) > 127 for c in own) or any(len(x) < 2 or "".join(sentinels).count(c) != "".join(y[at] for y in sentinels).count(c) for x in sentinels for at, c in ((0, x[0]), (-1, x[-1]))):
            raise ValueError("sentinels are ASCII, and their first and last characters occur nowhere else in one")
        self.symbol = np.zeros(129, np.uint8)  # 0: other characters, 1: other letters, from 2 on the sentinels' own
        self.symbol[[c for c in range(128) if letter(chr(c))]] = 1
        self.symbol[[ord(c) for c in own]] = np.arange(2, 2 + len(own))
        self.is_letter = np.array([False, True, *(letter(c) for c in own)])
        n = len(self.is_letter)
        patterns = {(a, b): CHANGE for a in range(n) for b in range(n) if self.is_letter[a] != self.is_letter[b]}
        self.lengths = [len(x) for x in sentinels]
        for i, x in enumerate(sentinels):
            path = tuple(int(self.symbol[ord(c)]) for c in x)
            patterns[path] = patterns.get(path, 0) | 2 << i
        self.depth = max(map(len, patterns))
        self.go, self.tells = automaton(patterns, n)

    def events(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that report something, and what."""
        n, wide = len(symbols), self.go.shape[1]
        flat = (self.go * wide).ravel()
        state = np.zeros(n, np.uint16)
        for j in range(min(self.depth, n) - 1, -1, -1):  # the character j places before each place
            state[j:] = flat[state[j:] + symbols[: n - j]]
        what = self.tells[state // wide]
        at = np.flatnonzero(what)
        return at, what[at]


class Units:
    """The units of the texts of a string array."""

    def __init__(self, text: pa.Array, scanner: Scanner) -> None:
        data, at = raw(strings(text))
        self.text = data.tobytes().decode()
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
        symbols = scanner.symbol[np.minimum(chars, 128)]
        where, what = scanner.events(symbols)
        self.marked = np.zeros(len(at) - 1, bool)
        for i, size in enumerate(scanner.lengths):
            end = where[(what & 2 << i) > 0]
            row = np.searchsorted(self.first, end, "right") - 1
            self.marked[row[end - size + 1 >= self.first[row]]] = True  # not across two texts
        starts = self.first[:-1][self.first[1:] > self.first[:-1]]
        self.gap = np.union1d(where[(what & CHANGE) > 0], starts)
        self.end = np.append(self.gap[1:], len(chars))
        self.run = scanner.is_letter[symbols[self.gap]]
        self.before = np.concatenate(([0], np.cumsum(np.where(self.run, 1, self.end - self.gap))))
        self.base = self.before[np.searchsorted(self.gap, self.first)]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.base)

    def ends(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k`` units of each text end."""
        goal = self.base[:-1] + k
        j = np.maximum(np.searchsorted(self.before, goal) - 1, 0)
        if not len(self.gap):
            return self.first[:-1]
        inside = np.where(self.run[j], self.end[j], self.gap[j] + goal - self.before[j])
        return np.where(k > 0, inside, self.first[:-1])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(sentinels: tuple[str, str, str], plain: int, spm: int):
    before, after, between = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentinels)
        for whole in batches:
            for b in slices(whole, "text"):
                u = Units(b.column("text"), scanner)
                n = u.counts
                h = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
                one, two = h[0] % (n + 1), h[1] % (n + 1)
                a, c = u.ends(np.minimum(one, two)), u.ends(np.maximum(one, two))
                stays = (u.first[1:] == u.first[:-1]) | u.marked | (h[2] % 100 >= 100 - plain)
                form = np.where(stays, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
                out = []
                for f, s, x, y, e in zip(form.tolist(), u.first.tolist(), a.tolist(), c.tolist(), u.first[1:].tolist(), strict=False):
                    head, mid, tail = u.text[s:x], u.text[x:y], u.text[y:e]
                    if f == "plain":
                        out.append(u.text[s:e])
                    elif f == "psm":
                        out.append(f"{before}{head}{after}{tail}{between}{mid}")
                    else:
                        out.append(f"{after}{tail}{before}{head}{between}{mid}")
                cols = [b.column("doc_id"), pa.array(n), pa.array(form.tolist()), pa.array(a - u.first[:-1], mask=stays), pa.array(c - a, mask=stays), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs`` (doc_id, text).

    ``n`` counts the units of the whole text. Prefix and middle end after numbers of units drawn from ``seed`` and
    the doc_id; ``plain`` of a hundred documents stay as they are, ``spm`` of a hundred others get their suffix first.
    Texts that are null (as if empty), empty or contain a sentinel stay as they are, with null lengths. Rows that repeat a doc_id
    are cut alike where their texts are equal, each by its own text otherwise; a null doc_id draws as an empty one. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", *(h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("doc_id"), seed))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut(sentinels, plain, spm), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() made an output of, from the output and its form alone.

    No text with a sentinel is ever taken apart, and a sentinel's first and last characters occur nowhere else in
    one, so each is found where it was put.
    """
    p, s, m = (F.locate(x, output) for x in sentinels)
    np_, ns, nm = (len(x) for x in sentinels)
    part = lambda start, n, end: F.substr(output, start + n, end - start - n)
    middle = F.substr(output, m + nm)
    psm = F.concat(part(p, np_, s), middle, part(s, ns, m))
    spm = F.concat(part(p, np_, m), middle, part(s, ns, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
