"""Operator 9: byte-pair encoding with word ends, merged for many words at a time in numpy.

The symbols of all words that a worker has not met yet stand in one flat array. A round
looks up every neighbouring pair by binary search over the sorted pair keys, takes the
lowest rank of each word and merges it wherever it stands (from the left where it overlaps
itself), until no word has a pair left. Words seen before come from a bounded memory. A word of
more than ``LONG`` bytes would need too many rounds over all of it: its pairs wait in a heap, by
rank and place, and only the neighbours of a merge are looked up again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _text

CACHE = 500_000
LONG = 2000
_NONE = np.iinfo(np.int64).max


class WordBpe:
    def __init__(self, path: str) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.number = {i: str(i) for i in self.token}
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        char = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in char], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in char], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        a, b, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        key = a << 32 | b
        # A pair that is listed twice has its last rank.
        order = np.lexsort((-np.arange(len(key)), key))
        order = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))]
        self.key, self.rank, self.merged = key[order], order.astype(np.int64), merged[order]
        self.pairs: dict[int, tuple[int, int]] = {}  # for long words
        # The pattern of the vocabulary file, its white space spelled out.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.spaces = regex.compile(r"\p{White_Space}+").split
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.tags = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty) in one array, and their offsets by word."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        sym[end - 1] = self.last[data[end - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.full(len(sym), _NONE)
            rank[:-1] = np.where((self.key[at] == key) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.append(first, len(sym))))
            over = each == _NONE  # words that are finished leave
            done_sym.append(sym[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == each) & ~over)
            if not len(hit):
                break
            run = np.concatenate(([True], np.diff(hit) != 1))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]  # of overlapping pairs every other one
            sym[hit] = self.merged[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return sym[by], np.searchsorted(word[by], np.arange(len(words) + 1))

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word, in the same order of merges: lowest rank first, then from the left."""
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        data = np.frombuffer(word, np.uint8)
        sym = self.inner[data].tolist()
        sym[-1] = int(self.last[data[-1]])
        n, pairs = len(sym), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = lambda i: pairs.get(sym[i] << 32 | sym[after[i]]) if after[i] < n else None
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := get(i))]
        heapify(heap)
        while heap:
            rank, i, new = heappop(heap)
            if sym[i] < 0 or (p := get(i)) is None or p[0] != rank:
                continue  # one of both is part of another merge by now
            j = after[i]
            sym[i], sym[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := get(k)):
                    heappush(heap, (p[0], k, p[1]))
        return [s for s in sym if s >= 0]

    def learn(self, chunks: set[str]) -> None:
        """Ids and tokens, as text, of chunks without white space."""
        if not chunks:
            return
        named = [(c, self.words(c)) for c in chunks]
        each = {w: w.encode() for _, ws in named for w in ws}
        long = [w for w, b in each.items() if len(b) > LONG]
        each = [w for w, b in each.items() if len(b) <= LONG]
        flat, at = self.merge([w.encode() for w in each]) if each else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        flat, at = flat.tolist(), at.tolist()
        for w in long:
            flat += self.merge_long(w.encode())
            at.append(len(flat))
        each += long
        number, text = list(map(self.number.__getitem__, flat)), list(map(self.token.__getitem__, flat))
        numbers = {w: " ".join(number[a:b]) for w, a, b in zip(each, at, at[1:], strict=False)}
        texts = {w: " ".join(text[a:b]) for w, a, b in zip(each, at, at[1:], strict=False)}
        for c, ws in named:
            if len(ws) == 1:
                self.ids[c], self.tokens[c] = numbers[ws[0]], texts[ws[0]]
            else:
                self.ids[c] = " ".join(map(numbers.__getitem__, ws))
                self.tokens[c] = " ".join(map(texts.__getitem__, ws))

    def chunks(self, text: str) -> list[str]:
        """Normalised text (NFC, lower case by character) between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [c for c in self.spaces(text) if c] if self.odd(text) else text.split()

    def encode(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """By text: decimal ids joined by a space, and the decoded text."""
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.tokens.clear()
        tagged = {x for x in self.special if any(x in t for t in texts)}
        for x in tagged:
            self.ids[x], self.tokens[x] = str(self.special[x]), x
        split = []
        for t in texts:
            if tagged and any(x in t for x in tagged):
                split.append([c for s in self.tags(t) for c in ([s] if s in self.special else self.chunks(s))])
            else:
                split.append(self.chunks(t))
        self.learn(set().union(*split).difference(self.ids))
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        return [" ".join(map(ids, s)) for s in split], [" ".join(map(tokens, s)) for s in split]


def _encode(path: str, as_array: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(path)
            for part in _text.slices(batch, "text", 2 << 20):
                ids, decoded = bpe.encode(_text.strings(part.column("text")).to_pylist())
                n = [x.count(" ") + 1 if x else 0 for x in ids]
                col = pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())) if as_array else pa.array(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), col, pa.array(decoded)], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, tokenizer: str, as_array: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), one for each row of ``docs`` (doc_id, text).

    ``ids`` is text, decimal ids joined by one space, or array<int> with ``as_array``;
    ``decoded`` is the vocabulary's own decoding (tokens joined by one space). Null and empty
    texts have no tokens. Other columns are ignored; repeated rows and null doc_ids pass through.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(tokenizer, as_array), f"doc_id bigint, n_tokens bigint, ids {'array<int>' if as_array else 'string'}, decoded string")
