"""Operator 2: licence scan by a positional index of rare template words.

The licence words of a file make up postings (word: places in the file). A template is looked up in them from its words of
highest inverse document frequency on: a place of such a word gives a shift (place in file minus place in wording), and the
postings of the other words are intersected with these by relative position. A template is there where
at least SHARE of its words stand at one shift, give or take SLACK words for what was put in or left out, and where one of its mandatory
key phrases stands in the wording's place or at most NEAR words before or after it. Only both together give a label: a key phrase in
prose does not, nor does a wording without its key phrase, which half counts for the score. Frequencies are counted over all files;
they choose the order of words and rule nothing out.

Key phrases and the fixed phrases (``BASE``), which are counted at every place, are intersected from postings in the same way.

Words are compared by 64-bit hash, whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _text

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, wording, mandatory key phrases (any of them).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["gnu general public license as published by the free software foundation either version 3", "gnu general public license version 3", "gnu general public license v3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["gnu general public license as published by the free software foundation either version 2", "gnu general public license version 2", "gnu general public license v2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["mozilla public license v 2 0", "mozilla public license version 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0", "eclipse public license v 2 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0", "cc by 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0", "cc by sa 4 0"]),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["cc0 1 0 universal", "dedicated the work to the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software released into the public domain"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license version 1 0", "any person or organization obtaining a copy of the software"]),
]
#: The share of a wording that must be there, words by which its parts may be moved against each other, and words between it and its key phrase.
SHARE, SLACK, NEAR = 0.5, 3, 50


class Index:
    """Word numbers of all phrases and templates, and the order in which template words vote."""

    def __init__(self) -> None:
        texts = [p for p in BASE] + [t for _, t, _ in TEMPLATES] + [p for _, _, ps in TEMPLATES for p in ps]
        words = sorted({w for t in texts for w in t.split()})
        h = _text.Words(pa.array(words), "alnum").hashes()
        order = np.argsort(h)
        self.hash, number = h[order], {words[j]: i for i, j in enumerate(order)}
        coded = lambda t: [number[w] for w in t.split()]
        self.base = [(coded(p), label) for p, label in BASE.items()]
        self.templates = [(label, coded(t), [coded(p) for p in ps]) for label, t, ps in TEMPLATES]
        self.words = len(words)
        self.longest = max(len(t) for _, t, _ in self.templates)

    def weigh(self, files: int, with_word: np.ndarray) -> None:
        """Inverse document frequencies over all files; they only choose words, so no frequency shuts a licence out.

        Each template's rarest words vote first, so many that a shift without any of them covers less than SHARE of it.
        """
        self.idf = np.log((files + 20) / (with_word + 0.5))
        self.first, self.rest = [], []
        for _, t, _ in self.templates:
            need = next(n for n in range(len(t) + 1) if n / len(t) >= SHARE)
            by = sorted(range(len(t)), key=lambda j: (-self.idf[t[j]], j))
            self.first.append(by[: len(t) - need + 1])
            self.rest.append(by[len(t) - need + 1 :])

    def codes(self, w: _text.Words) -> np.ndarray:
        """The number of each word, -1 for words that are not ours."""
        h = w.hashes()
        near = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[near] == h, near, -1)

    def covered(self, post: Postings, doc: np.ndarray, first: np.ndarray, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each template and file: whether wording and key phrase are there, and the largest share of the wording at one place (0 below SHARE)."""
        n, gap = len(first) - 1, self.longest + 2 * (NEAR + SLACK)
        total = int(first[-1]) + (n + 1) * gap
        spots = post.at + (doc[post.at] + 1) * gap  # a gap between files keeps their shifts apart
        codes = np.full(total, -1, np.int32)
        codes[spots] = post.codes[post.at]
        found, share = np.zeros((len(self.templates), n), bool), np.zeros((len(self.templates), n))
        for i, (_, t, _) in enumerate(self.templates):
            # A place that covers enough has one of the first words at its shift or near it, so the others count only there.
            votes = np.zeros(total, np.uint16)
            for place in self.first[i]:
                votes[spots[post.cut(t[place])] - place] += 1
            if not votes.any():
                continue
            near = _window(votes) > 0
            for place in self.rest[i]:
                shift = spots[post.cut(t[place])] - place
                votes[shift[near[shift]]] += 1
            shift = np.flatnonzero(_window(votes) >= SHARE * len(t))
            cover = np.zeros(len(shift), np.int64)
            for j, word in enumerate(t):  # a word may have voted for two shifts of a window
                cover += np.logical_or.reduce([codes[shift + j + d] == word for d in range(-SLACK, SLACK + 1)])
            hit = cover >= SHARE * len(t)
            shift, cover = shift[hit], cover[hit] / len(t)
            # Start or end of the wording may be left out, but its middle is nearer to its own file than to others.
            own = np.clip(np.searchsorted(first + np.arange(1, n + 2) * gap - gap // 2, shift + len(t) // 2, "right") - 1, 0, n - 1)
            np.maximum.at(share[i], own, cover)
            if len(phrases[i]) and len(shift):
                at = phrases[i] + (doc[phrases[i]] + 1) * gap
                k = np.minimum(np.searchsorted(at, shift - NEAR), len(at) - 1)
                there = (at[k] >= shift - NEAR) & (at[k] <= shift + len(t) + NEAR)
                found[i, own[there]] = True
        return found, share


def _window(votes: np.ndarray) -> np.ndarray:
    """Sums over SLACK places before and after."""
    total = np.concatenate(([0], np.cumsum(np.pad(votes, SLACK), dtype=np.int64)))
    return total[2 * SLACK + 1 :] - total[: -2 * SLACK - 1]


class Postings:
    """The places of each of our words in a batch of files, in order."""

    def __init__(self, codes: np.ndarray, words: int) -> None:
        self.codes = codes
        at = np.flatnonzero(codes >= 0)
        self.at = at[np.argsort(codes[at], kind="stable")]
        self.cuts = np.searchsorted(codes[self.at], np.arange(words + 1))

    def cut(self, word: int) -> slice:
        return slice(self.cuts[word], self.cuts[word + 1])

    def verified(self, phrase: list[int], idf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where a whole phrase stands in one file: shifts of its rarest word, kept where the next rarest ones are at the same shift."""
        by = sorted(range(len(phrase)), key=lambda j: (-idf[phrase[j]], j))
        shift = self.at[self.cut(phrase[by[0]])] - by[0]
        for j in by[1:]:
            other = self.at[self.cut(phrase[j])] - j
            if not len(other):
                return other
            shift = shift[other[np.minimum(np.searchsorted(other, shift), len(other) - 1)] == shift]
        return shift[doc[shift] == doc[shift + len(phrase) - 1]]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many files of the task have each word; the last number stands for all files."""
    ix, n, df = Index(), 0, None
    for batch in batches:
        for part in _text.slices(batch, "text"):
            w = _text.Words(part.column("text"), "alnum", lower=True)
            codes = ix.codes(w)
            at = np.flatnonzero(codes >= 0)
            doc = np.searchsorted(w.first, at, "right") - 1
            kinds = np.unique(doc * ix.words + codes[at]) % ix.words
            df = np.bincount(kinds, minlength=ix.words) + (0 if df is None else df)
            n += part.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ix.words + 1)), pa.array(np.append(df, n))], ["word", "n"])


def _scan(files: int, with_word: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index()
        ix.weigh(files, with_word)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                yield _rows(ix, part)

    return run


def _rows(ix: Index, part: pa.RecordBatch) -> pa.RecordBatch:
    w = _text.Words(part.column("text"), "alnum", lower=True)
    post = Postings(ix.codes(w), ix.words)
    doc = np.repeat(np.arange(part.num_rows), w.counts)
    n_base = np.zeros(part.num_rows, np.int64)
    low, high = np.full(part.num_rows, np.iinfo(np.int64).max), np.full(part.num_rows, -1)
    base = np.zeros((len(ix.base), part.num_rows), bool)
    for k, (phrase, _) in enumerate(ix.base):
        at = post.verified(phrase, ix.idf, doc)
        d = doc[at]
        np.add.at(n_base, d, 1)
        np.minimum.at(low, d, at - w.first[d])
        np.maximum.at(high, d, at - w.first[d])
        base[k, d] = True
    keys = [np.unique(np.concatenate([post.verified(p, ix.idf, doc) for p in phrases])) for _, _, phrases in ix.templates]
    found, share = ix.covered(post, doc, w.first, keys)
    score = np.maximum(np.where(found, 0.5, 0) + 0.5 * share, 0.5 * base.any(axis=0)).max(axis=0)
    labels = [label for _, label in ix.base] + [label for label, _, _ in ix.templates]
    names, every = _names(base, labels), _names(np.concatenate([base, found]), labels)
    none = n_base == 0
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(w.counts), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), names, every, pa.array(score)],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )


def _names(hit: np.ndarray, labels: list[str]) -> pa.Array:
    """The sorted labels of each column, comma-joined."""
    kinds, which = np.unique(hit.T @ (1 << np.arange(len(hit))), return_inverse=True)
    return pa.array([",".join(sorted({label for k, label in enumerate(labels[: len(hit)]) if bits >> k & 1})) for bits in kinds.tolist()]).take(pa.array(which))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of ``docs``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start (null without any), the label columns are sorted and
    comma-joined; ``labels`` has the base labels and those of all templates that are there with a key phrase. ``score`` is
    0.5 to 1 for these, by the share of the wording, at most 0.5 for wording alone, and 0.5 for a base phrase. Null and empty texts have no words. Two passes, no shuffle of texts; nulls in doc_id and
    repeated rows pass through, other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = docs.select("text").mapInArrow(_frequencies, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many rows as there are template words
    counts = np.zeros(Index().words + 1)
    for r in df:
        counts[r["word"]] = r["n"]
    return docs.mapInArrow(_scan(int(counts[-1]), counts[:-1]), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
