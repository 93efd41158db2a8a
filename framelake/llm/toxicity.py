"""Operator 10: toxic spans by a linear-chain conditional random field, and document scores from them.

A token's features are its word and its first 3 to 8 bytes, hashed into ``2**BITS`` weights.
Tokens are labelled from document labels: a token of a toxic document is toxic if one of
its features is far more frequent in toxic documents than in clean ones. The field (two
tags, transition weights) is trained on these tokens, and its forward-backward marginals, over
the whole document as one chain, give each token's chance to be toxic. Their sum, maximum, count
and density in a document go into a logistic model of the document label, so that the score
is a probability. All of a text is read; tokens above one half are reported as byte spans.

A document's numbers come from its own tokens by the same operations in the same order,
whatever other documents are in the batch, so its score is the same to the last bit in any partitioning.

The field is fitted on the driver on at most ``SAMPLE`` toxic and ``2 * SAMPLE`` clean
labelled documents (those with the smallest hash of their id; one text for each id) of at most ``SAMPLE_BYTES`` together,
near copies left out; the class weights make up for the share that was taken. Nothing else is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _text
from framelake.llm._exec import saved, text_bytes

BITS, SAMPLE, SAMPLE_BYTES = 20, 800, 12 << 20
#: Words that are gone through one after the other; blocks of a document are joined by their transfer matrices.
STEPS = 64
_PREFIXES = (3, 4, 5, 6, 7, 8)


@dataclass
class Model:
    weights: np.ndarray  # by feature
    chain: np.ndarray  # bias, start, 0->1, 1->0, 1->1
    doc: np.ndarray  # of the logistic model
    base: float  # score of every document where there was nothing to learn from; else nan


class _Cut:
    """Words cut to their first bytes, for hashing."""

    def __init__(self, w: _text.Words, n: int, rows: np.ndarray) -> None:
        self.data, self.start = w.data, w.start[rows]
        self.end = np.minimum(w.end[rows], self.start + n)

    hashes = _text.Words.hashes


def features(w: _text.Words, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weight numbers of the given words (one row each)."""
    shift = np.uint64(64 - BITS)
    out = np.empty((len(rows), 1 + len(_PREFIXES)), np.int32)
    out[:, 0] = whole >> shift
    for j, n in enumerate(_PREFIXES, 1):
        out[:, j] = _text.mix(_Cut(w, n, rows).hashes() + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> shift
    return out


def emissions(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Sum of each word's weights, one feature at a time."""
    out = np.zeros(len(feats))
    for j in range(feats.shape[1]):
        out += weights[feats[:, j]]
    return out


def blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each block of at most STEPS words, and its number in its document."""
    n = np.diff(first)
    each = -(-n // STEPS)
    doc = np.repeat(np.arange(len(n)), each)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = first[:-1][doc] + at * STEPS
    return start, np.minimum(STEPS, first[1:][doc] - start), at


def marginals(e: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's chance to be toxic, and the expected numbers of (start, 0->1, 1->0, 1->1).

    ``first`` has the offsets of the documents, each of which is one chain. Messages are those of
    the plain recursion over all its tokens: blocks first get the product of their transfer matrices,
    then messages go from block to block, then through the tokens of all blocks at a time.
    """
    start, size, number = blocks(first)
    p, counts = np.zeros(len(e)), np.zeros(4)
    if not len(start):
        return p, counts
    x = np.exp(np.clip(e + chain[0], -30, 30))
    begin, t01, t10, t11 = np.exp(np.clip(chain[1:], -30, 30))
    order = np.argsort(-size, kind="stable")  # long blocks first
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # blocks with a t-th token
    opens = number[order] == 0
    up = np.where(opens, begin, t01)  # 0->1 at a block's first token; before a document the message is (1, 0)
    enter, leave = _between(x, start, live, up, (t01, t10, t11), order, number)
    fwd = np.empty((size[0] + 1, len(start), 2))
    fwd[0] = enter
    for t, n in enumerate(live):
        xt = x[start[:n] + t]
        f0, f1 = fwd[t, :n, 0], fwd[t, :n, 1]
        a0, a1 = f0 + f1 * t10, xt * (f0 * (t01 if t else up[:n]) + f1 * t11)
        z = a0 + a1
        fwd[t + 1, :n, 0], fwd[t + 1, :n, 1] = a0 / z, a1 / z
    b0, b1 = leave
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        f0, f1 = fwd[t + 1, :n, 0], fwd[t + 1, :n, 1]
        one = f1 * b1[:n] / (f0 * b0[:n] + f1 * b1[:n])
        p[start[:n] + t] = one
        xt = x[start[:n] + t] * b1[:n]
        g0, g1, s01 = fwd[t, :n, 0], fwd[t, :n, 1], t01 if t else up[:n]
        z = g0 * (b0[:n] + s01 * xt) + g1 * (t10 * b0[:n] + t11 * xt)
        moved = g0 * s01 * xt / z, g1 * t10 * b0[:n] / z, g1 * t11 * xt / z
        if t:
            counts[1:] += [m.sum() for m in moved]
        else:
            counts[0] = one[opens].sum()
            counts[1:] += [m[~opens].sum() for m in moved]
        c0, c1 = b0[:n] + s01 * xt, t10 * b0[:n] + t11 * xt
        s = c0 + c1
        b0[:n], b1[:n] = c0 / s, c1 / s
    return p, counts


def _between(x: np.ndarray, start: np.ndarray, live: np.ndarray, up: np.ndarray, steps: tuple[float, float, float], order: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The messages that enter blocks from the left and from the right, in the given order of blocks."""
    n_blocks = len(order)
    enter, leave = np.tile([1.0, 0.0], (n_blocks, 1)), np.ones((n_blocks, 2))
    if number.any():
        t01, t10, t11 = steps
        m = np.tile([1.0, 0.0, 0.0, 1.0], (n_blocks, 1)).T.copy()  # the product, row by row
        for t, n in enumerate(live):
            a, b, c, d = m[:, :n]
            xt, s = x[start[:n] + t], t01 if t else up[:n]
            new = a + t10 * c, b + t10 * d, xt * (s * a + t11 * c), xt * (s * b + t11 * d)
            z = new[0] + new[1] + new[2] + new[3]
            for i, v in enumerate(new):
                m[i, :n] = v / z
        natural = np.empty_like(m)
        natural[:, order] = m
        a, b, c, d = natural
        by = np.argsort(number, kind="stable")  # first blocks of all documents, second ones, ...
        cuts = np.searchsorted(number[by], np.arange(int(number.max()) + 2))
        turns = [by[i:j] for i, j in zip(cuts[1:], cuts[2:], strict=False)]
        for now in turns:
            i = now - 1
            f0, f1 = a[i] * enter[i, 0] + b[i] * enter[i, 1], c[i] * enter[i, 0] + d[i] * enter[i, 1]
            enter[now, 0], enter[now, 1] = f0 / (f0 + f1), f1 / (f0 + f1)
        for now in turns[::-1]:
            g0, g1 = a[now] * leave[now, 0] + c[now] * leave[now, 1], b[now] * leave[now, 0] + d[now] * leave[now, 1]
            leave[now - 1, 0], leave[now - 1, 1] = g0 / (g0 + g1), g1 / (g0 + g1)
    return enter[order], (leave[order, 0], leave[order, 1])


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's score is made of: sum, maximum, count and density of toxic tokens."""
    n = np.diff(first)
    s, c, top = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        at = first[:-1][full]
        s[full], c[full], top[full] = np.add.reduceat(p, at), np.add.reduceat((p > 0.5).astype(float), at), np.maximum.reduceat(p, at)
    return np.stack([np.ones(len(n)), np.log1p(s), top, np.log1p(c), np.sqrt(s / np.maximum(n, 1))], axis=1)


def weighed(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x @ b, column by column: a row's sum does not depend on the other rows."""
    out = np.zeros(len(x))
    for j in range(len(b)):
        out += x[:, j] * b[j]
    return out


def _vocabulary(w: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each distinct word, its hash, and each token's word number."""
    known, rows, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    order = np.argsort(rows)  # by place, as hashing needs it
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rows[order], known[order], rank[which]


def token_labels(feats: np.ndarray, which: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents with a feature that marks them."""
    counts = [np.zeros(1 << BITS, np.int64) for _ in range(2)]
    for i, label in enumerate(toxic.tolist()):
        counts[label][np.unique(feats[np.unique(which[first[i] : first[i + 1]])])] += 1
    n0, n1 = counts
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    t1, t0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    odds = np.log((n1 + 0.1) / (t1 + 1)) - np.log((n0 + 0.1) / (t0 + 1))
    mark = (n1 >= max(3, 0.02 * t1)) & (odds >= 3)
    return (mark[feats].any(axis=1)[which] & (toxic[doc] == 1)).astype(float)


def distinct(w: _text.Words, hashes: int = 8, same: int = 2) -> np.ndarray:
    """Rows that are no near copies of earlier ones: fewer than ``same`` of ``hashes`` min-hashes of their word triples agree.

    Else the words of a copied toxic text would all look toxic.
    """
    grams, at = w.grams(w.hashes(), 3)
    seen: set[tuple[int, int]] = set()
    keep = np.ones(len(w.first) - 1, bool)
    for i in range(len(keep)):
        g = grams[at[i] : at[i + 1]]
        if len(g):
            own = {(j, int(_text.mix(g + np.uint64(j)).min())) for j in range(hashes)}
            keep[i] = len(own & seen) < same
            seen |= own
    return keep


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)) * weight.sum() / 100
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b * weight.sum() / 100)
        b += step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(texts: list[str], toxic: np.ndarray, shares: tuple[float, float], rounds: int = 30) -> Model:
    """``shares``: how many labelled documents each sampled clean and toxic one stands for."""
    n1 = float(toxic.sum() * shares[1])
    total = float((1 - toxic).sum() * shares[0]) + n1
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BITS), np.zeros(5), np.zeros(5), (n1 + 0.1) / (total + 1))
    own = distinct(_text.Words(pa.array(texts, pa.large_string()), "alnum", lower=True))
    if toxic[own].any() and not toxic[own].all():
        shares = tuple(shares[t] * (toxic == t).sum() / (toxic[own] == t).sum() for t in (0, 1))
        texts, toxic = [t for t, k in zip(texts, own, strict=True) if k], toxic[own]
    w = _text.Words(pa.array(texts, pa.large_string()), "alnum", lower=True)
    rows, known, which = _vocabulary(w)
    feats = features(w, rows, known)
    label = token_labels(feats, which, w.first, toxic)
    start = w.first[:-1][np.diff(w.first) > 0]
    inner = np.ones(len(label), bool)
    inner[start] = False
    before = np.concatenate(([0], label[:-1]))
    seen = np.array([label[start].sum(), (label * (1 - before))[inner].sum(), ((1 - label) * before)[inner].sum(), (label * before)[inner].sum()])
    weights, chain = np.zeros(1 << BITS), np.array([-5.0, 0, 0, 0, 0])
    m, v = np.zeros(len(weights) + 5), np.zeros(len(weights) + 5)
    for t in range(1, rounds + 1):  # Adam on the whole sample
        p, counts = marginals(emissions(weights, feats)[which], w.first, chain)
        off = np.bincount(which, p - label, len(rows))
        grad = np.concatenate([sum(np.bincount(feats[:, j], off, len(weights)) for j in range(feats.shape[1])) + 0.05 * weights, [off.sum()], counts - seen])
        grad[-5:] += 0.05 * chain
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)
        weights -= step[:-5]
        chain = chain - step[-5:]
    p, _ = marginals(emissions(weights, feats)[which], w.first, chain)
    doc = logistic(summary(p, w.first), toxic.astype(float), np.where(toxic == 1, shares[1], shares[0]))
    return Model(weights.astype(np.float32), chain, doc, float("nan"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 2, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on labelled documents but for those whose crc32(doc_id as text) mod 4 is ``held_out``.

    At most ``sample`` toxic and twice as many clean documents of ``sample_bytes`` of text together reach the driver.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.where(F.crc32(F.col("_id").cast("string")) % 4 != held_out)
    totals = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    taken = [known.where(f"_toxic = {t}").orderBy(F.xxhash64("_id"), "_id").limit(sample * (2 - t)) for t in (0, 1)]
    few = F.broadcast(taken[0].unionByName(taken[1]))  # 3 * sample rows of two numbers
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).join(few, "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text")))
    size = {(r["_toxic"], r["_id"]): (r["h"], r["n"]) for r in texts.select("_toxic", "_id", F.xxhash64("_id").alias("h"), text_bytes("text").alias("n")).collect()}  # 3 * sample rows
    fit_in, room = [], {t: sample_bytes // 2 for t in (0, 1)}
    for (t, i), (_, n) in sorted(size.items(), key=lambda x: x[1]):
        if n <= room[t]:  # whole texts; those that are longer than what is left are passed over
            room[t] -= n
            fit_in.append((i,))
    got = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fit_in, "_id bigint")), "_id", "left_semi").select("text", "_toxic").collect() if fit_in else []
    got.sort()
    toxic = np.array([r["_toxic"] for r in got], int)
    return fit([r["text"] for r in got], toxic, tuple(totals.get(t, 0) / max(1, int((toxic == t).sum())) for t in (0, 1)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _text.Words(part.column("text"), "alnum", lower=True)
                p = np.zeros(len(w.start))
                if len(p) and np.isnan(model.base):
                    rows, known, which = _vocabulary(w)
                    e = emissions(model.weights, features(w, rows, known))[which]
                    p, _ = marginals(e, w.first, model.chain)
                n = len(w.first) - 1
                score = 1 / (1 + np.exp(-np.clip(weighed(summary(p, w.first), model.doc), -30, 30))) if np.isnan(model.base) else np.full(n, model.base)
                hit = np.flatnonzero(p > 0.5)
                doc = np.searchsorted(w.first, hit, "right") - 1
                at = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                spans = [pa.ListArray.from_arrays(at, pa.array(x[hit] - w.at[doc])) for x in (w.start, w.end)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), *spans], ["doc_id", "score", "starts", "ends"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, starts, ends), one for each row of ``docs`` (doc_id, text).

    ``starts`` and ``ends`` are byte offsets of toxic tokens in the UTF-8 text. Null and empty
    texts have no tokens and get the score of a document without any. Where the labels have
    only one class, every document gets the share of toxic labels. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(model), "doc_id bigint, score double, starts array<bigint>, ends array<bigint>")


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``docs`` without rows that score ``cut`` or more; all columns stay, in one pass and without a join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"doc_id": pa.int64(), "text": pa.string()}
        scored = _score(model)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                two = pa.RecordBatch.from_arrays([part.column(c).cast(t) for c, t in names.items()], list(names))
                score = np.concatenate([b.column("score").to_numpy() for b in scored(iter([two]))])
                yield part.filter(pa.array(score < cut))

    return docs.mapInArrow(run, schema)
