"""Lexical search, fill-in-the-middle and exact top-k against brute force, on odd rows and empty tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import fim, inner, lexical
from framelake.llm._text import WORD_CLASSES, LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "A a Ä ä É", "x_y-z 12 12", "ß" * 40, "two two two", "two two two", "end\n", "0", "<P>", "a<S", "<M> two", ("long lane " * 20_000) + "two"]


def docs_of(spark, rows):
    """With further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("x") for c in ("term", "n", "segment", "h1", "form", "output", "rank", "score", "part")})


# Lexical search


def ranked(docs, items, k=20):
    held = [(d, Counter(TERM.findall((t or "").translate(AZ)))) for d, t in docs if d is not None]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(least.get(i, t), t)
    out = []
    for i, t in least.items():
        found = []
        for d, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in TERM.findall(t.translate(AZ)) if c[w])
            if s > 0:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def searched(spark, docs, items, k=20):
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit(1))
    return sorted(map(tuple, lexical.search(lexical.build_index(docs_of(spark, docs)), q, k).collect()))


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 64)
    monkeypatch.setattr(lexical, "QUERIES", 2)


def test_ranks_of_odd_rows(spark):
    docs = [*enumerate(ODD), (None, "two"), (3, "a again"), (-7, "two two two"), (2**40, "lane")]
    items = [(1, "two a"), (2, "Two TWO lane"), (3, None), (4, ""), (5, "nowhere"), (6, "ä É 12 12 12"), (6, "zz"), (None, "two"), (7, "the " * 50 + "two")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_segments_and_groups_change_nothing(spark, small_segments):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 30)) if i % 3 else ["w1", "w2", "w3"])) for i in rng.permutation(300)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(9)]
    segments = []
    for a in range(0, 300, 40):
        segments += list(lexical.segment_rows(np.array([d for d, _ in docs[a : a + 40]]), pa.array([t for _, t in docs[a : a + 40]]), a))
    index = spark.createDataFrame(pa.Table.from_batches(segments))
    got = sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string"), 7).collect()))
    assert got == ranked(docs, items, 7)
    assert searched(spark, docs, items, 7) == got


def test_lexical_large_sides_are_merged(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST", 0)
    docs, items = [(1, "a b"), (2, "b c c"), (3, "d")], [(1, "b c"), (2, "d d")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_lexical_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


@given(st.lists(st.integers(0, 2**62)))
def test_packed_numbers(values):
    data, size = lexical.pack(np.array(values, np.int64))
    assert lexical.unpack(data).tolist() == values and size.sum() == len(data)


def test_term_classes_agree():
    inside = [bool(TERM.fullmatch(chr(c))) for c in range(128)]
    assert [bool(WORD_CLASSES["alnum"][LOWER[c]]) for c in range(128)] == inside


# Fill in the middle


def cut(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD_CUTS = [*ODD, "a<P", ">b", "<<P", "S>x>", "<P<S<M", "ab1cd", "é<é>é", "\u0000a\u0000", "😀a😀", "<p>", "PSM" * 9, "<" * 30]


def test_middles_of_odd_rows(spark):
    rows = [*enumerate(ODD_CUTS), *((i + 100, t) for i, t in enumerate(ODD_CUTS)), (None, "ab cd"), (5, "other text"), (5, "other text"), (-3, "below zero")]
    got = fim.fill_in_middle(docs_of(spark, rows).repartition(3))
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [cut(*r) for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_an_empty_table(spark):
    assert fim.fill_in_middle(docs_of(spark, [])).collect() == []


@settings(max_examples=200)
@given(st.lists(st.text("aPSM<> é1", max_size=30), min_size=1, max_size=6))
def test_units_of_texts_in_one_array(texts):
    u = fim.Units(pa.array(texts), fim.Scanner())
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert u.counts.tolist() == [len(x) for x in units]
    assert u.marked.tolist() == [any(s in t for s in fim.SENTINELS) for t in texts]
    for share in (0.0, 0.3, 0.7, 1.0):
        k = np.array([int(share * len(x)) for x in units])
        assert (u.ends(k) - u.first[:-1]).tolist() == [len("".join(x[:n])) for x, n in zip(units, k, strict=True)]


def test_other_sentinels(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    with pytest.raises(ValueError):
        fim.Scanner(("ab", "ba", "cc"))
    rows = [(i, t) for i, t in enumerate(["a <|pre|> b", "<|pre|", "one two", "<|mid |>"])]
    got = {r.doc_id: r for r in fim.fill_in_middle(docs_of(spark, rows), plain=0, sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()}
    assert [got[i].form == "plain" for i in range(4)] == [True, False, False, False]
    assert [got[i].back for i in range(4)] == [t for _, t in rows]


# Exact top-k


def products(rows, k=10, scale=1024):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, v), v)
    whole = {i: [math.floor(scale * x) if abs(x) < 2**53 else scale * int(x) for x in v] for i, v in good.items()}
    limit = lambda s: min(2**63 - 1, max(-(2**63), s))
    out = []
    for q in whole:
        if q % 100 == 0:
            found = sorted((-limit(sum(a * b for a, b in zip(whole[q], v, strict=False))), i) for i, v in whole.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def top(spark, rows, kind="double", k=10):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("cell", "asks", "rank", "score", "g")})
    return sorted(map(tuple, inner.top_products(df, df.where("vec_id % 100 = 0"), k).collect()))


ODD_VECTORS = [(0, [0.5, -0.25, 0.0]), (1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, []), (7, [1.0]), (8, [1.0, 1.0, 1.0, 1.0]), (9, [-1e-9, 0.0, 0.0]), (10, [0.5, -0.25, 0.0]), (10, [0.5, -0.25, 0.0]), (11, [0.5, -0.25, 0.0]), (11, [-0.5, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (200, [0.001, 0.002, -0.003]), (None, [1.0, 1.0, 1.0]), (-100, [1.0, 0.0, 0.0])]


def test_products_of_odd_rows(spark):
    assert top(spark, ODD_VECTORS) == products(ODD_VECTORS)


def test_products_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [2.0**60, 1.0]), (4, [1e-300, 3.0]), (5, [2.0**20, 7.0]), (100, [2.0**40, 2.0**40]), (200, [0.5, 0.5])]
    assert top(spark, rows, k=4) == products(rows, k=4)


def test_products_in_many_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.integers(-3, 4, (900, 5)) / 1024).tolist()  # many ties
    rows = list(enumerate(x))
    want = products(rows)
    assert top(spark, rows) == want
    for least, share in ((17, 3), (1, 1)):
        monkeypatch.setattr(inner, "BLOCK", least)
        monkeypatch.setattr(inner, "grid", lambda n, m, wide, least, share=share: (2, share))
        got = sorted(map(tuple, inner.top_products(*(spark.createDataFrame(r, "vec_id bigint, embedding array<float>") for r in (rows, [r for r in rows if r[0] % 100 == 0]))).collect()))
        assert got == want


def test_blocks_against_plain_products():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (400, 6)) * (rng.random((400, 6)) < 0.4)
    at = np.arange(0, 2401, 6)
    best = [inner.Best(10, i) for i in range(20)]
    for a in range(0, 400, 37):
        b = min(400, a + 37)
        inner.search_block(inner.sparse(at[:21], x[:20].ravel()), best, np.arange(a, b), at[a : b + 1] - at[a], x[a:b].ravel())
    for i, b in enumerate(best):
        score = x @ x[i]
        order = [j for j in np.lexsort((np.arange(400), -score)).tolist() if j != i][:10]
        assert b.ids.tolist() == order and b.scores.tolist() == score[order].tolist()


def test_products_of_empty_tables(spark):
    assert top(spark, []) == []
    assert top(spark, [(100, [1.0])]) == []
    assert top(spark, [(1, [1.0])]) == []


def test_grid_bounds():
    groups, shares = inner.grid(10**9, 10**7, 64, 1000)
    assert 10**7 / groups * 64 * 8 <= inner.QUERY_BYTES and 10**9 / shares * 10**7 / groups * 64 <= 1.1 * inner.WORK
    assert inner.grid(0, 0, 1, 8) == (1, 8)
