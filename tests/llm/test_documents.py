"""Operators on texts against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import bpe, jaccard, licenses, packing, substrings, toxicity
from framelake.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, part int, keys string, found string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=3, n=60):
    r = random.Random(seed)
    words = ["ab", "Cd", "é", "EÉ", "x-y", "日本", "ß.", "q", "zz", "The", "of", "and", "\x1c", "\xa0", "w1", "w2", "w3"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.randint(0, 120))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n // 3):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "new" + str(r.randint(0, 99))
        out.append("\t".join(w[:40]) + "\n" + "  ".join(w[40:]))
    for _ in range(n // 3):
        a, b = r.choice(base).split(" "), r.choice(base).split(" ")
        out.append(" ".join(a[:30] + b[:50] + a[:25]))
    long = " ".join(r.choice(words) for _ in range(5000))
    return [*out, None, "", "   ", "one", "one two", "one two three", "one two three", "a b c d", "A B C D", long, long + " end"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", 1, "k", "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    t = texts()
    order = list(range(len(t)))
    random.Random(1).shuffle(order)
    return [(i - 5, t[j]) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, [*rows, rows[0], rows[7], (None, "null id a b c d e f")]).repartition(3).cache()


def classes(sets, linked):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def shingles(text, k):
    w = SPACE.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def row_classes(every, k, num, den):
    """By row: size of its set, the smallest id of its class, and its number of links."""
    sets = [shingles(t, k) if i is not None else set() for i, t in every]
    linked = lambda a, b: den * len(a & b) >= num * len(a | b)
    root = classes(dict(enumerate(sets)), linked)
    low = defaultdict(list)
    for x, (i, _) in enumerate(every):
        low[root[x]].append(i)
    links = [sum(x != y and bool(a and b) and linked(a, b) for y, b in enumerate(sets)) for x, a in enumerate(sets)]
    return [(i, len(shingles(t, k)), None if i is None else min(low[root[x]]), links[x]) for x, (i, t) in enumerate(every)]


def whole(x):
    return None if x is None or x != x else int(x)


def near_copies(n=25, first=1000):
    return [(first + i, " ".join(f"v{j}" if j != 3 * i else "w" for j in range(60 + i % 2))) for i in range(n)]


JOINS = [(4, 85, 100, 4096), (5, 80, 100, 4096), (4, 50, 100, 5), (4, 85, 100, 5), (2, 97, 100, 5), (1, 10, 100, 4096)]


@pytest.mark.parametrize(("k", "num", "den", "block"), JOINS)
def test_jaccard(spark, rows, k, num, den, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    every = [*repeated(rows), *near_copies(), (2000, rows[3][1]), (2001, rows[3][1])]
    got = jaccard.jaccard_classes(frame(spark, every).repartition(3), k, num, den).collect()
    assert Counter((whole(r.doc_id), r.n_shingles, whole(r.component_id)) for r in got) == Counter(x[:3] for x in row_classes(every, k, num, den))


def test_jaccard_judges_repeated_ids_by_their_own_text(spark):
    a, b = " ".join(f"a{j}" for j in range(40)), " ".join(f"b{j}" for j in range(60))
    got = jaccard.jaccard_classes(frame(spark, [(1, b), (1, a), (2, a + " z"), (0, b + " z")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 57, 0), (1, 36, 1), (1, 56, 0), (2, 37, 1)]
    kept = jaccard.keep_one(frame(spark, [(1, b), (1, a), (2, a + " z"), (0, b + " z")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, b + " z"), (1, a)]


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 4096), (4, 50, 100, 5)])
def test_jaccard_links(spark, rows, k, num, den, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    every = [*repeated(rows), *near_copies(), (2000, rows[3][1])]
    got = jaccard.jaccard_links(frame(spark, every).repartition(3), k, num, den).collect()
    want = Counter((i, n, links) for i, n, _, links in row_classes(every, k, num, den))
    assert Counter((whole(r.doc_id), r.n_shingles, r.n_links) for r in got) == want and max(x[2] for x in want) > 5


def test_near_sets_take_over_answers():
    r = np.random.default_rng(6)
    probes = sets_seen = 0
    for num, den in [(85, 100), (80, 100), (50, 100), (98, 100)]:
        for _ in range(12):
            sets = []
            for base in range(3):
                core = r.choice(400, 150, replace=False) + 100 * base
                for _ in range(25):
                    s = core.copy()
                    swap = r.choice(150, r.integers(0, r.choice([3, 12, 30])), replace=False)
                    s[swap] = r.integers(1000, 1060, len(swap))
                    sets.append(np.unique(s).astype(np.uint64))
            ids = r.permutation(len(sets)).tolist()
            got, n = jaccard.link_classes(ids, sets, num, den)
            plain = {i: set(s.tolist()) for i, s in zip(ids, sets)}
            want = classes(dict(sorted(plain.items())), lambda a, b: den * len(a & b) >= num * len(a | b))
            assert dict(zip(ids, got)) == want
            # two sides: pairs inside a side do not count
            asks = [bool(x) for x in r.integers(0, 2, len(sets))]
            side = dict(zip(ids, asks))
            got, _ = jaccard.link_classes(ids, sets, num, den, None, asks)
            tagged = {i: (side[i], s) for i, s in sorted(plain.items())}
            across = classes(tagged, lambda a, b: a[0] != b[0] and den * len(a[1] & b[1]) >= num * len(a[1] | b[1]))
            found = dict(zip(ids, got))
            # near sets of one side link as well, so classes may only be joined further, by links that are true
            assert all(found[i] == found[across[i]] for i in ids) and all(want[i] == want[found[i]] for i in ids)
            if num < 95:
                probes, sets_seen = probes + n, sets_seen + len(sets)
    assert probes < 0.75 * sets_seen


def test_jaccard_keeps_one(spark, rows):
    every = [*repeated(rows), *near_copies()]
    kept = jaccard.keep_one(frame(spark, every).repartition(3), 4, 85, 100)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = Counter((i, t) for (i, t), (_, _, c, _) in zip(every, row_classes(every, 4, 85, 100), strict=True) if i == c)
    assert Counter((whole(r.doc_id), r.text) for r in kept.collect()) == want


def test_clashing_names(spark):
    t = " ".join(f"a{j}" for j in range(60))
    names = "doc_id int, text string, _gone int, _hash string, `a.b` int, component_id int, low int, _toxic int"
    docs = spark.createDataFrame([(i, t + " z" * (i % 2), 1, "h", i, 7, 8, 9) for i in range(4)], names)
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema and [r.doc_id for r in kept.collect()] == [0]


def cut(rows, window):
    """For each row (not id): number of words, of removed ones, and the kept text."""
    seen = {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        w = SPACE.findall(t)
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated(rows):
    """Rows that repeat ids: with the same text, with others (shorter, longer, null), and without an id."""
    long = " ".join(f"r{j}" for j in range(80))
    odd = [(9001, long), (9002, f"x {long} y one"), (9002, " ".join(f"other{j}" for j in range(80))), (9002, "z"), (9002, None), (9001, "x y"), (9003, long), (9003, long), (9003, f"{long} {long}")]
    return [*rows, rows[0], rows[7], *odd, (rows[3][0], rows[9][1]), (None, "null id a b c d e f"), (None, long)]


def cut_rows(df):
    return Counter((None if r.doc_id is None else int(r.doc_id), r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("window", [1, 3, 13, 50, 70])
def test_substrings(spark, rows, window):
    every = repeated(rows)
    got = cut_rows(substrings.remove_repeats(frame(spark, every).repartition(3), window))
    assert got == Counter((i, *x) for (i, _), x in zip(every, cut(every, window), strict=True))


@pytest.mark.parametrize("hot", [64, 1])
def test_substrings_in_small_flushes(spark, rows, monkeypatch, hot):
    from framelake.llm import _shared

    monkeypatch.setattr(_shared, "FLUSH", 50)
    monkeypatch.setattr(substrings, "FLUSH", 50)
    monkeypatch.setattr(_shared, "HOT_FLUSHES", hot)  # with 1 all shared anchors are hot
    every = repeated(rows)
    got = cut_rows(substrings.remove_repeats(frame(spark, every).coalesce(1), 13))
    assert got == Counter((i, *x) for (i, _), x in zip(every, cut(every, 13), strict=True))


def naive_parse(key, doc, first):
    """Greedy longest factors by trying every reference: (start, length), and each one's possible references."""
    seg = [(d, list(range(a, b))) for d, a, b in zip(doc, first, first[1:])]
    out = []
    for d, places in seg:
        p = 0
        while p < len(places):
            best, refs = 0, set()
            for e, others in seg:
                for q in range(len(others)) if e < d else ():
                    n = 0
                    while p + n < len(places) and q + n < len(others) and key[places[p + n]] == key[others[q + n]]:
                        n += 1
                    if n > best:
                        best, refs = n, set()
                    if n == best and n:
                        refs.add(others[q])
            if best:
                out.append((places[p], best, refs))
            p += max(best, 1)
    return out


def test_parse_finds_the_longest_factors():
    r = np.random.default_rng(4)
    for _ in range(300):
        size = r.integers(1, 12, r.integers(1, 14))
        first = np.concatenate(([0], np.cumsum(size)))
        key = r.integers(0, r.choice([2, 3, 8, 40]), first[-1]).astype(np.uint64)
        doc = r.integers(0, r.choice([2, 5, 20]), len(size))
        start, length, source = substrings.parse(key, doc, first)
        want = naive_parse(key.tolist(), doc.tolist(), first.tolist())
        assert [(int(a), int(n)) for a, n in zip(start, length)] == [(a, n) for a, n, _ in want]
        assert all(int(q) in refs for q, (_, _, refs) in zip(source, want))


def test_factors_refer_to_their_source(spark, rows):
    every = [*rows, (700, "s " + " ".join(f"r{j}" for j in range(40))), (701, " ".join(f"r{j}" for j in range(20)) + " q " + " ".join(f"r{j}" for j in range(20, 40)))]
    text = {i: SPACE.findall(t or "") for i, t in every}
    found = substrings.find_factors(frame(spark, every).repartition(3), 13).collect()
    cover = defaultdict(set)
    for f in found:
        words = text[f.doc_id][f.start : f.start + f.length]
        other = text[f.source_id]
        assert f.source_id < f.doc_id and f.length >= 13 and len(words) == f.length
        assert any(other[j : j + f.length] == words for j in range(len(other)))
        cover[f.doc_id] |= set(range(f.start, f.start + f.length))
    want = {i: n for (i, _), (_, n, _) in zip(every, cut(every, 13), strict=True) if n}
    assert {i: len(x) for i, x in cover.items()} == want and len(found) > 10


def test_cut_documents_leaves_the_rest_alone(spark, rows):
    every = repeated(rows)
    names = "doc_id bigint, text string, _id string, _gone int, _kept string, `a.b` int, rest string, n_chars int, row int, found binary"
    docs = spark.createDataFrame([(i, t, str(k), k, "k", k, "r", len(t or ""), 1, b"x") for k, (i, t) in enumerate(every)], names)
    out = substrings.cut_documents(docs.repartition(3), 13)
    assert out.columns == docs.columns
    got = {r._gone: r for r in out.collect()}
    assert len(got) == len(every)
    for k, ((i, t), (_, n, kept)) in enumerate(zip(every, cut(every, 13), strict=True)):
        r = got[k]
        assert (r.doc_id, r.text, r._id, r["a.b"], r.n_chars) == (i, kept if n else t, str(k), k, len(kept if n else t or ""))


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 300, with_ids=True).toPandas()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    one = got[got.doc_id.notna()].drop_duplicates(["doc_id", "piece"])
    for i, g in one.groupby("doc_id"):
        g = g.sort_values("piece")
        ids = want[i]
        assert np.concatenate([np.frombuffer(x, "<u4") for x in g.ids]).tolist() == ids
        assert g.length.max() <= 300 and (g.length.iloc[1:] == 300).all() and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    n = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 300
        n += 1
    assert n <= -(-got.length.sum() // 300) + 1
    assert len(got) == len(one) + sum(-(-len(want[rows[j][0]]) // 300) for j in (0, 7)) + 1


def test_dominance_never_needs_more_bins():
    for seed in range(150):
        r = random.Random(seed)
        room = r.choice([10, 20, 50, 2048])
        counts = Counter(r.randint(1, room) for _ in range(r.choice([1, 4, 7, 9])))
        fixed, rest = packing.reduce_by_dominance(dict(counts), room)
        used = Counter(w for items, n in fixed for w in items for _ in range(n)) + Counter(rest)
        assert used == counts and all(sum(items) <= room for items, _ in fixed)
        bins = lambda c: least_bins(tuple(sorted(Counter(c).elements(), reverse=True)), room)
        assert sum(n for _, n in fixed) + bins(rest) == bins(counts)


def least_bins(items, room):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[i] <= room:
                rest = list(bins)
                rest[rest.index(b)] += items[i]
                put(i + 1, rest)
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


ODD = ["", "<|endoftext|>", "a <|endoftext|> b", " a", "a ", "a  b", "\n\n a\n \nb 's it's ", "Σας ΣΑΣ İx", "é̀ ﬁ", "a\x1cb\x1d c\x85d\xa0e f", "12345 x7y", "<|startoftext|>Hi<|endoftext|>", "''s 'S '", "aaaaaaa aaaa baaab", "  ", "\t", "日本語 😀👍🏽", "a\u200bb", "x" * 3000, "I'll we've"]


def odd_texts():
    r = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "1", "٣", "é", "e\u0301", "ß", "Σ", "\x1c", "\xa0", "\u3000", ".", "!?", "<|endoftext|>", "日", "😀", "İ", "\r\n", "\t"]
    return ODD + ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(1500)]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), packing.ByteBpe(tokenizer("byte_bpe_50k.json"))
    t = odd_texts()
    assert own.encode(t) == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]


def test_word_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t = [*odd_texts(), None]
    got = bpe.encode_documents(frame(spark, list(enumerate(t))), tokenizer("word_bpe_49k.json")).toPandas().sort_values("doc_id")
    for x, n, ids, dec in zip(t, got.n_tokens, got.ids, got.decoded, strict=True):
        e = tok.encode(x or "", add_special_tokens=False)
        assert (n, ids, dec) == (len(e.ids), " ".join(map(str, e.ids)), tok.decode(e.ids, skip_special_tokens=False))
    few = bpe.encode_documents(frame(spark, [(1, "Hello world")]), tokenizer("word_bpe_49k.json"), as_array=True).first()
    assert few.ids == tok.encode("Hello world", add_special_tokens=False).ids


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(spark, rows):
    extra = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License GNU general-public\nLICENSE mit license", "CC BY cc by-sa 4.0 ccby", "gnu general public", "É mit license", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    every = [*rows, *((1000 + i, t) for i, t in enumerate(extra)), (None, "mit license"), rows[0]]
    got = licenses.scan_licenses(frame(spark, every)).toPandas()
    want = Counter()
    for i, t in every:
        w = ALNUM.findall((t or "").translate(ASCII_LOWER))
        at, names = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hit = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            at += hit
            names |= {label} if hit else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)))] += 1
    clean = lambda x: None if x != x else int(x)
    assert Counter((clean(r.doc_id), r.n_words, r.n_base, clean(r.first_word), clean(r.last_word), r.base_labels) for r in got.itertuples()) == want
    labels = got[got.doc_id >= 1000].set_index("doc_id").labels
    assert labels[1000] == "apache" and labels[1006] == ""  # key phrases without their wording
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("template", [1, 2, 10])
def test_licence_in_half_of_all_files(spark, template):
    label, text, phrases = licenses.TEMPLATES[template]
    every = [(i, f"{text} {phrases[0]} own{i} words{i}" if i % 2 else f"own{i} words{i} of another kind") for i in range(80)]
    got = licenses.scan_licenses(frame(spark, every)).toPandas().set_index("doc_id")
    assert all(label in got.labels[i].split(",") for i in range(1, 80, 2))
    assert (got.score[1::2] == 1).all() and (got.labels[::2] == "").all() and (got.score[::2] == 0).all()


def covered(w, t):
    """For each shift the share of a wording that stands there, give or take SLACK words; by the definition."""
    own = {(s, k) for j, x in enumerate(w) for k, y in enumerate(t) if x == y for s in range(j - k - licenses.SLACK, j - k + licenses.SLACK + 1)}
    return {s: n / len(t) for s, n in Counter(s for s, _ in own).items() if n / len(t) >= licenses.SHARE}


def licensed(text):
    w = (text or "").split()
    at = lambda p: [j for j in range(len(w)) if w[j : j + len(p)] == p]
    want = {label for p, label in licenses.BASE.items() if at(p.split())}
    score = 0.5 if want else 0
    for label, wording, phrases in licenses.TEMPLATES:
        t = wording.split()
        shifts, keys = covered(w, t), [j for p in phrases for j in at(p.split())]
        best = max(shifts.values(), default=0)
        if any(s - licenses.NEAR <= j <= s + len(t) + licenses.NEAR for s in shifts for j in keys):
            want.add(label)
            score = max(score, 0.5 + 0.5 * best)
        else:
            score = max(score, 0.5 * best)
    return ",".join(sorted(want)), score


def test_licences_in_files_with_many(spark):
    r = random.Random(5)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    keys = [p for _, _, ps in licenses.TEMPLATES for p in ps]
    many = " filler ".join(texts + keys)
    some = [" filler ".join(r.sample(texts + keys, r.randint(1, 8)) + ["w" + str(i)]) for i in range(40)]
    half = [" ".join(t.split()[r.randint(0, 20) :]) + " " + " ".join(r.sample(many.split(), r.randint(0, 60))) for t in texts * 4]
    holes = []
    for t in texts * 3:
        w = t.split()
        for _ in range(r.randint(0, 12)):
            j = r.randrange(len(w))
            w[j : j + r.randint(0, 2)] = r.choice([[], ["new"], ["more", "new"]])
        holes.append("before " * r.randint(0, 5) + " ".join(w) + " after" * r.randint(0, 70) + " " + r.choice(keys))
    odd = "to any person obtaining a copy of this software and associated documentation files" + " boost unencumbered sharealike mozilla attribution unlicense lesser apache compliance redistribution binary retain domain commons source form terms" * 2
    every = list(enumerate([many, odd, None, "", *some, *half, *holes]))
    got = licenses.scan_licenses(frame(spark, every)).toPandas().set_index("doc_id")
    labels = Counter()
    for i, text in every:
        want, score = licensed(text)
        assert got.labels[i] == want and got.score[i] == pytest.approx(score), text
        labels.update(want.split(","))
    assert 3 < labels["mit"] < len(every)


def test_wording_and_key_phrase_are_both_needed(spark):
    rows = []
    for i, (_, wording, phrases) in enumerate(licenses.TEMPLATES):
        key = phrases[0]
        whole = wording if any(p in wording for p in phrases) else f"{wording} {key}"
        words, own = whole.split(), next(p for p in phrases if p in whole)
        bare = wording
        for p in phrases:
            bare = bare.replace(p, " ".join("x" * len(p.split())))
        changed = " ".join("other" if j % 9 == 4 and f" {w} " not in f" {own} " else w for j, w in enumerate(words))
        far = f"{bare} {'far ' * 200} {key}"
        moved = whole.replace(own, f"{own} inserted")
        texts = [whole, f"we do not use {key} here", bare, f"Intro of a file. {whole.upper()}", changed, far, moved, f"{'own ' * 3000}{whole}"]
        rows += [(100 * i + j, t) for j, t in enumerate(texts)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert [label in got[100 * i + j] for j in range(8)] == [True, False, False, True, True, False, True, True], label


def test_all_templates_in_one_file_and_much_licence_text(spark):
    every = " ".join(f"{t} filler {' filler '.join(ps)}" for _, t, ps in licenses.TEMPLATES)
    words = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})
    r = random.Random(2)
    much = " ".join(r.choice(words) for _ in range(180_000))  # 1 MB
    copies = (licenses.TEMPLATES[1][1] + " ") * 2000
    got = licenses.scan_licenses(frame(spark, [(1, every), (2, "boost " * 5 + every), (3, much), (4, copies)])).collect()
    labels = {x.doc_id: set(x.labels.split(",")) for x in got}
    assert labels[1] == labels[2] and labels[1] >= {label for label, _, _ in licenses.TEMPLATES} and labels[4] == {"mit"}


def test_toxicity(spark):
    r = random.Random(2)
    words = ["the", "of", "house", "tree", "runs", "blue", "haus", "baum", "été"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(words) + str(r.randint(0, 50)) for _ in range(r.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["Nasty", "vile", "grimword" + str(i)]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "tree " * 30_000), (None, "vile vile vile")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = toxicity.score_documents(docs, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    score = got.set_index("doc_id").score
    right = sum((score[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    assert score[1000] == score[1001] < 0.3
    text = dict(rows)
    hits = Counter(text[x.doc_id].encode()[a:b].decode() for x in got[got.doc_id.notna()].itertuples() for a, b in zip(x.starts, x.ends))
    assert hits["vile"] > 50 and hits["Nasty"] > 50
    kept = toxicity.without_toxic(docs, model).toPandas()
    assert set(kept.doc_id.dropna()) == set(got[got.score < 0.3].doc_id.dropna()) and list(kept.columns) == docs.columns
    for few in (lab.limit(0), lab.where("toxic = 1")):
        flat = toxicity.score_documents(docs, toxicity.train(docs, few)).toPandas().score
        assert flat.nunique() == 1 and flat.between(0, 1).all()


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    for steps in (64, 3, 2):
        monkeypatch.setattr(toxicity, "STEPS", steps)
        sizes = [4, 0, 7, 1, 3, 9, 0]
        first = np.concatenate(([0], np.cumsum(sizes)))
        e, chain = rng.normal(size=first[-1]), rng.normal(size=5)
        p, counts = toxicity.marginals(e, first, chain)
        want = np.zeros(4)
        for a, n in zip(first, sizes):
            total, one, moved = 0.0, np.zeros(n), np.zeros(4)
            for bits in range(2**n) if n else ():
                y = [bits >> t & 1 for t in range(n)]
                s = y[0] * chain[1] + sum(y[t] * (e[a + t] + chain[0]) for t in range(n))
                s += sum({(0, 1): chain[2], (1, 0): chain[3], (1, 1): chain[4]}.get((y[t - 1], y[t]), 0) for t in range(1, n))
                total += np.exp(s)
                one += np.exp(s) * np.array(y)
                steps_taken = [y[0], *(sum((y[t - 1], y[t]) == m for t in range(1, n)) for m in ((0, 1), (1, 0), (1, 1)))]
                moved += np.exp(s) * np.array(steps_taken)
            if n:
                np.testing.assert_allclose(p[a : a + n], one / total, rtol=1e-9)
                want += moved / total
        np.testing.assert_allclose(counts, want, rtol=1e-9)


def test_scores_do_not_depend_on_the_batch(spark):
    r = random.Random(8)
    model = toxicity.Model((np.random.default_rng(3).normal(size=1 << toxicity.BITS)).astype(np.float32), np.array([-3.0, 0.3, 0.2, -0.4, 0.7]), np.array([-2.0, 1, 0.5, 0.2, 3]), float("nan"))
    rows = [(i, " ".join("w" + str(r.randint(0, 500)) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 200, 1000])))) for i in range(60)]
    rows += [(100, "long words " * 40_000), (101, "w1 " * 129)]
    every = {x.doc_id: x for x in toxicity.score_documents(frame(spark, rows).coalesce(1), model).collect()}
    other = {x.doc_id: x for x in toxicity.score_documents(frame(spark, rows[::-1]).repartition(7), model).collect()}
    assert every == other
    for i, t in rows:
        alone = toxicity.score_documents(frame(spark, [(i, t)]), model).first() if i % 7 == 0 else every[i]
        assert alone == every[i]


def test_the_fit_is_bounded_in_bytes(spark, monkeypatch):
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randint(0, 300)}" for _ in range(n))
    rows = [(i, words(10) + (" vile nasty " if i % 2 else " kind ") + words(20_000 if i in (4, 5) else 10)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    docs = frame(spark, [*rows, (6, "another text of six"), rows[7]])
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, *x: seen.append(texts) or fit(texts, *x))
    score = {x.doc_id: x.score for x in toxicity.score_documents(docs, toxicity.train(docs, labels, sample_bytes=8000)).collect()}
    assert sum(map(len, seen[0])) <= 8000 and len(seen[0]) == len(set(seen[0])) > 40
    assert sum((score[i] >= 0.3) == bool(i % 2) for i in range(80)) >= 68


def test_long_words_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), random.Random(9)
    words = ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "etaoinshrdlu", "aé日", "xyz0") for n in (5, 50, 3000, 9000)]
    texts = [*words, " ".join(words), "x " + words[2] + "'s " + words[3] + " y", *("".join(r.choice("abcde") for _ in range(r.randint(1, 40))) for _ in range(300))]
    for long in (bpe.LONG, 3):
        monkeypatch.setattr(bpe, "LONG", long)
        got, _ = bpe.WordBpe(tokenizer("word_bpe_49k.json")).encode(texts)
        assert got == [" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert jaccard.jaccard_classes(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert packing.pack_documents(none, tokenizer("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_documents(none, tokenizer("word_bpe_49k.json")).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


def test_digests_of_queries(spark):
    from framelake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op5_substrings"](spark, sf).collect()}
    assert got == {r.doc_id: hashlib.sha256(x[2].encode()).hexdigest() for r, x in zip(rows, cut([tuple(r) for r in rows], 13), strict=True)}
