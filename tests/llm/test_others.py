"""Vectors, pages, components and the pipeline against brute force."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import _exec, components, hosts, nearest, neardup, warc
from framelake.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    near = [base[i % 20] + rng.normal(size=16) * s for i, s in zip(range(80), np.tile([0.02, 0.1, 0.3, 0.45], 20))]
    same = [base[3]] * 15
    x = np.concatenate([base, near, same]).astype(np.float32)
    rows = [(int(i * 7 - 30), v.tolist()) for i, v in enumerate(x)]
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] * 16), (5006, [1.0, 2.0]), (5007, []), (5008, [1.0, 2.0]), (None, [1.0] * 16)]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, key int").repartition(3)


def links_by_brute_force(ids, x):
    """Numbers of links and classes at a cosine of 0.9."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return near, dict(zip(ids, label.tolist()))
        label = new


@pytest.mark.parametrize("block", [16384, 7])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows, odd = vectors()
    got = neardup.near_duplicates(frame(spark, [*rows, *odd, rows[4]]), 0.9, recall=0.9999).toPandas()
    ids = [i for i, _ in rows]
    near, comp = links_by_brute_force(ids, np.array([v for _, v in rows], float))
    g = got[got.vec_id.notna()].set_index("vec_id")
    assert len(got) == len(rows) + len(odd)
    assert {i: g.n_links[i] for i in ids} == dict(zip(ids, near.sum(axis=1)))
    assert {i: g.component_id[i] for i in ids} == comp
    assert all(g.n_links[i] == 0 and g.kept[i] for i in (5001, 5002, 5003, 5004, 5005, 5007))
    assert g.n_links[5006] == 1 and g.component_id[5008] == 5006


def test_lengths_that_meet_in_a_bucket(spark, monkeypatch):
    """All bucket numbers forced to be equal: lengths are still kept apart, and no link is lost or counted twice."""
    monkeypatch.setattr(neardup.Tables, "keys", lambda self, code, tables: np.zeros((len(code), tables), np.int32))
    keyed = neardup._keys(4, 3, 4.0, 1)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(5, 6)), 4, axis=0) + rng.normal(size=(20, 6)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0, 2.0]), (101, [2.0, 4.1]), (102, [1.0])]
    df = frame(spark, rows).select("vec_id", F.lit(1).cast("long").alias("weight"), "embedding")
    batches = [b for b in keyed(df.toArrow().to_batches())]
    out = []
    for t in range(3):
        for d, ids in ((6, range(20)), (2, (100, 101)), (1, (102,))):
            for b in batches:
                for i, code in zip(b.column("vec_id").to_pylist(), b.column("code").to_pylist()):
                    if i in ids and len(code) == 2 * d:
                        out.append((t, 0, d, 0, 0, 0, i, 1, code))
    out.sort(key=lambda r: r[:4])
    table = pa.table(dict(zip(("t", "key", "d", "a", "b", "own", "vec_id", "weight", "code"), map(list, zip(*out)))))
    links = [r for b in neardup._links(0.9, 4, 3, 4.0, 1)(table.to_batches()) for r in b.to_pylist()]
    near, _ = links_by_brute_force(list(range(20)), x)
    n = {}
    for r in links:
        n[r["vec_id"]] = n.get(r["vec_id"], 0) + r["n"]
    assert {i: n.get(i, 0) for i in range(20)} == dict(enumerate(near.sum(axis=1))) and n[100] == n[101] == 1 and 102 not in n


def test_buckets_can_be_worked_out_again():
    rng = np.random.default_rng(4)
    code = rng.integers(-32767, 32768, (500, 64)).astype(np.int16)
    of = neardup.Tables(64, 5, 12, 4.0, 3)
    every = of.keys(code, 12)
    for some in (slice(0, 1), slice(7, 300), slice(499, 500)):
        for tables in (1, 5, 12):
            assert (of.keys(code[some], tables) == every[some, :tables]).all()
    assert (np.abs(of.planes).sum(axis=0) * 32767 + of.shift < 2**53).all()


def test_recall_of_near_duplicates_as_registered(spark):
    """Pairs right above the threshold at the default recall; pairs below it are never links."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.88, 0.92, (len(base), 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]).astype(np.float32)
    got = neardup.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas().set_index("vec_id")
    near, _ = links_by_brute_force(list(range(len(x))), x.astype(float))
    want = near.sum(axis=1)
    assert (got.n_links.sort_index().to_numpy() <= want).all() and want.sum() > 2000
    assert got.n_links.sum() >= 0.95 * want.sum()


def test_pairs_inside_the_margin_are_checked_exactly(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    rows = []
    for j in range(300):
        side = rng.normal(size=64)
        side -= side @ base * base
        c = 0.9 + rng.uniform(-2e-5, 2e-5)
        rows.append((j + 1, (7 * (c * base + np.sqrt(1 - c * c) * side / np.linalg.norm(side))).tolist()))
    rows.append((0, base.tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neardup.near_duplicates(df, recall=0.999999).toPandas().set_index("vec_id")
    x = np.array([v for _, v in rows])
    near, comp = links_by_brute_force([i for i, _ in rows], x)
    assert {i: int(got.n_links[i]) for i, _ in rows} == {i: int(n) for (i, _), n in zip(rows, near.sum(axis=1))}
    assert {i: int(got.component_id[i]) for i, _ in rows} == comp and 50 < got.n_links[0] < 250


@pytest.mark.parametrize(("rows_per_block", "cell", "first"), [(32768, 4096, 2), (40, 4096, 2), (32768, 20, 1), (15, 30, 2)])
def test_nearest(spark, rows_per_block, cell, first, monkeypatch):
    for name, value in (("ROWS", rows_per_block), ("CELL", cell), ("FIRST", first)):
        monkeypatch.setattr(nearest, name, value)
    rows, odd = vectors(2)
    every = frame(spark, [*rows, *odd, rows[4]])
    asks = [rows[0], rows[3], rows[121], rows[-1], odd[1], odd[5]]
    got = nearest.nearest_neighbours(every, frame(spark, asks), 10).toPandas()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for i, v in asks[:4]:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
        g = got[got.query_id == i].sort_values("rank")
        assert g.vec_id.tolist() == ids[want].tolist() and g["rank"].tolist() == list(range(1, 11))
        np.testing.assert_allclose(g.score, d[want], rtol=1e-12)
    assert set(got.query_id) == {i for i, _ in asks[:4]} | {5006}
    assert got[got.query_id == 5006].vec_id.tolist() == [5008]


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_on_random_vectors(spark, clusters, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 250)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    if clusters:
        x += 3 * rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))]
    x = x.astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = nearest.nearest_neighbours(df, df.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for i in range(0, 3000, 100):
        d = ((x.astype(float) - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got[got.query_id == i].vec_id))
    assert hit >= 0.99 * 300


def test_empty_vectors(spark):
    none = frame(spark, [])
    assert neardup.near_duplicates(none).count() == 0
    assert nearest.nearest_neighbours(none, none).count() == 0


@pytest.mark.parametrize("small", [1_000_000, 0, 100])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL", small)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    comp = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a in comp and b in comp:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


PAGES = [(1, "http://a.b.com/x?y", "<p>one</p>"), (2, "https://A.b.com/x", "<p>one</p>"), (3, "no scheme", None), (4, None, ""), (5, "ftp://é.org/\r\nWARC/1.0", "é\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"), (6, "x://", "z" * 300_000), (7, "http://b.com", "<p>one</p>"), (None, "http://c.net/a", "<p>one</p>"), (7, "http://b.com", "<p>one</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id bigint, url string, html string, bytes int, digest string").repartition(3)


@pytest.mark.parametrize(("least", "long", "entries"), [(0, 256 << 10, 512), (1, 10, 1)])
def test_warc(spark, least, long, entries, monkeypatch):
    monkeypatch.setattr(warc, "LONG", long)
    monkeypatch.setattr(warc, "ENTRIES", entries)
    got = warc.round_trip(pages(spark, PAGES), least).toPandas()
    want = Counter()
    by = defaultdict(list)
    for i, _, h in PAGES:
        by[h or ""].append(i)
    for i, _, h in PAGES:
        b = (h or "").encode()
        top = max(x for x in [*by[h or ""], -1] if x is not None)
        again = i is not None and len(b) >= least and i < top
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None)] += 1
    clean = lambda x: None if x != x else int(x)
    assert Counter((clean(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, clean(r.refers_to)) for r in got.itertuples()) == want
    assert got.url_key.tolist() == sorted(got.url_key)


def test_warc_empty(spark):
    assert warc.round_trip(pages(spark, PAGES).limit(0)).count() == 0


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randint(0, 20), r.random()) for _ in range(r.choice([0, 1, 7, 30]))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(v for x in runs for v in x)


def test_merge_holds_few_blocks_only():
    """However long the runs, only blocks that overlap are open."""
    r = random.Random(4)
    opened = closed = most = 0

    def entries(keys):
        nonlocal opened, closed, most
        opened += 1
        most = max(most, opened - closed)
        yield from keys
        closed += 1

    runs = [sorted((r.random(), i, j) for j in range(4000)) for i in range(5)]
    blocks = sorted((run[i][0], run[i : i + 20]) for run in runs for i in range(0, 4000, 20))
    got = list(warc.merged(((k, entries(v)) for k, v in blocks), 4))
    assert got == sorted(x for run in runs for x in run) and len(blocks) == 1000
    assert most <= 40


def test_index_of_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    monkeypatch.setattr(warc, "ENTRIES", 5)
    r = random.Random(6)
    rows = [(i, f"http://h{r.randint(0, 3)}.com/{'hot' if i % 3 else r.randint(0, 40)}", f"<p>{r.randint(0, 200)}</p>" * r.randint(0, 9), f"2024-01-{r.randint(1, 28):02d} 00:00:00") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, f string").withColumn("fetched", F.to_timestamp("f")).repartition(5)
    path = warc.scratch(spark)
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path)
    index = got.collect()
    keys = [(x.url_key, x.date, x.page_id) for x in index]
    assert keys == sorted(keys) and sorted(x.page_id for x in index) == list(range(600)) and len({x.archive for x in index}) > 80
    archives = {x.path: __import__("gzip").decompress(x.content) for x in spark.read.format("binaryFile").load(path).collect()}
    for x in index:
        record = archives[x.archive][x.offset : x.offset + x.length]
        assert record.startswith(b"WARC/1.1") and f"<urn:framelake:page:{x.page_id}>".encode() in record and record.endswith(b"\r\n\r\n")


def test_plain_and_gzip_archives():
    import gzip

    rec = b"WARC/1.1\r\nContent-Length: 5\r\nA: b\r\n\r\nhello\r\n\r\n"
    for data in (rec * 2, gzip.compress(rec * 2), gzip.compress(rec) * 2):
        assert [(f["a"], b, at, n) for f, b, at, n in warc.records(data)] == [("b", b"hello", i * len(rec), len(rec)) for i in range(2)]
    with pytest.raises(ValueError):
        list(warc.records(rec[:-8]))


def test_urls(spark):
    urls = ["http://example.com/en/1", "http://WWW.example.com/en/1", "https://a.example.com/de", "http://x.net/es/a", "http://net/fr/", "http://y.net/en/", "http://com", "http://com/", "http://z.org/a?b://c", "a://b://c/d", None, "no", "", "http://h#f/en/", "http://h\n.com/\nx", "http://notexample.com/en/", "http://example.com:80/en/"]
    got = hosts.judge_urls(pages(spark, [(i, u, "") for i, u in enumerate(urls)]), RULES).toPandas().sort_values("page_id")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for u, r in zip(urls, got.itertuples(), strict=True):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:n].translate(lower), rest[n:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        assert r.verdict == rule[1] if rule[1] else r.verdict in ("allow", "block")
    assert hosts.judge_urls(pages(spark, []), RULES).count() == 0


def above(a, b, cut, n=20_000):
    """The chance of a beta variable to be above cut, as a sum over angles."""
    t = (np.arange(n) + 0.5) / n * np.pi / 2
    w = (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))
    w = np.exp(w - w.max())
    return w[np.sin(t) ** 2 > cut].sum() / w.sum()


def test_beta_tail():
    cases = [(0.5, 0.5, 0.5), (1, 1, 0.3), (2.5, 0.5, 0.5), (3.5, 0.5, 0.5), (10, 20, 0.5), (100, 90, 0.5), (0.7, 30, 0.02), (5, 1, 0.9), (1.5, 0.5, 0.5)]
    a, b, cut = np.array(cases).T
    for i in range(len(cases)):
        assert hosts.beta_above(a[i : i + 1], b[i : i + 1], cut[i])[0] == pytest.approx(above(a[i], b[i], cut[i]), abs=2e-3)
    assert hosts.beta_above(np.array([5e8]), np.array([5e8]), 0.5)[0] == pytest.approx(0.5, abs=1e-5)


def test_reputation_shrinks(spark):
    rows = [("a.bad.org", 1)] * 40 + [("b.bad.org", 1)] * 2 + [("c.bad.org", None)] + [("a.good.org", 0)] * 40 + [("b.good.org", None)] * 3 + [("d.other.org", None)] + [(f"h{i}.d{i}.net", 1) for i in range(50)] + [("x.unknown.net", None), ("10.0.0.1", 1), ("10.0.0.2", None), ("localhost:80", 0)]
    m = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert m["a.bad.org"].mean > 0.9 > 0.1 > m["a.good.org"].mean
    assert m["c.bad.org"].mean > m["d.other.org"].mean > m["b.good.org"].mean
    assert m["c.bad.org"].above <= m["a.bad.org"].above
    for r in m.values():
        assert r.above == pytest.approx(above(r.a, r.b, 0.5), abs=2e-3) and r.mean == pytest.approx(r.a / (r.a + r.b))
    assert (m["x.unknown.net"].n, m["x.unknown.net"].n_domain) == (0, 0) and m["c.bad.org"].n_domain == 42
    # addresses have nothing to do with each other
    assert m["10.0.0.2"].n_domain == 0 and m["10.0.0.1"].n_domain == 1


def test_verdicts_need_evidence(spark):
    """Hosts whose pages are mostly blocked are blocked, hosts with a small part blocked and hosts nobody knows are not, at any number of pages."""
    for scale in (1, 10):
        urls = [f"http://h{i}.spam.net/es/{j}" for i in range(30) for j in range(4 * scale)] + [f"http://p{j}.mixed.net/fr/x" for j in range(scale)]
        urls += [f"http://large.net/{'es' if j == 7 else 'de'}/{j}" for j in range(1000)] + [f"http://mostly.net/{'de' if j % 10 == 7 else 'es'}/{j}" for j in range(40 * scale)]
        urls += ["http://h1.spam.net/x", "http://new.net/x", "http://z.org/x", "http://q.org/y", "http://www.good.com/x"] + [f"http://www.s{j}.org/" for j in range(20 * scale)]
        got = {r.page_id: r.verdict for r in hosts.judge_urls(pages(spark, [(i, u, "") for i, u in enumerate(urls)]), RULES).collect()}
        v = {u: got[i] for i, u in enumerate(urls)}
        assert v["http://h1.spam.net/x"] == "block"
        assert all(x == ("block" if "/es/" in u else "allow") for u, x in v.items() if "large.net" in u)
        assert all(x == "block" for u, x in v.items() if "mostly.net" in u)
        assert v["http://new.net/x"] == v["http://z.org/x"] == v["http://q.org/y"] == v["http://www.good.com/x"] == "allow"
        assert all(x == "allow" for u, x in v.items() if ".org" in u)


def test_levels(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "1.2.3.4", "1.2.3.4:80", "h.com:8080", "a.b.c.d.e"]
    domain, suffix = hosts.levels(hosts.F.col("host"), ["co.uk"])
    got = {r.host: (r.d, r.s) for r in spark.createDataFrame([(n,) for n in names], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", ""), "x.y.com": ("y.com", "com"), "com": ("com", ""), "": ("", ""), "1.2.3.4": ("1.2.3.4", ""), "1.2.3.4:80": ("1.2.3.4", ""), "h.com:8080": ("h.com", "com"), "a.b.c.d.e": ("d.e", "e")}


@pytest.mark.parametrize("way", ["hot keys broadcast", "all merged"])
def test_joins_with_large_sides(spark, monkeypatch, way):
    monkeypatch.setattr(_exec, "fits", lambda df, rows=0: way == "hot keys broadcast" and rows == _exec.HOT_KEYS + 1)
    many = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(90)] + [(90, None), (91, "none")], "i int, k string")
    side = spark.createDataFrame([("a", 60, 1), *((f"k{i}", 1, i) for i in range(0, 90, 3)), ("other", 0, 5)], "k string, n int, v int")
    got = _exec.join_unique(many, side, ["k"], "n", hot=20)
    want = many.join(side.drop("n"), "k", "left")
    assert sorted(map(str, got.select("i", "k", "v").collect())) == sorted(map(str, want.select("i", "k", "v").collect()))


def test_sides_are_measured(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "i int, t string")
    assert _exec.fits(df, 50) and not _exec.fits(df, 49) and _exec.fits(df.limit(0))
    assert not _exec.fits(df.select(F.concat(*[F.repeat("t", 1000)] * 2).alias("t")))  # few rows, but 100 MB


def test_every_query_runs_on_whole_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "embeddings", "pages")}
    for name, table in (("op1_neardup", "embeddings"), ("op2_licenses", "documents"), ("op3_jaccard", "documents"), ("op4_warc", "pages"), ("op5_substrings", "documents"), ("op7_hosts", "pages"), ("op9_bpe", "documents"), ("op10_toxicity", "documents")):
        assert QUERIES[name](spark, SF).count() == n[table], name


def test_pipeline_on_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, ties and clashing columns, against brute force stage by stage."""
    import corpus_pipeline
    from tests.llm.test_documents import cut, row_classes

    stage = dict(corpus_pipeline.STAGES)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    r = random.Random(3)
    passage = " ".join(f"p{j}" for j in range(60))
    words = lambda n: " ".join(f"w{r.randint(0, 999)}" for _ in range(n))
    odd = [(None, "no id " + passage), (None, None), (900_001, None), (900_001, None), (900_002, ""), (900_003, words(30_000)), (900_004, passage + " " + words(50)), (900_004, words(40) + " " + passage), (900_005, words(30) + " " + passage), (900_005, words(70)), (900_006, real[0][1]), (900_006, real[0][1])]
    rows = [*real, *odd]
    names = "doc_id bigint, text string, _id bigint, _gone bigint, _kept string, _toxic int, component_id bigint, n_chars int"
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 3, k, len(t or "")) for k, (i, t) in enumerate(rows)], names).repartition(3)
    clean = stage["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    left = sorted((x.component_id, x.doc_id, x.text) for x in clean.collect())
    assert len(left) > 60 and {k for k, _, _ in left} >= {k for k, (i, _) in enumerate(rows) if i is None or i > 900_000 and i != 900_006}
    one = stage["jaccard join"](spark, clean, SF)
    assert one.schema == docs.schema
    want = [x for x, (i, _, c, _) in zip(left, row_classes([x[1:] for x in left], 5, 80, 100), strict=True) if i == c]
    assert sorted((x.component_id, x.doc_id, x.text) for x in one.collect()) == want
    short = stage["substring dedup"](spark, one, SF)
    assert short.columns == docs.columns
    expect = sorted((k, i, kept if n else t) for (k, i, t), (_, n, kept) in zip(want, cut([x[1:] for x in want], 50), strict=True))
    assert sorted((x.component_id, x.doc_id, x.text) for x in short.collect()) == expect
    assert expect != want
    packed = stage["packing"](spark, short, SF).toPandas()
    assert len(packed) >= len(expect) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_on_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_documents import cut, classes, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    rows = {r.doc_id: r.text for r in clean.collect()}
    one = stage["jaccard join"](spark, clean, SF)
    assert one.schema == docs.schema
    sets = {i: shingles(t, 5) for i, t in rows.items()}
    want = classes(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert {r.doc_id for r in one.collect()} == {i for i in rows if want[i] == i}
    short = stage["substring dedup"](spark, one, SF)
    assert short.columns == docs.columns
    left = [(i, rows[i]) for i in rows if want[i] == i]
    assert {r.doc_id: r.text for r in short.collect()} == {i: kept if n else t for (i, t), (_, n, kept) in zip(left, cut(left, 50), strict=True)}
    packed = stage["packing"](spark, short, SF).toPandas()
    assert set(packed.doc_id) == {i for i, _ in left} and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
