"""Operator 4: WARC archives, and their index as an external k-way merge of locally sorted runs.

Writing: the record of a page is text (its payload is UTF-8), so archives are written by
Spark's text writer with the record end as line separator: any file system, gzip as a whole
file, committed task by task. Archives are ended after ``RECORDS`` records; pages of more than ``LONG`` bytes
get archives of their own, so an archive stays below ``RECORDS * LONG`` bytes or is one record. Equal payloads are
found by SHA-1 of the narrow columns alone; all but the one with the largest page_id become revisits without payload.

Reading: each archive is inflated and parsed as a stream (Content-Length, never a search),
and gives one run of the index, sorted by URL key and timestamp, that is written to the shared folder. The merge
reads the runs back in blocks of ``ENTRIES`` entries, cut where key ranges end; Spark sorts
the blocks of a key range by their first entry, and a loser tree merges them as they come: a block is opened when the merge
reaches its first entry, so a task holds the blocks that overlap at one place and not its key range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._exec import join_unique, parts, saved, scratch

END = "\r\n\r\n"
#: Records in one archive file, at most, and the payload from which on a record has its own.
RECORDS, LONG = 1000, 256 << 10
#: Entries of a block of the index, blocks that a merge takes in at a time, and sampled keys for each key range.
ENTRIES, BLOCKS, KEYS = 512, 16, 50
#: Key ranges at most, each a task that merges as a stream, and keys that are sampled for all of them.
RANGES, SAMPLE = 10_000, 200_000
_INDEX = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, url_key string, date string, archive string, offset bigint, length bigint"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1."""
    hexa = F.sha1(payload)
    five = [F.lpad(F.conv(F.substring(hexa, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*five)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _tidy(c: Column) -> Column:
    """Fit for a header line."""
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", " ")


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row of ``pages`` (page_id, url, html and, if there, a timestamp ``fetched``).

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id
    is the response and the others revisit it. A null html is an empty payload; rows with a
    null page_id are responses of their own, with a random record id. Rows that repeat a page_id give one record each, with
    the same record id.
    """
    when = F.date_format("fetched", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "fetched" in pages.columns else F.lit(date)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.coalesce(when, F.lit(date)).alias("date"))
    body = body.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", digest(F.encode("html", "UTF-8")))
    same = body.select("page_id", "digest", "bytes").where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("low"), F.count("*").alias("copies")).where("low < first_id").drop("low")
    both = join_unique(body, saved(same), ["digest"], "copies")
    again = (F.col("bytes") >= least) & (F.col("page_id") < F.col("first_id"))
    again = F.coalesce(again, F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:framelake:page:"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(key + ": "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))), line("WARC-Target-URI", _tidy(F.col("url"))),
        line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("first_id"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    def write(rows: DataFrame, records: int) -> None:
        rows.select(F.concat(head, block).alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)

    write(both.where(F.col("bytes") <= LONG), RECORDS)
    if body.where(F.col("bytes") > LONG).limit(1).count():
        write(both.where(F.col("bytes") > LONG), 1)


class _Bytes:
    """Reads from a gzip file of one or more members, or a plain one, piece by piece."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.gzip = data[:2] == b"\x1f\x8b"
        self.read = 0  # bytes given out so far
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 16)]
        self.at += len(piece)
        if not self.gzip:
            self.buffer += piece
            return True
        rest = bytes(piece)
        while rest:
            self.buffer += self.inflate.decompress(rest)
            rest = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        self.read += i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.read += n
        return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (lower-case names) and block of each record, and its offset and length in the inflated archive."""
    source = _Bytes(data)
    start = 0
    while (head := source.until(END.encode())) is not None:
        version, *lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != END.encode():
            raise ValueError("no record end")
        yield fields, block, start, source.read - start
        start = source.read


def url_key(url: str | None) -> str:
    """Host labels from the right, then the path: captures of a site stand together."""
    rest = (url or "").partition("://")[2].lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def _number(name: str | None) -> int | None:
    before, _, text = (name or "").rpartition(":")
    return int(text.rstrip(">")) if before.endswith(":page") else None


_TYPES = [pa.int64() if x.endswith("bigint") else pa.string() for x in _INDEX.split(", ")]


def _key(url_key: str, date: str, page_id: int | None) -> tuple[str, str, int]:
    return url_key, date, page_id if page_id is not None else -(1 << 64)


def _order(row: tuple) -> tuple[str, str, int]:
    """By URL key, timestamp and page, nulls first."""
    return _key(row[6], row[7], row[0])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for fields, block, at, length in records(data.as_py()):
                http, _, payload = block.partition(END.encode())
                size = int(http.lower().partition(b"content-length:")[2].partition(b"\r\n")[0])
                name = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != name):
                    raise ValueError(f"payload of {fields.get('warc-record-id')} does not fit its digest")
                url = fields.get("warc-target-uri")
                rows.append((_number(fields.get("warc-record-id")), size, name, kind, _number(fields.get("warc-refers-to")), url, url_key(url), fields.get("warc-date", ""), path, at, length))
            rows.sort(key=_order)  # this archive's run
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), _TYPES, strict=True)], _NAMES)


class LoserTree:
    """Merges sorted iterators: each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.lost = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and self.head[a] is not None
        return (self.head[a], a) < (self.head[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.lost[node]
            if other < 0:  # while it is built: waits here for the other side
                self.lost[node] = winner
                return
            if self._less(other, winner):
                self.lost[node], winner = winner, other
            node //= 2
        self.lost[0] = winner

    def head_of(self) -> tuple | None:
        """What comes next; None if nothing is left."""
        return self.head[self.lost[0]] if self.k else None

    def pop(self) -> tuple:
        w = self.lost[0]
        first, self.head[w] = self.head[w], next(self.runs[w], None)
        self._play(w)
        return first

    def rest(self) -> list[Iterator[tuple]]:
        """The runs that have something left."""
        return [chain([h], r) for h, r in zip(self.head, self.runs, strict=True) if h is not None]

    def __iter__(self) -> Iterator[tuple]:
        while self.head_of() is not None:
            yield self.pop()


_BLOCK = f"part int, url_key string, date string, page_id bigint, entries array<struct<{', '.join(x.replace(' ', ':') for x in _INDEX.split(', ')).replace(' ', '')}>>"


def _blocks(splits: list[tuple[str, str, int]]):
    """Blocks of sorted runs, with the key range that they belong to and their first entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True))
            keys = [_order(r) for r in rows]
            # A run ends with its archive; where a file is read in pieces, its pieces are runs.
            cuts = [0, *(i for i in range(1, len(rows)) if rows[i][8] != rows[i - 1][8]), len(rows)]
            out, first = [], [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                while s < e:
                    part = bisect_left(splits, keys[s])  # a range ends with its split
                    end = min(e, s + ENTRIES)
                    if part < len(splits):
                        end = bisect_right(keys, splits[part], s, end)
                    out.append((part, rows[s][6], rows[s][7], rows[s][0]))
                    first.append(end)
                    s = end
            if out:
                entries = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)), entries], ["part", "url_key", "date", "page_id", "entries"])

    return run


def merged(blocks: Iterator[tuple[tuple, list[tuple]]], at_once: int) -> Iterator[tuple]:
    """Entries (key, ...) in order, from blocks (first key, entries in order) that come by their first keys."""
    runs: list[Iterator[tuple]] = []
    after = next(blocks, None)
    while after is not None or runs:
        fresh = []
        while after is not None and len(fresh) < at_once:
            fresh.append(iter(after[1]))
            after = next(blocks, None)
        tree = LoserTree([*runs, *fresh])
        limit = after[0] if after is not None else None
        while (first := tree.head_of()) is not None and (limit is None or first[0] < limit):
            yield tree.pop()
        runs = tree.rest()  # what overlaps with blocks to come


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one key range: blocks come by their first entry."""

    def blocks() -> Iterator[tuple[tuple, list[tuple]]]:
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                entries = b.column("entries").slice(i, 1).flatten()
                rows = zip(*(x.to_pylist() for x in entries.flatten()), strict=True)
                listed = [(_order(r), n + j, r) for j, r in enumerate(rows)]
                n += len(listed)
                yield listed[0][0], listed

    out: list[tuple] = []
    for _, _, r in merged(blocks(), BLOCKS):
        out.append(r)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives below ``path``: one row for each record, in order of URL key and timestamp.

    Payload size and digest are those of the full payload; a response whose payload does not
    fit them is an error. ``offset`` and ``length`` are those of the record in the inflated archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    runs = saved(files.mapInArrow(_parse, _INDEX))
    n = min(RANGES, parts(runs, F.octet_length("url_key") + F.coalesce(F.octet_length("url"), F.lit(0)) + 150))
    keys = min(KEYS, SAMPLE // n)
    total = runs.count()
    share = F.pmod(F.xxhash64("url_key", "date", "page_id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, keys * n / max(1, total)))
    sample = sorted(_key(*r) for r in runs.where(share).select("url_key", "date", "page_id").limit(2 * keys * n).collect())  # to cut key ranges only
    splits = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    blocks = runs.mapInArrow(_blocks(splits), _BLOCK).repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("url_key", "date", "page_id")
    return blocks.select("entries").mapInArrow(_merge, _INDEX)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives of ``pages`` into the shared folder and reads them back."""
    path = scratch(pages.sparkSession)
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
