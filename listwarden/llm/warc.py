"""Web archives: writing captures as WARC files, reading them back, and one index in global order.

Writing. Every capture becomes a record of its own gzip member: a response with its payload, or, if
an equal payload of LEAST_REVISIT bytes or more belongs to a smaller capture_id, a revisit that
names that capture. Each task writes archives of its own into a folder that all executors share and
returns their names; only names that Spark has committed are read, so what a lost task or a repeated
attempt has left behind is no part of the result.

Reading. A task reads one archive record by record, digests the payloads and checks them against
the headers.

Index. Captures are ordered by URL key (host labels reversed, then path), time, and capture_id. The
captures of one archive are sorted into a run where they are read. Splitters are taken from a sample
of the runs' keys (about SAMPLE of each range); runs are cut there, and the pieces of one range are
merged by a loser tree, FAN_IN at a time. Ranges follow each other, so that the index as written is in
global order. The key of a capture is unique, so a URL with very many captures is cut as well.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import islice, takewhile
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.storage import shared_folder, stored
from listwarden.llm.words import slices

#: Smaller payloads are always written in full.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256_000_000
#: Captures of a range of the index, keys sampled from each, and runs merged at a time.
RANGE_ROWS, SAMPLE, FAN_IN = 250_000, 8, 256
#: Small tables are cut into as many ranges at least, if each has LEAST_ROWS captures.
LEAST_RANGES, LEAST_ROWS = 32, 512
#: A payload is hot above this share of the rows, and above HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 10_000, 1_000
_FEED, _READ = 16_384, 1 << 20
#: The format's version, and the profile of revisits.
_VERSION, _PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:capture:"
INDEX = ("urlkey string, stamp string, capture_id long, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, archive string, offset long, length long")
_FIELDS = pa.schema([
    ("urlkey", pa.string()), ("stamp", pa.string()), ("capture_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
Key = tuple[str, str, int, str, int]


# records

class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def encoded(record: Record) -> bytes:
    """The record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = (f"{_VERSION}\r\n{head}Content-Length: {len(record.block)}\r\n\r\n".encode(), record.block, b"\r\n\r\n")
    return b"".join([*map(pack.compress, parts), pack.flush()])


def decoded(raw: bytes) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers.pop("Content-Length", "-1"))
    if version != _VERSION or not found or rest[size:] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    return Record(headers, rest[:size])


def records(stream: io.RawIOBase | pa.NativeFile) -> Iterator[tuple[int, int, Record]]:
    """Offset, length and record of each gzip member, one at a time."""
    offset, view, at = 0, memoryview(b""), 0

    def more() -> bool:
        nonlocal view, at
        if at == len(view):
            view, at = memoryview(stream.read(_READ)), 0
        return len(view) > 0

    while more():
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not more():
                raise EOFError("the archive ends within a record")
            fed = view[at : at + _FEED]
            parts.append(unpack.decompress(fed))
            taken = len(fed) - len(unpack.unused_data)
            at, used = at + taken, used + taken
        yield offset, used, decoded(b"".join(parts))
        offset += used


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query; '-' without a URL."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # no URL by the standard: its text is the key
        return quote(url, safe=_PLAIN)
    if not host:
        return quote(url, safe=_PLAIN)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe=_PLAIN)


_PLAIN = "".join(map(chr, range(0x21, 0x7F)))


# writing

def with_revisits(captures: DataFrame) -> DataFrame:
    """capture_id, url, stamp, payload, payload_bytes, payload_digest and refers_to.

    refers_to is the smallest capture_id with an equal payload of LEAST_REVISIT bytes or more, null
    if that is the row's own or there is none; then payload is null, too. Null payload is empty.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    at = F.to_utc_timestamp(F.coalesce(F.col("captured"), F.timestamp_seconds(F.lit(0))), F.current_timezone())
    rows = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"), F.col("url").cast("string").alias("url"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(
        F.min("capture_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    groups = stored(groups)
    total = groups.select(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    is_hot = (F.col("n") > HOT_ROWS) & (F.col("n") > total / HOT_SHARE)
    # fewer than HOT_SHARE groups: each holds more than 1 / HOT_SHARE of the rows counted
    hot = F.broadcast(groups.filter(is_hot).select(F.col("payload_digest").alias("hot"), F.col("first").alias("hot_first")))
    cold = groups.filter(~is_hot).select(F.col("payload_digest").alias("cold"), F.col("first").alias("cold_first"))
    met = rows.join(hot, F.col("payload_digest") == F.col("hot"), "left")
    # rows that are settled or stand alone meet nothing, each under a key of its own
    key = F.when(F.col("hot").isNull() & (F.col("payload_bytes") >= LEAST_REVISIT), F.col("payload_digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("capture_id", "url", "stamp").cast("string")))
    met = met.withColumn("key", key).join(cold, F.col("key") == F.col("cold"), "left")
    first = F.coalesce("hot_first", "cold_first")
    refers = F.when(first.isNotNull() & ~F.col("capture_id").eqNullSafe(first), first)
    met = met.withColumn("refers_to", refers)
    return met.select(
        "capture_id", "url", "stamp", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "refers_to")


def _record(row: dict) -> Record:
    name = lambda x: f"<{_RECORD}{'-' if x is None else x}>"
    headers = {
        "WARC-Type": "response" if row["refers_to"] is None else "revisit", "WARC-Record-ID": name(row["capture_id"]), "WARC-Date": row["stamp"]}
    if row["url"]:
        headers["WARC-Target-URI"] = quote(row["url"], safe=_PLAIN)
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{row['payload_digest']}"}
    if row["refers_to"] is not None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": name(row["refers_to"])}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    return Record(headers, http + (row["payload"] or b""))


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (capture_id, url, captured, payload) below folder; rows (archive, size, records).

    The rows are stored, and name the archives that count. captured is a timestamp; null stands for
    1970. Characters of URLs outside printable ASCII are percent-encoded. Repeated rows are repeated
    records, rows with a null capture_id are records without a number; other columns are ignored. An
    empty table writes nothing.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        out, name, size, count, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for part in slices(batch, "payload"):
                    for row in part.to_pylist():
                        if out is None:
                            system.create_dir(root, recursive=True)
                            name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                            out = system.open_output_stream(f"{root}/{name}", compression=None)
                        data = encoded(_record(row))
                        out.write(data)
                        size, count = size + len(data), count + 1
                        if size >= ARCHIVE_BYTES:
                            out.close()
                            out = None
                            done.append((name, size, count))
            if out is not None:
                out.close()
                done.append((name, size, count))
                out = None
        finally:
            if out is not None:
                out.close()
        columns = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "size", "records"])

    return stored(with_revisits(captures).mapInArrow(work, "archive string, size long, records long"))


# reading and the index

def _entry(archive: str, offset: int, length: int, record: Record) -> dict:
    h = record.headers
    number = lambda name: None if (x := name[1:-1].removeprefix(_RECORD)) == "-" else int(x)
    http, found, payload = record.block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ", 1)[1].split("\r\n", 1)[0])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = h["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload at {offset} of {archive} is not what was written")
    stamp = h["WARC-Date"].translate(str.maketrans("", "", "-:TZ"))
    return {
        "urlkey": url_key(h.get("WARC-Target-URI")), "stamp": stamp, "capture_id": number(h["WARC-Record-ID"]), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": number(h["WARC-Refers-To"]) if kind == "revisit" else None,
        "archive": archive, "offset": offset, "length": length}


def _keys(run: pa.Table) -> list[Key]:
    """Order of captures: URL key, time, capture_id (none first), then the place of the record."""
    columns = [run.column(c).to_pylist() for c in ("urlkey", "stamp", "capture_id", "archive", "offset")]
    return [(u, s, -(1 << 63) - 1 if i is None else i, a, o) for u, s, i, a, o in zip(*columns, strict=True)]


def _packed(run: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(run)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def sorted_runs(manifest: DataFrame, folder: str, step: int) -> DataFrame:
    """One run per archive, sorted: run, rows, sample (about one key in `step`, as JSON), content."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    entries = (_entry(archive, *found) for found in records(stream))
                    parts = iter(lambda: pa.RecordBatch.from_pylist(list(islice(entries, 4_096)), _FIELDS), None)
                    run = pa.Table.from_batches(takewhile(len, parts), _FIELDS)
                keys = _keys(run)
                order = sorted(range(len(keys)), key=keys.__getitem__)
                run = run.take(pa.array(order, pa.int64()))
                sample = [json.dumps(k) for k in keys if zlib.crc32(repr(k).encode()) % step == 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive]), pa.array([len(keys)], pa.int64()), pa.array([sample], pa.list_(pa.string())), pa.array([_packed(run)], pa.binary())],
                    names=["run", "rows", "sample", "content"])

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000)).mapInArrow(work, "run string, rows long, sample array<string>, content binary")


class LoserTree:
    """Merges k sorted sequences: inner nodes hold the losers, so a step replays one path only."""

    def __init__(self, sources: Sequence[Sequence[Key]]):
        self.sources, self.k = sources, len(sources)
        self.at = [0] * self.k
        self.heads = [s[0] if s else None for s in sources]
        self.losers = [-1] * max(1, self.k)  # the place of the root holds the winner
        for i in range(self.k):
            self._replay(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Source and position of each key, in order."""
        while self.k and self.heads[i := self.losers[0]] is not None:
            place = self.at[i]
            yield i, place
            self.at[i] = place + 1
            source = self.sources[i]
            self.heads[i] = source[place + 1] if place + 1 < len(source) else None
            self._replay(i)


def merged(runs: list[pa.Table], fan_in: int = FAN_IN) -> pa.Table:
    """One sorted table of many, `fan_in` at a time."""
    while len(runs) > 1:
        runs = [_merged_once(runs[i : i + fan_in]) for i in range(0, len(runs), fan_in)]
    return runs[0]


def _merged_once(runs: list[pa.Table]) -> pa.Table:
    starts = [0]
    for run in runs:
        starts.append(starts[-1] + len(run))
    order = [starts[i] + place for i, place in LoserTree([_keys(run) for run in runs])]
    return pa.concat_tables(runs).take(pa.array(order, pa.int64()))


def _cut(splitters: list[Key]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs in pieces of one range each; a splitter is the last key of its range."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("run").to_pylist(), batch.column("content").to_pylist(), strict=True):
                run = _unpacked(content)
                keys = _keys(run)
                at = 0
                while at < len(keys):
                    number = bisect_left(splitters, keys[at])
                    stop = len(keys) if number == len(splitters) else bisect_right(keys, splitters[number], at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([name]), pa.array([_packed(run.slice(at, stop - at).combine_chunks())], pa.binary())],
                        names=["range", "run", "content"])
                    at = stop

    return work


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: the pieces of one range at a time."""
    number, pieces = None, []
    for batch in batches:
        for this, content in zip(batch.column("range").to_pylist(), batch.column("content"), strict=True):
            if this != number and pieces:
                yield from merged(pieces).combine_chunks().to_batches(10_000)
                pieces = []
            number = this
            pieces.append(_unpacked(content.as_py()))
    if pieces:
        yield from merged(pieces).combine_chunks().to_batches(10_000)


def capture_index(manifest: DataFrame, folder: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of the archives in global order: the columns of INDEX.

    Of a revisit, payload_bytes and payload_digest are those of the payload it stands for. The
    partitions of the result, and so the files it is written to, follow each other in that order.
    """
    total = manifest.select(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n
    least = min(LEAST_RANGES, -(-total // LEAST_ROWS))
    ranges = max(1, least, -(-total // range_rows))
    step = max(1, total // ranges // SAMPLE)
    runs = stored(sorted_runs(manifest, folder, step))
    sample = sorted(tuple(json.loads(r.key)) for r in runs.select(F.explode("sample").alias("key")).collect())  # about SAMPLE * ranges keys
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else []
    splitters = sorted(set(splitters))
    pieces = runs.mapInArrow(_cut(splitters), "range long, run string, content binary")
    near = pieces.repartitionByRange(len(splitters) + 1, "range").sortWithinPartitions("range", "run")
    return near.mapInArrow(_merge_ranges, INDEX)


def unresolved(index: DataFrame) -> DataFrame:
    """Revisits whose response is not in the index with the same payload, once per payload."""
    same = ["capture_id", "payload_digest", "payload_bytes"]
    wanted = index.filter("record_type = 'revisit'").select(F.col("refers_to").alias("capture_id"), *same[1:]).distinct()
    return wanted.join(index.filter("record_type = 'response'").select(*same), same, "left_anti")


def cdx_lines(index: DataFrame) -> DataFrame:
    """The index as lines: URL key, time, and the rest as JSON; order and partitions stay."""
    rest = F.struct(
        F.lit("text/html").alias("mime"), F.col("payload_digest").alias("digest"), F.col("length").cast("string").alias("length"),
        F.col("offset").cast("string").alias("offset"), F.col("archive").alias("filename"), "record_type")
    return index.select(F.concat_ws(" ", "urlkey", "stamp", F.to_json(rest)).alias("line"))


def archived(captures: DataFrame, folder: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write captures to archives, read those back, and return their index, checked to be whole.

    Without a folder, archives go below the folder that all executors share.
    """
    folder = folder or f"{shared_folder(captures.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = stored(capture_index(write_archives(captures, folder), folder, range_rows))
    if not unresolved(index).isEmpty():
        raise ValueError("a revisit refers to a payload that is in no archive")
    return index
