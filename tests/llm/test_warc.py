"""Web archives: records, the loser tree, and whole tables against a plain version."""

import hashlib
import io
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from listwarden.llm import warc
from listwarden.llm.queries import importable

SCHEMA = "capture_id long, url string, captured timestamp, payload string, archive string, n int"


def test_records_come_back():
    r = random.Random(1)
    some = [warc.Record({"WARC-Type": "response", "A": "b: c"}, r.randbytes(n)) for n in (0, 1, 5, 70_000, 3_000_000)]
    packed = [warc.encoded(x) for x in some]
    found = list(warc.records(io.BytesIO(b"".join(packed))))
    assert [x[2] for x in found] == some and [x[1] for x in found] == [len(x) for x in packed]
    assert [x[0] for x in found] == [sum(map(len, packed[:i])) for i in range(len(packed))]
    assert list(warc.records(io.BytesIO(b""))) == []
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(packed[3][:-9])))


def test_loser_tree():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16, 33):
        sources = [sorted(("u", "s", r.randrange(20), "a", r.randrange(9)) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(k)]
        order = list(warc.LoserTree(sources))
        assert [sources[i][j] for i, j in order] == sorted(x for s in sources for x in s)
        assert sorted(order) == [(i, j) for i, s in enumerate(sources) for j in range(len(s))]


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/A?b=1") == "com,example,www)/A?b=1"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == warc.url_key("") == "-"
    assert warc.url_key("a\r\nb é") == "a%0D%0Ab%20%C3%A9" and warc.url_key("http://[oops/") and warc.url_key("http://x:99999999/")


def rows():
    r = random.Random(3)
    big = ["x" * 99, "é" * 50, "y" * 100, "copy " * 40, "z" * 200_000]
    out = []
    for i in range(300):
        payload = r.choice([*big, big[3], big[3], f"<html>{i}</html>" * r.randrange(12), None, ""])
        url = r.choice([None, "", "http://a.example.com/", "http://a.example.com/", f"https://b{i % 7}.example.org/p?q={i}", "bad\r\nWARC-Type: x", "http://é.example/ü"])
        out.append((i * 7 % 300, url, r.choice([None, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(50))]), payload, "x", 1))
    out += [out[5], out[5], (None, "http://a.example.com/", None, big[3], "x", 1), (None, None, None, "alone" * 50, "x", 1)]
    return out


def expected(table):
    first = {}
    for i, _, _, p, *_ in table:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, _, p, *_ in table:
        data = (p or "").encode()
        refers = first.get(p) if first.get(p) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_archives(spark, tmp_path, monkeypatch, hot_rows):
    importable(spark)
    monkeypatch.setattr(warc, "HOT_ROWS", hot_rows)
    folder, table = str(tmp_path / "archives"), rows()
    frame = spark.createDataFrame(table, SCHEMA).repartition(4)
    manifest = warc.write_archives(frame, folder)
    (Path(folder) / "left-behind.warc.gz").write_bytes(b"of a lost attempt")
    assert {r.archive for r in manifest.collect()} == {p.name for p in Path(folder).iterdir()} - {"left-behind.warc.gz"}
    index = warc.capture_index(manifest, folder, range_rows=9)
    got = index.collect()
    assert sorted(((r.capture_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(table)
    keys = [(r.urlkey, r.stamp, -(1 << 63) - 1 if r.capture_id is None else r.capture_id, r.archive, r.offset) for r in got]
    assert keys == sorted(keys) and index.rdd.getNumPartitions() > 5  # in order across partitions
    for r in got[::17]:  # each entry leads to its record
        with open(f"{folder}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            (_, _, record), = warc.records(io.BytesIO(f.read(r.length)))
        assert record.headers["WARC-Record-ID"] == f"<urn:capture:{'-' if r.capture_id is None else r.capture_id}>"
    assert warc.unresolved(index).isEmpty()
    assert not warc.unresolved(index.filter("record_type = 'revisit'")).isEmpty()
    assert warc.cdx_lines(index).first().line.split(" ")[0] == got[0].urlkey


def test_damage_and_empty_tables(spark, tmp_path):
    importable(spark)
    frame = spark.createDataFrame(rows()[:20], SCHEMA)
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(frame, folder)
    name = manifest.first().archive
    data = bytearray((Path(folder) / name).read_bytes())
    data[40:60] = bytes(20)
    (Path(folder) / name).write_bytes(data)
    with pytest.raises(Exception, match="rror"):
        warc.capture_index(manifest, folder).collect()
    empty = warc.archived(frame.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == [f.name for f in warc._FIELDS]
