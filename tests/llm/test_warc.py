"""WARC archives: exact round trips, the index, and coalesced ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections import defaultdict

import pyarrow.fs
from pyspark.sql import functions as F

from pagesieve.llm import warc
from pagesieve.session import shared_folder

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            groups[payload].append(i)
    out = []
    for i, url, html in rows:
        payload = (html or "").encode()
        ids = [k for k in groups.get(payload, []) if k is not None]
        largest = max(ids) if len(groups.get(payload, [])) > 1 and ids else None
        revisit = largest is not None and i != largest
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", largest if revisit else None, url))
    return sorted(out, key=repr)


def pages(n=200):
    body = "<p>Füße 漢字</p>" * 90
    rows = [(k, f"http://example.com/{k}", f"<html>{k % 7}{body}</html>" if k % 3 else f"<p>{k}</p>") for k in range(n)]
    return rows + [(1000, "http://example.com/x", body * 4000), (1001, None, None), (1002, "", ""), (1003, "a b\r\nc\x00", body[:999]), (1004, "é", body[:999])]


def test_round_trip(spark):
    rows = pages()
    found = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_odd_pages(spark):
    long = "x" * 1000
    rows = [(None, "u", long), (3, "u", long), (3, "u", long), (3, "v", long), (2, "u", long), (None, "w", "y" * 1000), (None, "w", "y" * 1000), (5, "u", "x" * 999), (6, "u", "x" * 999)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    clashing = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA + ", payload string, file int, offset int")
    assert sorted(map(tuple, warc.archive_round_trip(clashing).collect()), key=repr) == expected(rows)


def test_files_are_readable_as_whole_archives_and_by_the_index(spark):
    root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages(60)
    index = warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), root, date="2025-01-01T00:00:00Z", archive_bytes=4000)
    entries = index.collect()
    assert len(entries) == len(rows) and len({r.file for r in entries}) > 2
    fs, folder = pyarrow.fs.FileSystem.from_uri(f"{root}/archive")
    for name in {r.file for r in entries}:
        data = fs.open_input_file(f"{folder}/{name}").read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == 1 + sum(r.file == name for r in entries)
        for r in (r for r in entries if r.file == name):
            fields, payload = warc.parse_record(gzip.decompress(data[r.offset : r.offset + r.length]))
            assert fields["WARC-Type"] == r.record_type and fields.get("WARC-Refers-To") == r.target_id
            if r.record_type == "response":
                assert hashlib.sha1(payload).hexdigest() == r.payload_digest and fields["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}"
                assert payload.decode() == (dict((i, h) for i, _, h in rows)[r.page_id] or "")
    some = warc.read_records(index.where("page_id % 10 = 0"), root, with_payload=True).collect()
    assert {r.page_id for r in some} == {i for i, _, _ in rows if i % 10 == 0}
    whole = {r.page_id: r.payload.decode() for r in warc.read_pages(index, root, with_payload=True).collect()}
    assert whole == {i: h or "" for i, _, h in rows}


def test_ranges_are_coalesced_up_to_a_size():
    rows = [{"file": "a", "offset": o, "length": 10} for o in (0, 10, 30, 500)] + [{"file": "b", "offset": 505, "length": 10}, {"file": "b", "offset": 515, "length": 90}, {"file": "b", "offset": 605, "length": 1}]
    found = [(f, b, e, len(r)) for f, b, e, r in warc.ranges(iter(rows), gap=20, most=95)]
    assert found == [("a", 0, 40, 3), ("a", 500, 510, 1), ("b", 505, 515, 1), ("b", 515, 606, 2)]
    assert list(warc.ranges(iter([]))) == []


def test_an_index_that_does_not_fit_is_refused(spark):
    import pytest

    root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], SCHEMA).coalesce(1), root)
    with pytest.raises(Exception, match="does not fit"):
        warc.read_records(index.withColumn("payload_digest", F.lit("0")), root).collect()
