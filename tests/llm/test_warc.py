import gzip
import hashlib
import json

import pytest

from skyloom.llm import warc
from skyloom.llm.common import load, new_path

PAGES = "page_id long, url string, html string, digest string, mark int"


def rows(spark, data):
    return spark.createDataFrame([(i, u, h, "d", 7) for i, u, h in data], PAGES)


def read(spark, folder):
    return sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder, False).collect()), key=str)


def content(folder):
    return {p: hashlib.sha1(open(p.removeprefix("file://"), "rb").read()).hexdigest() for p in folder}


def test_round_trip_of_all_pages(spark, sf):
    pages, folder = load(spark, sf, "pages"), new_path(spark, "t")
    warc.write_warc(pages, folder)
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    first = {}
    for i in sorted(want):
        first.setdefault(want[i], i)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    assert got.keys() == want.keys()
    for i, payload in want.items():
        assert got[i]["payload_digest"] == warc.base32_sha1(payload) and got[i]["payload_bytes"] == len(payload)
        if first[payload] == i:
            assert got[i]["record_type"] == "response" and bytes(got[i]["payload"]) == payload and got[i]["refers_to"] is None
        else:
            assert got[i]["record_type"] == "revisit" and got[i]["refers_to"] == first[payload] and got[i]["payload"] is None


def test_files_do_not_depend_on_partitions_and_roll(spark, sf):
    pages, folders = load(spark, sf, "pages"), [new_path(spark, "t") for _ in range(2)]
    one = warc.write_warc(pages.coalesce(1), folders[0], shard_bytes=60_000, roll_bytes=8_000)
    two = warc.write_warc(pages.repartition(7), folders[1], shard_bytes=60_000, roll_bytes=8_000)
    assert len(one) > 4 and [p.rsplit("/", 1)[1] for p in one] == [p.rsplit("/", 1)[1] for p in two]
    assert list(content(one).values()) == list(content(two).values())
    listed = [json.loads(x) for x in open(f"{folders[0]}/{warc.MANIFEST}".removeprefix("file://"))]
    assert [x["sha1"] for x in listed] == list(content(one).values()) and sum(x["records"] for x in listed) == pages.count()
    with pytest.raises(FileExistsError):
        warc.write_warc(pages, folders[0])


def test_edges(spark):
    data = [(3, None, None), (1, "", ""), (2, "http://a/\r\nX: y é", "same"), (9, "u", "same"), (9, "u", "same"), (9, "v", "other"), (None, "w", "same"), (None, "w", "alone"), (7, "long", "é" * 300_000)]
    folder = new_path(spark, "t")
    warc.write_warc(rows(spark, data), folder)
    assert read(spark, folder) == sorted([(1, 0, "response", None), (2, 4, "response", None), (3, 0, "revisit", 1), (7, 600_000, "response", None), (9, 4, "revisit", 2), (9, 4, "revisit", 2), (9, 5, "response", None), (None, 4, "revisit", 2), (None, 5, "response", None)], key=str)
    again = new_path(spark, "t")
    warc.write_warc(rows(spark, [(4, "u", "twice"), (4, "u", "twice"), (5, "u", "x"), (6, "u", "x")]), again, min_revisit_bytes=2)
    assert read(spark, again) == [(4, 5, "response", None), (4, 5, "revisit", 4), (5, 1, "response", None), (6, 1, "response", None)]
    empty = new_path(spark, "t")
    assert warc.write_warc(rows(spark, data).limit(0), empty) == [] and read(spark, empty) == []


def test_damage_is_told():
    data = gzip.compress(warc.record(1, 0, "http://a/", b"payload", None, False, "1970-01-01T00:00:00Z"))
    assert [h["warc-type"] for h, _ in warc.records_of(data)] == ["response"]
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-20]))
    with pytest.raises(ValueError):
        list(warc._parse(gzip.compress(gzip.decompress(data).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))))
