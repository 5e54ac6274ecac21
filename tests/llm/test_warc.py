import base64
import gzip
import hashlib
import io
import json

import pytest

from peerwatch.llm import warc

PAGES = [
    (5, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/\r\nX: y", None), (4, "http://d/", ""),
    (7, "http://é/ ", "WARC/1.1\r\n\r\n\r\n\r\né"), (8, "http://e/", "x" * 3_000_000), (None, "http://f/", "<p>same</p>"), (None, "u", "own"),
    (6, "http://g/", "HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"),
]


def brute(pages):
    least = {}
    for page_id, _, html in pages:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        first = least.get(html or "")
        revisit = first is not None and page_id != first
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("records", [2, 20_000])
def test_pages_come_back(spark, monkeypatch, records):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", records)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, digest int").repartition(3)
    assert sorted(map(tuple, warc.archive_pages(pages).collect()), key=repr) == brute(PAGES)


def test_repeated_rows_have_one_response(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "b")], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect())
    assert got == [(1, "response", None), (1, "revisit", 1), (2, "response", None)]


def test_small_payloads_may_all_be_responses(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_pages(pages, least=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("members", [1, 3])
def test_normaliser_on_streams(members, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)  # boundaries everywhere
    records = [warc.response_record(str(i), f"http://{i}/", b"z" * i + b"\r\n\r\nWARC/1.1") for i in range(9)]
    raw = b"".join(gzip.compress(b"".join(records[i::1][: 9 // members])) for i in range(0, 9, 9 // members))
    out = io.BytesIO()
    index = list(warc.normalise_archive(io.BytesIO(raw), out, {4: "1"}))
    assert [e["id"] for e in index] == [f"<{warc.ID_PREFIX}{i}>" for i in range(9)]
    assert [e["type"] for e in index] == ["response"] * 4 + ["revisit"] + ["response"] * 4
    for i, entry in enumerate(index):
        member = gzip.decompress(out.getvalue()[entry["offset"] : entry["offset"] + entry["length"]])
        assert (member == records[i]) == (i != 4)
    assert sum(e["length"] for e in index) == len(out.getvalue())
    json.dumps(index)


def test_cut_archive_is_an_error():
    raw = gzip.compress(warc.response_record("1", "u", b"payload")[:-3])
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw)))


def test_record_without_a_payload_change_is_verified(tmp_path):
    out = io.BytesIO()
    record = warc.response_record("1", "u", b"payload").replace(b"payload", b"paYload")
    entries = list(warc.normalise_archive(io.BytesIO(gzip.compress(record)), out, {}))
    (tmp_path / "f").write_bytes(out.getvalue())
    (tmp_path / "f.index").write_text("".join(json.dumps(e) + "\n" for e in entries))
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path), "f"))
