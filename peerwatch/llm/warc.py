"""WARC archives: written as whole-file gzip, normalised to one member per record with an offset index, read back.

A crawler that gzips a whole file leaves an archive that can only be read from
its start. The normaliser inflates such a stream once, record by record, writes
each record as a gzip member of its own and notes offset and length in a sidecar
file, so any record can then be read alone. On the way, records whose payload an
earlier one has become revisits of it.

Archives are rolled at a fixed size and number of records, so a task holds one
record and one archive's decisions at a time. File names carry a random part and
only names that reach a written table count, so files of lost attempts are
never read. Files go through pyarrow's file systems into the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table
from peerwatch.sources.staging import folder, stage

#: An archive ends once it holds so many payload bytes or records.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 20_000
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
#: Payloads from this size on may be revisits.
LEAST_BYTES = 0


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    files, inner = arrow_fs.FileSystem.from_uri(path)
    files.create_dir(inner, recursive=True)
    return files, inner


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_record(page_id: str, url: str | None, payload: bytes) -> bytes:
    """A response; line breaks and other controls in the address are dropped, as a header is one line."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c.isprintable())
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{ID_PREFIX}{page_id}>"), ("WARC-Date", DATE),
        *([("WARC-Target-URI", uri)] if uri else []), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record_bytes(headers, http + payload)


class GzipReader:
    """Bytes of a gzip file of any number of members, inflated as they are asked for."""

    def __init__(self, source):
        self.source = source
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        pending = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = pending or self.source.read(CHUNK)
        if not data:
            return False
        self.held += self.inflate.decompress(data)
        return True

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a line")
                return b""
        out = bytes(self.held[: at + 2])
        del self.held[: at + 2]
        return out

    def exactly(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def read_records(source) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a gzip archive, monolithic or by members."""
    reader = GzipReader(source)
    while version := reader.line():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = []
        while (line := reader.line()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers.append((name, value))
        block = reader.exactly(int(dict(headers)["Content-Length"]))
        if reader.exactly(4) != b"\r\n\r\n":
            raise ValueError("record does not end with two line breaks")
        yield [h for h in headers if h[0] != "Content-Length"], block


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a response record into monolithic archives under `folder`.

    Returns (archive, ordinal, page_id, digest, check, payload_bytes), a row per
    record. A NULL payload is an empty one. The archives come straight from the
    scan, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = _folder(folder)
        out = squeeze = None
        name, size, rows = "", 0, []

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), ids, pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        names = ["archive", "ordinal", "page_id", "digest", "check", "payload_bytes"]
        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for key, url, html in zip(*batch.columns):
                key, payload = key.as_py(), (html.as_py() or "").encode()
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out, squeeze = files.open_output_stream(f"{inner}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                record = response_record("" if key is None else str(key), url.as_py(), payload)
                out.write(squeeze.compress(record))
                check = xxhash.xxh64_intdigest(payload) - (1 << 63)
                rows.append((name, len(rows), key, payload_digest(payload), check, len(payload)))
                size += len(payload)
                if size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    ship()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"archive string, ordinal bigint, page_id {kind}, digest string, check bigint, payload_bytes bigint"
    )


def decide(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(archive, ordinal, refers_to, revisit) of written records.

    Of equal payloads of at least `least` bytes the record with the least id is
    the response (a NULL id comes last; among rows of one id the first written),
    the others revisit it. Payloads are equal by SHA-1, a second checksum and
    size. Groups are aggregated before the shuffle and joined as a written table,
    so a payload that most pages share is split.
    """
    place = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "archive", "ordinal")
    key = ["digest", "check", "payload_bytes"]
    groups = records.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stage(groups.where("n > 1").select(*key, "first"), "payloads")
    met = records.join(shared, key, "left")
    revisit = F.col("first").isNotNull() & ~((F.col("first.archive") == F.col("archive")) & (F.col("first.ordinal") == F.col("ordinal")))
    return met.select("archive", "ordinal", F.when(revisit, F.col("first.page_id").cast("string")).alias("refers_to"), revisit.alias("revisit"))


def normalise_archive(source, target, revisits: dict[int, str | None]) -> Iterator[dict]:
    """Rewrite a gzip archive, each record its own member; yields the index line of every record.

    `revisits` maps ordinals to the record they refer to.
    """
    offset = 0
    for ordinal, (headers, block) in enumerate(read_records(source)):
        if ordinal in revisits:
            refers = "" if revisits[ordinal] is None else revisits[ordinal]
            headers = [(n, "revisit" if n == "WARC-Type" else v) for n, v in headers]
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers}>")]
            block = block[: block.index(b"\r\n\r\n") + 4]  # a revisit keeps the HTTP headers alone
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = squeeze.compress(record_bytes(headers, block)) + squeeze.flush()
        target.write(member)
        told = dict(headers)
        yield {
            "id": told["WARC-Record-ID"], "type": told["WARC-Type"], "uri": told.get("WARC-Target-URI"),
            "digest": told["WARC-Payload-Digest"], "offset": offset, "length": len(member),
        }
        offset += len(member)


def normalise(decisions: DataFrame, archives: int, source: str, target: str) -> DataFrame:
    """Rewrite each archive under `source` into `target`, with a sidecar index of JSON lines.

    Returns (file, records); the index of FILE is FILE.index. One task takes one archive.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        read, from_ = _folder(source)
        write, to = _folder(target)
        archive = rows["archive"].iloc[0]
        file = f"{uuid.uuid4().hex}.warc.gz"
        moved = rows[rows["revisit"]]
        refers = {int(o): None if pd.isna(r) else r for o, r in zip(moved["ordinal"], moved["refers_to"])}
        lines = 0
        with read.open_input_stream(f"{from_}/{archive}", compression=None) as stream, \
                write.open_output_stream(f"{to}/{file}", compression=None) as out, \
                write.open_output_stream(f"{to}/{file}.index", compression=None) as index:
            for entry in normalise_archive(stream, out, refers):
                index.write(json.dumps(entry).encode() + b"\n")
                lines += 1
        if lines != len(rows):
            raise ValueError(f"{archive} has {lines} records, not {len(rows)}")
        return pd.DataFrame({"file": [file], "records": [lines]})

    ship()
    dealt = decisions.repartition(max(1, min(archives, 10_000)), "archive")
    return dealt.groupBy("archive").applyInPandas(run, "file string, records bigint")


def read_archive(folder: str, file: str) -> Iterator[tuple]:
    """(id, payload_bytes, digest, type, refers_to) of each record, by its offset in the index.

    A response's payload is held against its digest and size.
    """
    files, inner = _folder(folder)
    with files.open_input_stream(f"{inner}/{file}.index", compression=None) as index:
        entries = [json.loads(line) for line in index.read().splitlines()]
    with files.open_input_file(f"{inner}/{file}") as archive:
        for entry in entries:
            archive.seek(entry["offset"])
            raw = zlib.decompress(archive.read(entry["length"]), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
            size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                raise ValueError(f"{file}: {headers['WARC-Record-ID']} does not hold the payload it names")
            refers = headers.get("WARC-Refers-To")
            yield (_page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], refers and _page(refers))


def _page(record_id: str) -> str | None:
    return record_id[1:-1].removeprefix(ID_PREFIX) or None


def read_archives(written: DataFrame, count: int, folder: str, kind: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for file in batch.column(0).to_pylist():
                columns = list(zip(*read_archive(folder, file)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ship()
    dealt = written.select("file").repartition(max(1, min(count, 10_000)), "file")
    rows = dealt.mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return rows.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write, deduplicate, normalise and read back: one row per row of `pages`.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). NULL html
    is an empty payload and empty payloads are equal to each other; a NULL id
    comes back as NULL. An empty table writes nothing. Other columns are ignored.
    """
    spark = pages.sparkSession
    root = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    records = stage(write_archives(pages, f"{root}/raw", id_col, url_col, html_col), "records")
    archives = records.select("archive").distinct().count()
    written = stage(normalise(decide(records, least), archives, f"{root}/raw", f"{root}/members"), "members")
    return read_archives(written, archives, f"{root}/members", pages.schema[id_col].dataType.simpleString())


def op1_warc_normalise(spark, sf_dir: str) -> DataFrame:
    """All `pages` through archives."""
    return archive_pages(table(spark, sf_dir, "pages"))


# Base 32 of a SHA-1: each five hex digits are twenty bits, four characters.
_BASE32 = """array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha1(html), i * 5 + 1, 5) AS BIGINT) >> CAST(s AS INTEGER)) & 31 AS BIGINT) + 1, 1)), lambda a, b: a || b)), '')"""
ORACLES = {
    "op1_warc_normalise": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (html)
    """,
}
