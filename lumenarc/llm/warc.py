"""WARC archives: writing, normalising monolithic gzip files to a member a record, and reading by offset.

A crawl arrives as archives that are one gzip stream each, which can't be read from the middle. The normaliser inflates
such a file once, as a stream, rewrites every record as a gzip member of its own and writes a sidecar index of offsets.
Archives live in the shared folder, reached through the file system that its address names. A task writes under a name
of its own and renames at the end, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..workspace import materialize, new_path, plain

#: Bytes of payload after which a task begins the next archive.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
CHUNK = 1 << 20
SALTS = 16
#: Fixed value: the profile of a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC record. A revisit holds the HTTP headers, with the length of the full payload, but no payload."""
    digest = digest or payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{kind}|{digest}")
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; names in lower case."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records in a stream of WARC bytes, each with its end; holds one record at a time."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        while True:
            end = buffer.find(b"\r\n\r\n")
            if end < 0:
                break
            head = bytes(buffer[:end]).lower()
            at = head.index(b"\r\ncontent-length:") + 17
            total = end + 4 + int(head[at:].split(b"\r\n")[0]) + 4
            if len(buffer) < total:
                break
            yield bytes(buffer[:total])
            del buffer[:total]
    if buffer.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def inflated(stream: io.RawIOBase) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in chunks."""
    d = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = d.decompress(data, 16 * CHUNK)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def normalise(source: str, target: str) -> int:
    """Rewrites the archive at source to target, a member a record, and target.idx; returns the number of records.

    The index has one JSON line a record: offset and length of its member, and its WARC type.
    """
    fs, src = _fs(source)
    _, dst = _fs(target)
    own = f"{dst}.{uuid.uuid4().hex}"
    n = offset = 0
    with fs.open_input_stream(src, compression=None) as stream, fs.open_output_stream(own, compression=None) as out, fs.open_output_stream(own + ".idx", compression=None) as index:
        for raw in records(inflated(stream)):
            member = _member(raw)
            kind = parse_type(raw)
            out.write(member)
            index.write(json.dumps({"offset": offset, "length": len(member), "type": kind}).encode() + b"\n")
            offset, n = offset + len(member), n + 1
    fs.move(own, dst)
    fs.move(own + ".idx", dst + ".idx")
    return n


def parse_type(raw: bytes) -> str:
    at = raw.index(b"WARC-Type: ") + 11
    return raw[at : raw.index(b"\r\n", at)].decode()


def kinds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for a response.

    Only payloads that occur twice or more are joined; each is dealt out over salts, so that the copies of one page are
    no single task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("d", F.sha1(F.encode("html", "UTF-8")))
    twice = rows.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("d", "first")
    twice = materialize(twice, "twice").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("d", "_d")
    met = rows.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(twice, (F.col("d") == F.col("_d")) & (F.col("_s") == F.col("s")), "left")
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path): archives of one gzip stream each, from the columns of kinds(); a file name says which task wrote it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        done, out, gz, size, own = [], None, None, 0, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(gz.flush())
                out.close()
                fs.move(own, own.removesuffix(".part"))
                done.append(folder + own[len(base) :].removesuffix(".part"))
                out = None

        for x in batches:
            for i, u, h, r in zip(x["page_id"], x["url"], x["html"], x["refers_to"], strict=True):
                if out is None:
                    own, size, gz = f"{base}/{uuid.uuid4().hex}.warc.gz.part", 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(own, compression=None)
                payload = h.encode("utf-8", "surrogatepass")
                raw = record(None if pd.isna(i) else int(i), u, payload, "response" if pd.isna(r) else "revisit", None if pd.isna(r) else int(r))
                out.write(gz.compress(raw))
                size += len(raw)
                if size > ARCHIVE_BYTES:
                    close()
        close()
        yield plain(pd.DataFrame({"path": done}, dtype=object))

    return rows.mapInPandas(run, "path string")


def _spread(paths: DataFrame) -> DataFrame:
    return paths.repartition(max(1, min(10_000, paths.count())), "path")


def normalise_all(paths: DataFrame) -> DataFrame:
    """(path, offset, length, type): the index of all records, after each archive at path has been normalised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path in x["path"]:
                target = path.removesuffix(".warc.gz") + ".norm.warc.gz"
                normalise(path, target)
                fs, at = _fs(target + ".idx")
                with fs.open_input_stream(at, compression=None) as f:
                    lines = [json.loads(v) for v in f.read().splitlines()]
                yield plain(pd.DataFrame({"path": target, "offset": [v["offset"] for v in lines], "length": [v["length"] for v in lines], "type": [v["type"] for v in lines]}))

    return _spread(paths).mapInPandas(run, "path string, offset long, length long, type string")


def members(f: pa.NativeFile, spans: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each span (offset, length), in order; neighbours are read together, up to READ_BYTES at once."""
    k = 0
    while k < len(spans):
        n, end = k, spans[k][0]
        while n < len(spans) and spans[n][0] == end and (n == k or end + spans[n][1] - spans[k][0] <= READ_BYTES):
            end += spans[n][1]
            n += 1
        held = f.read_at(end - spans[k][0], spans[k][0])
        for offset, length in spans[k:n]:
            yield offset, held[offset - spans[k][0] : offset - spans[k][0] + length]
        k = n


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each record, read by its offset.

    A response's digest and length are measured on its payload and must be those that its headers name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for path, own in x.groupby("path", sort=False):
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    for offset, raw in members(f, sorted(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))):
                        warc, http, payload = parse(zlib.decompress(raw, 31))
                        size, digest, kind = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{path} at {offset}: the payload is not what the record says")
                        rows.append((int(warc["warc-page-id"]) if warc["warc-page-id"] else None, size, digest, kind, int(warc["warc-refers-to-page-id"]) if kind == "revisit" else None))
            yield plain(pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"}))

    return index.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages, normalises the archives, and reads them back; see read_records().

    Of rows with equal payloads the one with the smallest page_id is a response, the others revisit it. Rows that repeat
    that id and payload are responses too. A null html is the empty payload, a null url about:blank. A row with a null
    page_id revisits a row of the same payload with an id; without one it is a response. An empty table gives an empty
    result. Other columns are not read. The archives stay in the shared folder.
    """
    folder = new_path(pages.sparkSession, "warc")
    paths = materialize(write_archives(kinds(pages, id_col, url_col, html_col), folder), "archives")
    index = materialize(normalise_all(paths), "index")
    return read_records(index)
