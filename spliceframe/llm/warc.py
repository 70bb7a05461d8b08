"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader inflates with zlib in pieces, so neither a record's neighbours nor the whole archive are ever in memory; it
frames blocks by Content-Length, and checks block and payload digests. Equal payloads are stored once: the record with
the largest key is the response, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_shared, rename_shared, scratch_path, stash

# What the WARC 1.1 format asks for.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 16
#: A writer begins a new archive after so many compressed bytes, so that reading is spread over many tasks.
ARCHIVE_BYTES = 16 << 20


class WarcError(ValueError):
    """An archive that isn't well formed, or whose digests don't hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without the HTTP header of a response."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(END)[2]
        return self.block


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def line_safe(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def member(headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = [VERSION, *(f"{k}: {line_safe(v)}".encode() for k, v in headers.items())]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(head) + END + block + END) + deflate.flush()


def page_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record; the latter holds no payload but its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url or "urn:page:none",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT}
    return member(headers, block)


def members(stream) -> Iterator[Iterator[bytes]]:
    """Each gzip member of a stream as an iterator of inflated pieces, to be read to its end before the next."""
    rest = stream.read(READ)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not inflate.eof:
                try:
                    out = inflate.decompress(rest, READ)
                except zlib.error as e:
                    raise WarcError(f"a gzip member is damaged: {e}") from e
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
                elif not inflate.eof and not rest and not (rest := stream.read(READ)):
                    raise WarcError("an archive ends inside a gzip member")

        yield pieces()
        rest = rest or stream.read(READ)


def parse(pieces: Iterator[bytes], verify: bool = True) -> Record:
    """The one record of a member."""
    held = bytearray()
    while (at := held.find(END)) < 0:
        if (piece := next(pieces, None)) is None:
            raise WarcError("a record ends inside its header")
        held += piece
    lines = bytes(held[:at]).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError("a record doesn't begin with its version")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line has no colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    length, body = int(headers["content-length"]), held[at + len(END) :]
    for piece in pieces:
        body += piece
    if bytes(body[length:]) != END:
        raise WarcError("a block isn't as long as Content-Length says")
    record = Record(headers, bytes(body[:length]))
    if verify:
        wanted = [("warc-block-digest", record.block)]
        if headers.get("warc-type") != "revisit":
            wanted.append(("warc-payload-digest", record.payload))
        for name, data in wanted:
            if name in headers and headers[name] != f"sha1:{digest(data)}":
                raise WarcError(f"{name} doesn't hold for {headers.get('warc-record-id')}")
    return record


def read_records(stream, verify: bool = True) -> Iterator[Record]:
    """The records of an archive, in order."""
    for pieces in members(stream):
        yield parse(pieces, verify)


def decisions(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """rows (key, sha, refers_to) of the pages that revisit another. Counts per payload are combined before they are dealt,
    so one payload on a third of all pages is no large group."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    narrow = stash(
        pages.select(F.col(key).alias("key"), F.sha1(body).alias("sha"), F.octet_length(body).alias("n")), "payloads"
    ).where((F.col("n") >= least_bytes) & F.col("key").isNotNull())
    last = narrow.groupBy("sha", "n").agg(F.max("key").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return narrow.join(last, ["sha", "n"]).where("key < refers_to").select("key", "sha", "refers_to").distinct()


def write(
    pages: DataFrame, directory: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write a record per page into archives of directory; rows (path, records) of the archives written.

    A null html is an empty payload; payloads of fewer than least_bytes are never revisits, nor are pages without a
    key (their record ID ends in None). Of rows that repeat the largest key of a payload each is a response. An archive
    gets its name when it is complete, so what a lost or repeated task left behind is in no list.
    """
    found = decisions(pages, key, html, least_bytes)
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body")
    ).withColumn("sha", F.sha1("body"))

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, out, name, size, n = [], None, "", 0, 0

        def close() -> None:
            out.close()
            rename_shared(f"{name}.part", name)
            done.append((name, n))

        for batch in batches:
            for k, u, body, to in zip(batch["key"], batch["url"], batch["body"], batch["refers_to"], strict=True):
                if out is None:
                    name, size, n = f"{directory}/{os.urandom(12).hex()}.warc.gz", 0, 0
                    out = open_shared(f"{name}.part", "wb")
                data = page_record(None if pd.isna(k) else int(k), u, body, None if pd.isna(to) else int(to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame({"path": [d[0] for d in done], "records": [d[1] for d in done]}).astype({"path": str, "records": "int64"})

    joined = rows.join(found, ["key", "sha"], "left")
    keys = [F.col(c).cast("string").alias(c) if c != "body" else F.col(c) for c in ("key", "url", "body", "refers_to")]
    return stash(joined.select(*keys).mapInPandas(write_part, "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the archives' records, in any
    order; fails on a damaged archive or a wrong digest. archives: rows (path). No archives: no rows."""

    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        page = lambda h, k: (h[k].strip("<>").rpartition(":")[2]) if k in h else None
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with open_shared(path, "rb") as f:
                    for r in read_records(f):
                        h = r.headers
                        rows.append((page(h, "warc-record-id"), h.get("warc-target-uri"), h.get("warc-x-payload-length") or str(len(r.payload)), h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"], page(h, "warc-refers-to")))
                        if len(rows) >= 4096:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    spread = archives.select("path").repartition(max(1, archives.count()))
    text = "page_id string, url string, payload_bytes string, payload_digest string, record_type string, refers_to string"
    out = spread.mapInPandas(read_part, text)
    number = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return out.select(number("page_id"), "url", number("payload_bytes"), "payload_digest", "record_type", number("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of pages into the shared folder and read them back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc"), least_bytes=least_bytes))
