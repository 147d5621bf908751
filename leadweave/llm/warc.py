"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A record is a row: id, type, date, target address, named header fields and the block's bytes. Of every response two records are derived.
Both refer to the response by id, address and date, and carry its payload digest. The metadata record lists what the response's
HTTP head said; the conversion record is the text of all blocks of the payload. Ids are name-based, so a rerun makes the same records.

Defined cases: a response without an HTTP head has no source headers and is all payload. Null or empty payloads give an
empty conversion. Text is decoded by the stated charset, else as UTF-8, with bytes that do not fit replaced. Records of other types are
passed over. Repeated responses give repeated records. Extra columns stay beside the record. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.html_blocks import blocks

RECORD = "record_id string, type string, date string, target_uri string, headers map<string,string>, block binary"
F_NAMES = ("record_id", "type", "date", "target_uri", "headers", "block")
CRAWL_DATE = "2024-01-01T00:00:00Z"
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.IGNORECASE)
_HEADER_TYPE = pa.map_(pa.string(), pa.string())
_NAMESPACE = uuid.UUID(int=0x6C656164776561766500000000000000)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(10).join(parts))}>"


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date: str = CRAWL_DATE) -> DataFrame:
    """Captured pages as response records, with their other columns. Null html is an empty payload."""
    uri, html = F.coalesce(F.col(f"`{url_col}`"), F.lit("")), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")

    @F.pandas_udf(RECORD)
    def made(urls, htmls):
        rows = []
        for url, payload in zip(urls, htmls):
            payload = bytes(payload)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            block = head + payload
            fields = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response"}
            rows.append((record_id("response", url, date, fields["WARC-Block-Digest"]), "response", date, url, fields, block))
        return pd.DataFrame(rows, columns=["record_id", "type", "date", "target_uri", "headers", "block"])

    packed = pages.select(*[c for c in pages.columns if c not in F_NAMES and c not in (url_col, html_col)], made.asNondeterministic()(uri, html).alias("record"))
    return packed.select(*[c for c in packed.columns if c != "record"], "record.*")


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order, payload."""
    head, border, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not border:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, colon, v in (line.partition(":") for line in lines) if colon], payload


def _text(payload: bytes, headers: list[tuple[str, str]]) -> str:
    stated = _CHARSET.search(next((v for k, v in headers if k.lower() == "content-type"), ""))
    try:
        charset = codecs.lookup(stated.group(1)).name if stated else "utf-8"
    except LookupError:
        charset = "utf-8"
    return "\n".join(b.text for b in blocks(payload.decode(charset, "replace")))


def derived_records(source_id: str, date: str, uri: str, fields: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    payload_digest = fields.get("WARC-Payload-Digest") or digest(payload)
    link = {"WARC-Refers-To": source_id, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": payload_digest}
    listed = [("source-status", status), ("source-length", str(len(payload))), ("source-payload-digest", payload_digest), *[(f"source-header-{k.lower()}", v) for k, v in headers]]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in listed).encode()
    text = _text(payload, headers).encode()
    out = []
    for kind, content_type, body in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        own = {**link, "WARC-Block-Digest": digest(body), "Content-Type": content_type, "Content-Length": str(len(body))}
        out.append((record_id(kind, source_id), kind, date, uri, own, body))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two records of every response; columns beside the record are repeated on both."""
    extra = [c for c in records.columns if c not in F_NAMES]
    kept = records.filter("type = 'response'").select(*extra, *F_NAMES)
    schema = f"struct<{RECORD.replace(' string', ':string').replace(' map', ':map').replace(' binary', ':binary')}>"

    @F.pandas_udf(f"array<{schema}>")
    def made(ids, dates, uris, fields, bodies):
        names = F_NAMES
        return pd.Series([[dict(zip(names, r)) for r in derived_records(i or "", d or "", u or "", dict(f or {}), bytes(b or b""))]
                          for i, d, u, f, b in zip(ids, dates, uris, fields, bodies)])

    both = kept.select(*extra, F.explode(made.asNondeterministic()("record_id", "date", "target_uri", "headers", "block")).alias("record"))
    return both.select(*extra, "record.*")


def serialised(kind: str, ident: str, date: str, uri: str, fields: dict[str, str], body: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, "WARC-Target-URI": uri, **fields, "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """One compressed member per record, as rows of binary files: ``path`` gets Parquet with a ``member`` column per record.

    Concatenating the members of a partition is a valid compressed WARC file.
    """
    @F.pandas_udf("binary")
    def member(kinds, ids, dates, uris, fields, bodies):
        return pd.Series([gzip.compress(serialised(k, i, d, u, dict(f), bytes(b)), mtime=0) for k, i, d, u, f, b in zip(kinds, ids, dates, uris, fields, bodies)])

    records.select(member("type", "record_id", "date", "target_uri", "headers", "block").alias("member")).write.parquet(path)


def parse_records(data: bytes, whole: bool = False) -> Iterator[tuple]:
    """Records of an uncompressed WARC file. Stops at bytes that are no whole record; if the ``whole`` file has to be read, they are an error."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            if whole:
                raise ValueError(f"no whole WARC record at byte {at} of {len(data)}")
            return
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:] if ": " in line)
        size = int(fields.get("Content-Length", 0))
        if whole and end + 4 + size > len(data):
            raise ValueError(f"the WARC record at byte {at} is cut: {len(data) - end - 4} of {size} bytes")
        own = {k: v for k, v in fields.items() if k not in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI")}
        yield fields.get("WARC-Record-ID", ""), fields.get("WARC-Type", ""), fields.get("WARC-Date", ""), fields.get("WARC-Target-URI", ""), own, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files, compressed or not. A file is one task's work; crawls keep them near a gigabyte. A damaged file is an error."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = list(parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, whole=True))
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*[pa.array(cols[i], pa.string()) for i in range(4)], pa.array([list(h.items()) for h in cols[4]], _HEADER_TYPE),
                                                  pa.array(cols[5], pa.binary())], list(F_NAMES))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)
