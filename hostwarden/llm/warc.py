"""Derivative builder for WARC responses: linked metadata and plain-text conversion records.

Every response gives a metadata record (title, links and the source's headers, as JSON) and a conversion record (its
text). Both refer to the response by its identifier, keep its address, date and payload digest, and name each other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.support import prepare

CRLF = "\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for addresses
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|html|blockquote|pre|form|hr|dd|dt|dl|td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLANKS = re.compile(r"[ \t\f\v\r\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def plain_text(markup: str) -> str:
    """Visible text, one line per block."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", markup))))
    lines = (_BLANKS.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def envelope(markup: str, http_headers: str) -> dict:
    """What the metadata record tells of a response."""
    visible = _HIDDEN.sub(" ", markup)
    title = _TITLE.search(visible)
    first, *rest = http_headers.strip().split(CRLF)
    return {
        "status": first, "headers": {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in rest) if k.strip()},
        "title": html.unescape(_BLANKS.sub(" ", _TAG.sub("", title[1])).strip()) if title else None,
        "links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(visible)],
    }


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows of ``pages(page_id, url, html)``: ``page_id, record_id, target_uri, warc_date, http_headers, payload``.

    Identifiers follow from page id, address and content, so a second run makes the same ones. A null page is an empty payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.length(payload).cast("string"), F.lit(CRLF))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit("")), F.sha1(payload)).cast("binary"))
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), name.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"), payload.alias("payload"))


_RECORDS = (
    "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, content string"
)
_NAMES = [c.split()[0] for c in _RECORDS.split(", ")]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, source, uri, date, headers, payload in zip(*(batch[c].to_pylist() for c in ("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload"))):
            payload, headers = payload or b"", headers or ""
            markup, of_payload = payload.decode("utf-8", "replace"), digest(payload)
            meta = envelope(markup, headers) | {"payload_digest": of_payload, "payload_length": len(payload)}
            contents = {"metadata": ("application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True)), "conversion": ("text/plain", plain_text(markup))}
            ids = {kind: record_id(source, page, kind) for kind in contents}
            for kind, (media, content) in contents.items():
                block = content.encode("utf-8", "replace")
                other = ids["conversion" if kind == "metadata" else "metadata"]
                out.append((page, kind, ids[kind], source, other, uri, date, media, len(block), digest(block), of_payload, block.decode("utf-8")))
        columns = list(zip(*out)) or [[]] * len(_NAMES)
        kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), *[pa.string()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for every response row: ``page_id, record_type, record_id, refers_to, concurrent_to, target_uri,
    warc_date, content_type, content_length, block_digest, source_payload_digest, content``.

    Digests are SHA-1 in base 32. An empty or missing payload gives an empty text and metadata without title and links.
    Repeated responses give repeated records with equal identifiers. Bytes that are no UTF-8 are replaced.
    """
    prepare(source.sparkSession)
    return source.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(_derived, _RECORDS)


def record_bytes(row: dict) -> bytes:
    """A derived record in WARC 1.1 format."""
    block = row["content"].encode("utf-8")
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"],
        "WARC-Concurrent-To": row["concurrent_to"], "WARC-Source-Payload-Digest": row["source_payload_digest"], "WARC-Block-Digest": row["block_digest"],
        "Content-Type": row["content_type"], "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}{CRLF}" for k, v in head.items() if v is not None)
    return f"WARC/1.1{CRLF}{lines}{CRLF}".encode("utf-8") + block + (CRLF * 2).encode("ascii")


def members(records: DataFrame) -> DataFrame:
    """The records as gzip members, ``record_id, member``; members written one after another are a ``.warc.gz`` file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(record_bytes(row), mtime=0) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["record_id"], pa.array(packed, pa.binary())], ["record_id", "member"])

    return records.mapInArrow(rows, "record_id string, member binary")


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    """Headers and block of every record in uncompressed WARC bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split(CRLF)[1:])
        size = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 8 + size
    return out
