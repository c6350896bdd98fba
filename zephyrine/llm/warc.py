"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each response gives a ``metadata`` record with its HTTP status, headers, digests, title and links, and, if
its payload is text or HTML, a ``conversion`` record with its plain text. Both refer to the response by
WARC-Refers-To, keep its target and date, and name each other by WARC-Concurrent-To. Record identifiers are
derived from the response's identifier, so that repeating the work gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common
from zephyrine.llm.htmltext import Page

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, text)}>"


def write(headers: Headers, block: bytes) -> bytes:
    """A record: version, headers (their order kept; line breaks in values become spaces), block."""
    lines = [VERSION] + [f"{k}: {' '.join(v.split())}".encode("utf-8", "surrogatepass") for k, v in headers]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> Headers:
    out: Headers = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def value(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read(data: bytes, at: int = 0) -> tuple[Headers, bytes, int] | None:
    """Headers and block of the record at ``at``, and where its block ends; None if no whole record is there."""
    found = next(records(iter([data[at:]])), None)
    if found is None or isinstance(found, int):
        return None
    headers, block, begin, end = found
    return headers, block, at + end


HEAD = re.compile(rb"\r?\n\r?\n")
Record = tuple[Headers, bytes, int, int]  # headers, block, where the record begins and its block ends


def records(pieces: Iterator[bytes]) -> Iterator[Record | int]:
    """The records of data that comes in pieces; for a stretch that is no whole record, its length in bytes.

    What has no version line, no end of its headers or no length, or is not followed by a line break or the end
    of the data, is no whole record; reading goes on at the next line that begins with WARC/. No more is held
    than the record at hand.
    """
    held = bytearray()
    start = skipped = 0  # where ``held`` begins, and how much was passed over before it

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        blank = 0
        while True:
            while blank < len(held) and held[blank] in b"\r\n":
                blank += 1
            if blank < len(held) or not more():
                break
        del held[:blank]
        start += blank
        while len(held) < 5 and more():
            pass
        if not held:
            break
        found = None
        if held.startswith(b"WARC/"):
            seen = 0
            while (m := HEAD.search(held, seen)) is None:
                seen = max(0, len(held) - 3)
                if not more():
                    break
            if m and held.find(b"\nWARC/", 0, m.start()) >= 0:
                m = None  # cut off within its headers
            headers = _fields(bytes(held[: m.start()]).partition(b"\n")[2]) if m else []
            size = value(headers, "Content-Length") or ""
            if m and size.isdigit():
                end = m.end() + int(size)
                while len(held) <= end and more():
                    pass
                if len(held) == end or len(held) > end and held[end] in b"\r\n":
                    found = headers, bytes(held[m.end() : end]), start, start + end
        if found:
            if skipped:
                yield skipped
                skipped = 0
            yield found
            del held[:end]
            start += end
            continue
        at = 1
        while (k := held.find(b"\nWARC/", at)) < 0:
            at = max(1, len(held) - 5)
            if not more():
                break
        gone = k + 1 if k >= 0 else len(held)
        del held[:gone]
        start += gone
        skipped += gone
    if skipped:
        yield skipped


def unpacked(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a plain or gzip file in pieces. After a broken gzip member it goes on with the next one."""
    if data[:2] != b"\x1f\x8b":
        for lo in range(0, len(data), size):
            yield data[lo : lo + size]
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, feed = zlib.decompressobj(31), at
        try:
            while not member.eof and feed < len(data):
                piece = view[feed : feed + size]
                yield member.decompress(piece)
                feed += len(piece)
            at = feed - len(member.unused_data)
            if not member.eof:
                break
        except zlib.error:
            yield b"\n"
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                break


def http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response."""
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    status, _, rest = head.partition(b"\n")
    return status.decode("latin-1").strip(), _fields(rest), payload


def decoded(headers: Headers, payload: bytes) -> str:
    """The payload as text: chunks joined, decompressed where that works, and decoded by its declared
    character set, else by UTF-8; bytes that do not fit are replaced."""
    if "chunked" in (value(headers, "Transfer-Encoding") or "").lower():
        out, rest = [], payload
        while m := re.match(rb"\s*([0-9a-fA-F]+)[^\n]*\n", rest):
            n = int(m[1], 16)
            if not n:
                break
            out.append(rest[m.end() : m.end() + n])
            rest = rest[m.end() + n :]
        payload = b"".join(out) or payload
    coding = (value(headers, "Content-Encoding") or "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            payload = gzip.decompress(payload)
        elif coding == "deflate":
            payload = zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    said = re.search(r"charset=[\"']?([\w.:-]+)", value(headers, "Content-Type") or "")
    meta = re.search(rb"<meta\b[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload, re.I) if b"charset" in payload.lower() else None
    for name in [x for x in (said and said[1], meta and meta[1].decode("latin-1")) if x]:
        try:
            return payload.decode(name, "replace")
        except LookupError:
            continue
    return payload.decode("utf-8", "replace")


def plain(markup: str) -> tuple[str, str, list[str]]:
    """Text (a line a block, white space collapsed, scripts and styles left out), title and links (decoded)."""
    page = Page(markup)
    lines, line, title = [], [], []
    for path, _, _, text in [*page.texts, (None, False, False, "")]:
        if path is not None:
            (title if path.rpartition("/")[2] == "title" else line).append(text)
        elif line:
            said = " ".join("".join(line).split())
            lines += [said] if said else []
            line = []
    return "\n".join(lines), " ".join("".join(title).split()), page.links


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata record and, for text, the conversion record of a response; nothing for other records."""
    if (value(headers, "WARC-Type") or "").lower() != "response":
        return []
    of = value(headers, "WARC-Record-ID") or named(digest(block))
    status, sent, payload = http(block)
    kind = (value(sent, "Content-Type") or "").partition(";")[0].strip().lower()
    # digests that the source states are kept, others worked out
    whole = value(headers, "WARC-Block-Digest") or digest(block)
    inner = value(headers, "WARC-Payload-Digest") or digest(payload)
    is_html = kind in ("text/html", "application/xhtml+xml", "")
    is_text = is_html or kind.startswith("text/")
    markup = decoded(sent, payload) if is_text else ""
    text, title, links = plain(markup) if is_html else (markup, "", [])
    meta_id, text_id = named(f"metadata {of}"), named(f"conversion {of}")

    same: Headers = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if (v := value(headers, k)) is not None]
    fields: Headers = [("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in sent]]
    fields += [("source-block-digest", whole), ("source-payload-digest", inner), ("source-length", str(len(block)))]
    fields += [("title", title)] if title else []
    fields += [("outlink", x) for x in links]
    said = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)

    def record(kind: str, own: str, other: str | None, media: str, body: bytes) -> tuple[Headers, bytes]:
        out: Headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", of), *same]
        out += [("WARC-Concurrent-To", other)] if other else []
        out += [("WARC-Block-Digest", digest(body)), ("Content-Type", media), ("Content-Length", str(len(body)))]
        return out, body

    out = [record("metadata", meta_id, text_id if is_text else None, "application/warc-fields", said)]
    if is_text:
        out.append(record("conversion", text_id, meta_id, "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")))
    return out


def response(page_id: int | None, url: str | None, markup: str, date: str) -> bytes:
    """A response record for a page that was fetched as UTF-8 HTML. Without an address it has no target."""
    payload = markup.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    inner = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", named(f"{page_id} {url} {inner}"))]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", inner), ("WARC-Block-Digest", digest(block))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return write(headers, block)


#: When the pages count as fetched, where that is not known.
DATE = "2024-01-01T00:00:00Z"

RESPONSES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record", T.BinaryType())])
DERIVED = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type")]
    + [T.StructField("content_length", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("block_digest", "source_payload_digest")]
    + [T.StructField("record", T.BinaryType())]
)


def responses(pages: DataFrame, date: str = DATE, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, record``: each page as a WARC response record (null pages: an empty payload)."""

    def make():
        return lambda cols: [cols[0], [response(i, u, t, date) for i, u, t in zip(*cols)]]

    columns = [F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html")]
    return common.map_texts(pages, columns, 2, make, RESPONSES)


def derivatives(values: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """DERIVED: the metadata and conversion records of every response in the binary column ``record``.

    A value may hold several records one after another. A stretch that is no whole record gives one row of
    ``record_type`` "unreadable" with its length; other records than responses, and nulls, give none. Equal
    responses give equal records.
    """
    common.ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(DERIVED)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py() or b""
                for found in records(iter([raw])):
                    if isinstance(found, int):
                        rows.append((key, "unreadable", None, None, None, None, None, found, None, None, None))
                        continue
                    headers, block, _, _ = found
                    for own, body in derive(headers, block):
                        get = dict(own).get
                        inner = value(headers, "WARC-Payload-Digest") or digest(http(block)[2])
                        rows.append(
                            (key, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"),
                             get("Content-Type"), len(body), get("WARC-Block-Digest"), inner, write(own, body))
                        )
                        held += len(body)
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return values.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{record}`").alias("record")).mapInArrow(run, DERIVED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, record, skipped``: the records of WARC files (plain or gzip), one row a record; a stretch that is
    no whole record has no record and its length as ``skipped``.

    A file is one task's work, as a compressed file has to be read from its beginning, and must be under 2 GB;
    it is unpacked piece by piece.
    """
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in records(unpacked(data.as_py())):
                    lost = isinstance(found, int)
                    record = None if lost else write(found[0], found[1])
                    columns = [pa.array([name]), pa.array([record], pa.binary()), pa.array([found if lost else 0], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "record", "skipped"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record binary, skipped long")
