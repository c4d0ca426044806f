"""WARC derivatives: metadata and conversion records linked to response records.

From each response two records follow: ``metadata`` (application/warc-fields) keeps
the source's WARC and HTTP headers, its digests and what was found in the page;
``conversion`` (text/plain) holds the page's visible text. Both name the response in
WARC-Refers-To, its address and its date, and carry their own digests. Identifiers
are made from the source's identifier, so a second run gives the same records.

Digests are SHA-1 in base 32, as crawlers write them. HTTP bodies in chunks or
compressed by gzip or deflate are decoded first; the text's encoding is that of the
HTTP header, else of a <meta> tag, else UTF-8, with replacement of what is invalid.
Content that is neither HTML nor text has a metadata record only. A declared payload
digest that does not fit is kept and marked ``digest-mismatch``. A body that would
grow beyond ``MOST_BODY`` when decompressed stays as it came.

Edge cases: a null html is an empty payload (an empty conversion), a null url an
empty target; repeated rows give repeated records of one id (the same response);
a record without an id is named by its target, date and block; an empty table gives
no rows.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .htmlmain import Page, tags

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
EPOCH = "1970-01-01T00:00:00Z"
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
_LANG = re.compile(r"""(?:^|\s)lang\s*=\s*["']?([\w-]+)""", re.I)
_TITLE = re.compile(r"<title\b", re.I)
_END_TITLE = re.compile(r"</title", re.I)
MOST_BODY = 256 << 20


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.headers if k.lower() == name.lower()), default)

    def head(self) -> str:
        return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers)

    def to_bytes(self) -> bytes:
        return self.head().encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(sha1(data).digest()).decode()


def identifier(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(names))}>"


def response(target: str, payload: bytes, name: str, date: str = EPOCH, content_type: str = "text/html; charset=utf-8") -> Record:
    """A response record as a crawler would write it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return Record([
        ("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", name, target, digest(payload))), ("WARC-Target-URI", target), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block))),
    ], block)


def records(stream: io.BufferedIOBase | bytes) -> Iterator[Record]:
    """Records of a WARC file, one after the other; plain or gzipped (per record or as a whole)."""
    f = io.BytesIO(stream) if isinstance(stream, bytes) else stream
    if (start := f.read(2)) == b"\x1f\x8b":
        f.seek(0)
        f = gzip.GzipFile(fileobj=f)
    else:
        f.seek(-len(start), 1)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: list[tuple[str, str]] = []
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and headers:  # a folded line
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                k, _, v = text.partition(":")
                headers.append((k.strip(), v.strip()))
        own = Record(headers, b"")
        size = own.get("Content-Length", "0")
        own.block = f.read(int(size) if size.isdigit() else 0)
        yield own


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, headers, body as it came, and decoded body of an HTTP response."""
    ends = [(at, len(end)) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    at, gap = min(ends, default=(len(block), 0))
    raw = block[at + gap :]
    lines = block[:at].decode("latin-1").splitlines() or [""]
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    named = {k.lower(): v.lower() for k, v in headers}
    body = raw
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            body = _unchunked(body)
        if "gzip" in (coding := named.get("content-encoding", "")):
            body = _inflated(body, 31)
        elif "deflate" in coding:
            body = _inflated(body, 15 if body[:1] == b"\x78" else -15)
    except (ValueError, zlib.error):
        pass  # what cannot be decoded stays as it came
    return lines[0], headers, raw, body


def _inflated(body: bytes, wbits: int) -> bytes:
    """All members of a compressed body; ValueError if they are cut off or hold more than MOST_BODY."""
    out, room = [], MOST_BODY
    while body:
        member = zlib.decompressobj(wbits)
        out.append(member.decompress(body, room + 1))
        room -= len(out[-1])
        if room < 0 or not member.eof:
            raise ValueError("cut off or too long")
        body = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _text(content_type: str, body: bytes) -> str:
    named = _CHARSET.search(content_type) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def facts(markup: str) -> tuple[str | None, str | None, int]:
    """Title, language of the html element, and number of links of a page; None what it lacks. Linear in the page."""
    title = language = None
    links = 0
    for begin, end, name, closes, attributes in tags(markup):
        if not name:
            if title is None and _TITLE.match(markup, begin) and (to := markup.find(">", begin, end) + 1):
                ended = _END_TITLE.search(markup, to, end)
                if ended:
                    title = " ".join(unescape(markup[to : ended.start()]).split())
        elif closes:
            continue
        elif name == "html" and language is None and (m := _LANG.search(attributes)):
            language = m[1]
        elif name == "a" and attributes:
            links += 1
    return title, language, links


def derive(source: Record) -> list[Record]:
    """The metadata record of a response, and its conversion record if it holds HTML or text."""
    status, headers, raw, body = http_parts(source.block)
    named = {k.lower(): v for k, v in headers}
    kind = named.get("content-type", "").split(";")[0].strip().lower()
    declared = source.get("WARC-Payload-Digest")
    fields = [("source-" + k.lower(), v) for k, v in source.headers] + [("http-status", status)] + [("http-" + k.lower(), v) for k, v in headers]
    if declared and declared not in (digest(raw), digest(body)):
        fields.append(("digest-mismatch", digest(raw)))
    text = None
    if kind in ("text/html", "application/xhtml+xml", ""):
        markup = _text(named.get("content-type", ""), body)
        text = Page(markup).visible_text()
        title, language, links = facts(markup)
        if title is not None:
            fields.append(("title", title))
        if language is not None:
            fields.append(("language", language))
        fields.append(("outlinks", str(links)))
    elif kind.startswith("text/"):
        text = _text(named.get("content-type", ""), body)
    if text is not None:
        fields.append(("text-characters", str(len(text))))
    own = source.get("WARC-Record-ID") or identifier("nameless", source.get("WARC-Target-URI"), source.get("WARC-Date"), digest(source.block))
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode())]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    out = []
    for what, content_type, block in made:
        out.append(Record([
            ("WARC-Type", what), ("WARC-Record-ID", identifier(what, own)), ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", source.get("WARC-Target-URI")),
            ("WARC-Refers-To-Date", source.get("WARC-Date")), ("WARC-Target-URI", source.get("WARC-Target-URI")), ("WARC-Date", source.get("WARC-Date")),
            ("Content-Type", content_type), ("WARC-Payload-Digest", digest(block)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block))),
        ], block))
    return out


def _line(value: str) -> str:
    return " ".join(value.split("\n")).replace("\r", " ")


FIELDS = [
    ("warc_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"),
    ("content_type", "Content-Type"), ("block_digest", "WARC-Block-Digest"),
]
SCHEMA = "page_id long, " + ", ".join(f"{name} string" for name, _ in FIELDS) + ", content_length long, source_payload_digest string, header string, block string"


def derivatives(pages: DataFrame) -> DataFrame:
    """The metadata and conversion records of every row's response."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    source = response(" ".join((url or "").split()), (html or "").encode("utf-8", "replace"), str(page_id))
                    for r in derive(source):
                        rows.append((page_id, *(r.get(k) for _, k in FIELDS), len(r.block), source.get("WARC-Payload-Digest"), r.head(), r.block.decode()))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                kinds = [pa.int64() if n in ("page_id", "content_length") else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)


def write_warc(made: DataFrame, path: str) -> None:
    """Writes derivative records as gzipped WARC files, one for each partition; a file is one gzip member."""
    made.select(F.concat("header", F.lit("\r\n"), "block")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: What stands between records.
BETWEEN = b"\r\n\r\nWARC/"
_HEAD = re.compile(rb"WARC/\d+\.\d+\r?\n(?:[A-Za-z][\w-]*[ \t]*:[^\n]*\n(?:[ \t][^\n]*\n)*)+\r?\n")
_LENGTH = re.compile(rb"^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_TYPE = re.compile(rb"^warc-type[ \t]*:", re.I | re.M)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map), block (binary) and broken of every record of the WARC files at ``path``, plain or gzipped.

    Files are read as lines that end where a record does, so a task holds one record
    at a time. A block that holds such an end itself is put together again by its
    declared length, as far as its split goes. Where something that reads like a
    record's head (its version, WARC-Type and Content-Length) stands inside a block
    that the rest of the split cannot fill, the length is held to be wrong: the block
    ends there, the record is marked ``broken``, and reading starts anew at that head.
    So one wrong length costs no other record. A head inside a block that does fill
    its length belongs to the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Pieces()
        for b in batches:
            for piece in b.column(0):
                yield from (_row(r, broken) for r, broken in open_.add(piece.as_py()))
        yield from (_row(r, broken) for r, broken in open_.rest())

    pieces = spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, "headers map<string,string>, block binary, broken boolean")


class Pieces:
    """Pieces of a split that make up records: one waits until its declared length is there."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size = self.wanted = 0

    def add(self, piece: bytes) -> Iterator[tuple[Record, bool]]:
        """The record that ends with ``piece``, if one does."""
        if self.held:
            self.held.append(BETWEEN + piece)
            self.size += len(self.held[-1])
        else:
            whole = b"WARC/" + piece.removeprefix(b"WARC/")
            if (wanted := _wanted(whole)) is None:
                return
            self.held, self.size, self.wanted = [whole], len(whole), wanted
        if self.size >= self.wanted:
            yield _joined(self.held, self.wanted)
            self.held = []

    def rest(self) -> Iterator[tuple[Record, bool]]:
        """What the end of the split leaves open: records that it cannot fill end at the next head."""
        held, at = self.held, 0
        left = sum(map(len, held))
        while at < len(held):
            wanted, to, size = _wanted(_piece(held, at)), at + 1, len(_piece(held, at))
            if wanted is None or wanted > left:
                while to < len(held) and not _starts(_piece(held, to)):
                    size += len(held[to])
                    to += 1
            else:
                while size < wanted and to < len(held):
                    size += len(held[to])
                    to += 1
            yield _joined([_piece(held, at), *held[at + 1 : to]], wanted)
            left -= sum(map(len, held[at:to]))
            at = to
        self.held = []


def _piece(held: list[bytes], k: int) -> bytes:
    """A piece as the beginning of a record."""
    return held[k].removeprefix(BETWEEN[:4])


def _wanted(whole: bytes) -> int | None:
    """The bytes of a record that begins so; None if it does not begin like one."""
    head = _HEAD.match(whole)
    if not head:
        return None
    named = _LENGTH.search(head[0])
    return head.end() + int(named[1] if named else 0)


def _joined(pieces: list[bytes], wanted: int | None) -> tuple[Record, bool]:
    """A record of all bytes of ``pieces``, and whether its length is wrong."""
    whole = b"".join(pieces)
    own = next(records(whole))
    at = _HEAD.match(whole).end()
    if wanted is not None and len(whole) >= wanted and not whole[wanted:].strip(b"\r\n"):
        return own, False
    own.block = whole[at:]
    return own, True


def _starts(piece: bytes) -> bool:
    head = _HEAD.match(piece)
    return bool(head and _LENGTH.search(head[0]) and _TYPE.search(head[0]))


def _row(r: Record, broken: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.headers], pa.map_(pa.string(), pa.string())), pa.array([r.block], pa.binary()), pa.array([broken])], ["headers", "block", "broken"])


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every row of ``pages``, taken as a crawl's response."""
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
