"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

A worker writes one file for its part of the responses: a warcinfo record, then for each response
its metadata (JSON: the source's headers and digests, title and outlinks) and its conversion (text),
each record a gzip member of its own.  Both carry WARC-Refers-To with the response's record id,
WARC-Refers-To-Target-URI and -Date; the metadata names the conversion, and both give their block
digests besides the response's payload digest.  Record ids are derived from the response's id, so a
repeated run or task writes the same ids.  An index table (file, offset, length, type, ids) is
committed by Spark and names the files of the tasks that succeeded; a retried task leaves at most a
file that nothing refers to.  Paths are URIs of any store that pyarrow opens.

Responses of WARC files keep their payload as bytes and their record's headers: the digests that the record
declares are copied, and computed from the bytes only where it has none.  The payload is read by its
transfer and content coding (chunked, gzip, deflate) and its charset (byte order mark, HTTP, meta, else
UTF-8).  Text that is no page is converted line by line; other media types and codings have an empty
conversion, and the metadata says why.

Nulls and ties: a null body is an empty one; a null URL becomes urn:page:<id>; a null id stays null;
repeated rows give records with equal ids; other columns are ignored; an empty table gives no files.  A record is held
whole, with its text, so a very long body takes some six times its size in the worker.  Records that are cut off or can't be
read are reported in `damage` (responses_from_warc) and in the metadata, not dropped.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import store

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs

# What a construct begins with; _Markup finds its end.
_OPEN = re.compile(r"<(?:(!--)|(script|style|template|noscript)\b|([!?])|(/?)([a-z][a-z0-9:-]*+))", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "template", "noscript")}
_SPECIAL = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:-]{0,64}+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
#: Comments, scripts and styles as far as they go, or a meta element.
_META = re.compile(rb"<!--(?:[^-]|-(?!->))*+(?:-->)?|<(?:script|style)\b(?:[^<]|<(?!/(?:script|style)))*+|<(meta\b[^>]*+)", re.I)
# Elements that end a line of text, and attributes that hold links.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "source": "src"}


class _Markup:
    """Comments, hidden elements, declarations and tags of a body, in linear time whatever their length.

    What a search has shown is remembered: the next `>`, the next character that ends a tag or opens a
    value, and the opening quotes from which no end of a tag is reached."""

    def __init__(self, body: str):
        self.body, self.hopeless = body, set()
        self.close = self.special = -1

    def after_close(self, at: int) -> int:
        """The place after the next `>`, or 0."""
        if self.close < at:
            found = self.body.find(">", at)
            self.close = len(self.body) if found < 0 else found
        return self.close + 1 if self.close < len(self.body) else 0

    def after_tag(self, at: int) -> int:
        """The place after the `>` outside of quotes, or 0."""
        if self.special < at:
            found = _SPECIAL.search(self.body, at)
            self.special = found.start() if found else len(self.body)
        spot, opened = self.special, []
        while spot < len(self.body):
            quote = self.body[spot]
            if quote == ">":
                return spot + 1
            if spot in self.hopeless:
                break
            opened.append(spot)
            end = self.body.find(quote, spot + 1)
            found = _SPECIAL.search(self.body, end + 1) if end >= 0 else None
            spot = found.start() if found else len(self.body)
        self.hopeless.update(opened)
        return 0

    def __iter__(self):
        """(start, end, hidden, closing, name, attributes) of each construct, in order."""
        at = 0
        while m := _OPEN.search(self.body, at):
            comment, hidden, declared, closing, name = m.groups()
            attributes = None
            if comment:
                found = self.body.find("-->", m.end())
                end = found + 3 if found >= 0 else len(self.body)
            elif hidden:
                found = _CLOSE[hidden.lower()].search(self.body, m.end())
                end = found.end() if found else len(self.body)
                attributes = self.body[m.end() : self.after_tag(m.end()) or self.after_close(m.end())] if hidden.lower() == "script" else None
            elif declared:
                end = self.after_close(m.end())
            else:
                end = self.after_tag(m.end())
                attributes = self.body[m.end() : end - 1] if end else None
            if end:
                yield m.start(), end, hidden, closing, name, attributes
            at = end or m.end()


def convert(body: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of an HTML page.  Text keeps a line for each block element."""
    parts: list[str] = []
    links: list[str] = []
    title: list[str] | None = None
    titled = ""
    at = 0
    for start, end, hidden, closing, name, attributes in _Markup(body):
        if start > at:
            piece = body[at:start]
            parts.append(piece)
            if title is not None:
                title.append(piece)
        at = end
        if hidden is not None and hidden.lower() == "script":
            name, closing = "script", ""
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS:
            parts.append("\n")
        if name == "title":
            if closing and title is not None:
                titled, title = titled or " ".join(html.unescape("".join(title)).split()), None
            elif not closing:
                title = []
        if not closing and name in _LINKS and attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                if key.lower() == _LINKS[name]:
                    links.append(html.unescape(a or b or c).strip())
    parts.append(body[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), titled, links


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(10).join(map(str, of)))}>"


def record(kind: str, id_: str, date: str, content_type: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One record as a gzip member."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": id_, "WARC-Date": date, **headers, "WARC-Block-Digest": digest_of(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _line(value: str) -> str:
    """A header's value keeps to its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


_HEAD_END = re.compile(rb"\r?\n\r?\n")


class Headers(list):
    """(name, value) pairs in order; names are looked up whatever their case, and may repeat."""

    def all(self, name: str) -> list[str]:
        return [v for k, v in self if k.lower() == name.lower()]

    def get(self, name: str, default: str | None = None) -> str | None:
        name = name.lower()
        for k, v in self:
            if len(k) == len(name) and k.lower() == name:
                return v
        return default

    def named(self) -> dict[str, str | list[str]]:
        """As an object: a name that repeats has the list of its values."""
        names: dict[str, str] = {}
        for k, _ in self:
            names.setdefault(k.lower(), k)
        return {k: found[0] if len(found := self.all(k)) == 1 else found for k in names.values()}


def _plain(source, step: int):
    """(bytes, damage) of a file: gzip members, one after another, or the file as it is."""
    def two(held: bytes) -> bytes:
        """With the two bytes that tell a gzip member, if there are as many."""
        while len(held) < 2 and (part := source.read(step)):
            held += part
        return held

    held = two(b"")
    if held[:2] != b"\x1f\x8b":
        while held:
            yield held, None
            held = source.read(step)
        return
    while held:
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not held and not (held := source.read(step)):
                yield b"", "gzip member cut off"
                return
            try:
                out = unpacker.decompress(held, 1 << 20)
            except zlib.error as error:
                yield b"", f"gzip: {error}"
                return
            held = unpacker.unconsumed_tail or unpacker.unused_data
            if out:
                yield out, None
            elif not held and unpacker.eof:
                break
        held = two(held)
        if held and held[:2] != b"\x1f\x8b":
            if held.strip(b"\0"):
                yield b"", "bytes behind the last gzip member"
            return


def members(source, step: int = 1 << 16):
    """(headers, block, damage) of a file's records: plain, or gzipped by record, by several or as a whole.  damage says
    what is wrong with a record that is cut off or has no header that can be read (then the rest of the
    file is given up); else it is None.  One record is held at a time."""
    parts, damage = _plain(source, step), None
    held = bytearray()

    def more() -> bool:
        nonlocal damage
        part, damage = next(parts, (b"", damage or "end"))
        held.extend(part)
        return damage is None

    while True:
        while True:  # the empty lines between records
            rest = held.lstrip(b"\r\n")
            if rest or not more():
                break
        held = bytearray(rest)
        if not held:
            if damage not in (None, "end"):
                yield Headers(), b"", damage
            return
        at = 0
        while not (end := _HEAD_END.search(held, max(0, at - 4))):
            at = len(held)
            if at > 1 << 20 or not more():
                yield Headers(), b"", "no record header" if damage in (None, "end") else damage
                return
        head = bytes(held[: end.start()]).decode(errors="replace")
        lines = (re.sub(r"\r?\n[ \t]+", " ", head) if "\n " in head or "\n\t" in head else head).splitlines()
        headers = Headers((k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:]))
        length = headers.get("Content-Length") or ""
        if not lines[0].startswith("WARC/") or not length.isascii() or not length.isdigit():
            yield headers, b"", "no record header" if not lines[0].startswith("WARC/") else "no Content-Length"
            return
        stop = end.end() + int(length)
        while len(held) < stop and more():
            pass
        short = len(held) < stop
        block = bytes(held[end.end() : stop])
        held = held[stop:]
        yield headers, block, f"cut off after {len(block)} of {length} bytes" if short else None
        if short:
            return


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as responses: source_id, url, date, headers (of HTTP), body.  The record id is made later, from url, id and payload."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("source_id"), url.alias("url"), F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("headers"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("body"), F.lit(None).cast("string").alias("record_id"))


def response_record(source_id, url: str, date: str, headers: str, body: str) -> bytes:
    """A response as a record, as a crawler would have written it."""
    payload = body.encode()
    return record("response", response_id(source_id, url, payload), date, "application/http; msgtype=response", headers.encode() + b"\r\n\r\n" + payload, {"WARC-Target-URI": url, "WARC-Payload-Digest": digest_of(payload)})


def response_id(source_id, url: str, payload: bytes) -> str:
    return record_id("response", url, source_id, digest_of(payload))


def responses_from_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Responses of WARC files, plain or gzipped, each with its payload's bytes, its record's headers (JSON) and damage:
    null, or what is wrong with the record, whose payload is then what there is of it.  Of a record whose type can't be
    read a row tells the damage.  files: a column `file` of URIs."""
    names = ["source_id", "url", "date", "headers", "body", "record_id", "payload", "warc", "damage"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string(), pa.string()]

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = store(uri)
                with system.open_input_stream(path, compression=None) as source:
                    for at, (h, block, damage) in enumerate(members(source)):
                        if (h.get("WARC-Type") or "").lower() == "response" or damage and not h.get("WARC-Type"):
                            head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                            if not h.get("WARC-Block-Digest"):
                                h.append(("WARC-Block-Digest", digest_of(block)))
                            url = h.get("WARC-Target-URI") or f"urn:record:{at}"
                            row = [None, url, h.get("WARC-Date"), head.decode("latin-1"), None, h.get("WARC-Record-ID") or record_id("response", uri, at), payload, json.dumps(h.named()), damage]
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    return files.select("file").mapInArrow(read, "source_id long, url string, date string, headers string, body string, record_id string, payload binary, warc string, damage string")


def _dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer; as it is if it isn't one (many crawlers store the body without chunks)."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at, at + 4096)
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,16})[ \t]*(?:;.*)?", data[at:end] if end >= 0 else b"")
        if not size:
            return data
        size, at = int(size[1], 16), end + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            return data
        parts.append(data[at : at + size])
        at += size + 2


def _unpacked(data: bytes, coding: str) -> bytes | None:
    """The data without a content coding; None if it is unknown or the data are damaged."""
    if coding in ("", "identity"):
        return data
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    for bits in (47,) if coding != "deflate" else (47, -15):
        try:
            parts, rest = [], data
            while rest:  # members of a gzip file
                unpacker = zlib.decompressobj(bits)
                parts.append(unpacker.decompress(rest) + unpacker.flush())
                if not unpacker.eof:
                    raise zlib.error("cut off")
                rest = unpacker.unused_data if unpacker.unused_data[:2] == b"\x1f\x8b" else b""
            return b"".join(parts)
        except zlib.error:
            continue
    return None


def read_payload(headers: str, payload: bytes) -> tuple[str | None, dict]:
    """(text, how it was read) of a response's payload.  The text is None if the response is none: of another
    media type, or in a coding that isn't read; `unread` then says why."""
    fields: dict[str, list[str]] = {}
    for line in headers.split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields.setdefault(key.strip().lower(), []).append(value.strip())
    kind, _, more = "".join(fields.get("content-type", [])[-1:]).partition(";")
    kind = kind.strip().lower()
    codings = [c.strip().lower() for name in ("content-encoding", "transfer-encoding") for v in fields.get(name, ()) for c in v.split(",")]
    for coding in reversed(codings):
        data = _dechunked(payload) if coding == "chunked" else _unpacked(payload, coding)
        if data is None:
            return None, {"type": kind, "unread": f"content coding {coding}"}
        payload = data
    if not kind:  # undeclared: a page if it looks like one
        looks = re.match(rb"(?:\xef\xbb\xbf)?\s*+<(?:!doctype|html|head|body|title|p\b|div|!--)", payload, re.I)
        kind = "text/html" if looks else "text/plain" if b"\0" not in payload and _is_utf8(payload) else "application/octet-stream"
    page = kind in ("text/html", "application/xhtml+xml")
    if not (page or kind.startswith("text/") or kind in ("application/json", "application/xml", "application/javascript") or kind.endswith(("+json", "+xml")) and not kind.startswith("image/")):
        return None, {"type": kind, "unread": f"media type {kind}"}
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    declared = re.search(r"""charset\s*=\s*["']?([^\s"';,]+)""", more, re.I)
    inside = re.search(rb"""charset\s*=\s*["']?([a-z0-9_:.-]+)""", _meta(payload), re.I) if page else None
    charset = next((c for m, c in marks if payload.startswith(m)), None) or (declared[1] if declared else inside[1].decode() if inside else "utf-8")
    charset = "cp1252" if charset.lower() in ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii") else charset  # as browsers read them
    try:
        text = payload.decode(charset, "replace")
    except (LookupError, ValueError):
        charset, text = "utf-8", payload.decode(errors="replace")
    return text, {"type": kind, "charset": charset.lower()}


def _meta(page: bytes) -> bytes:
    """The first meta element that names a charset, wherever it stands; comments and scripts are no elements."""
    for found in _META.finditer(page):
        if found[1] and b"charset" in found[1].lower():
            return found[1]
    return b""


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def _first(headers: dict, name: str) -> str | None:
    """A header's first value, whatever its name's case."""
    found = next((v for k, v in headers.items() if k.lower() == name.lower()), None)
    return found[0] if isinstance(found, list) else found


def derive(source_id, url: str, date: str, headers: str, body: str | None, source_record: str | None, made: str, raw: bytes | None = None, warc: str | None = None, damage: str | None = None) -> tuple[tuple[str, bytes], tuple[str, bytes]]:
    """((id, metadata record), (id, conversion record)) of one response: its body as text, or the raw payload with
    the headers of its WARC record (JSON).  A response that isn't text has an empty conversion and no title or links."""
    payload = body.encode() if raw is None else raw
    source_record = source_record or response_id(source_id, url, payload)
    source, how = json.loads(warc or "{}"), {}
    if raw is not None:
        body, how = read_payload(headers, raw)
    if body is None or how.get("type", "text/html") not in ("text/html", "application/xhtml+xml"):
        lines = (" ".join(line.split()) for line in (body or "").split("\n"))
        text, title, links = "\n".join(line for line in lines if line), "", []
    else:
        text, title, links = convert(body)
    block, payload_digest = text.encode(), _first(source, "WARC-Payload-Digest") or digest_of(payload)
    metadata_id, conversion_id = record_id("metadata", source_record), record_id("conversion", source_record)
    about = {
        "source_id": source_id, "url": url, "response": {"record_id": source_record, "date": date, "http": headers.split("\r\n"), "payload_digest": payload_digest, "payload_length": len(payload)},
        "conversion": {"record_id": conversion_id, "digest": digest_of(block), "chars": len(text)}, "title": title, "links": links,
    }
    if raw is not None:
        about["response"] |= {"warc": source, "block_digest": _first(source, "WARC-Block-Digest")} | ({"damage": damage} if damage else {})
        about["conversion"] |= how
    refers = {"WARC-Target-URI": url, "WARC-Refers-To": source_record, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date}
    metadata = record("metadata", metadata_id, made, "application/json", json.dumps(about, ensure_ascii=False).encode(), refers)
    conversion = record("conversion", conversion_id, made, "text/plain; charset=utf-8", block, {**refers, "WARC-Source-Payload-Digest": payload_digest})
    return (metadata_id, metadata), (conversion_id, conversion)


def write_derivatives(responses: DataFrame, folder: str, made: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the derivatives of all responses to `folder` and returns their index, read from there."""
    columns = {"part": pa.int32(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "type": pa.string(), "record_id": pa.string(), "refers_to": pa.string()}

    def write(batches):
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None:
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    files, path = store(f"{folder}/warc")
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    about = record("warcinfo", record_id("warcinfo", name), made, "application/warc-fields", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": name})
                    out.write(about)
                    at = len(about)
                raw = row.get("payload")
                source = row["record_id"] or response_id(row["source_id"], row["url"], row["body"].encode() if raw is None else raw)
                for kind, (id_, data) in zip(("metadata", "conversion"), derive(row["source_id"], row["url"], row["date"], row["headers"], row["body"], source, made, raw, row.get("warc"), row.get("damage"))):
                    out.write(data)
                    rows.append((part, f"warc/{name}", at, len(data), kind, id_, source))
                    at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))
        if out is not None:
            out.close()

    spec = "part int, file string, offset long, length long, type string, record_id string, refers_to string"
    more = [c for c in ("payload", "warc", "damage") if c in responses.columns]
    responses.select("source_id", "url", "date", "headers", "body", "record_id", *more).mapInArrow(write, spec).write.parquet(f"{folder}/index")
    return responses.sparkSession.read.schema(spec).parquet(f"{folder}/index")


def read_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each response, from the files: ids, what they refer to, digests, title, links and text."""
    files = spark.read.parquet(f"{folder}/index").select("part", "file").distinct()
    spec = "source_id long, url string, response_id string, metadata_id string, conversion_id string, payload_digest string, text_digest string, title string, links array<string>, text string"
    names = [c.split()[0] for c in spec.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 7, pa.list_(pa.string()), pa.string()]

    def read(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, size, about = [], 0, {}
                system, path = store(f"{folder}/{file}")
                with system.open_input_stream(path, compression=None) as source:
                    for h, block, damage in members(source):
                        if damage or digest_of(block) != h.get("WARC-Block-Digest"):
                            raise ValueError(f"{h.get('WARC-Record-ID')}: {damage or 'its block differs from its digest'}")
                        if h.get("WARC-Type") == "metadata":
                            about = json.loads(block)
                            metadata_id = h.get("WARC-Record-ID")
                        elif h.get("WARC-Type") == "conversion":
                            rows.append((about["source_id"], h.get("WARC-Target-URI"), h.get("WARC-Refers-To"), metadata_id, h.get("WARC-Record-ID"), h.get("WARC-Source-Payload-Digest"), h.get("WARC-Block-Digest"), about["title"], about["links"], block.decode()))
                            size += len(block)
                            if size > 4_000_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                                rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.repartition(max(1, files.count()), "part").mapInArrow(read, spec)
