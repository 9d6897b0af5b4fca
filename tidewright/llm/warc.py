"""Dictionary-compressed WARC archives.

A record is written for each page: an HTTP response with the html as payload,
or a revisit without one. Records are gathered into archives of bounded size;
each archive starts with a skippable frame (magic 0x184D2A5D) that embeds a
Zstandard dictionary built from its own records - trained, or where they are
too few or too alike for that, of their raw content - then holds a warcinfo
record and every record in a frame of its own compressed with that dictionary,
so a record can be read with the dictionary and its byte range alone.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest id is the response, others are revisits that name it; smaller
payloads are always responses. Record ids are unique; where several rows have
the response's id, revisits name that id only, not one of their records.

Archives live in a table (archive_id, n_records, data) in the shared folder, so
that every executor and any file system that Spark reads can hold them; each
``data`` is the whole file. Pages carry no time of capture, so ``WARC-Date`` is
a parameter. Defined results: null html is an empty payload; a null url or id
leaves its header out; ids of any type that casts to text and back, and urls
with any characters, come back as they were; rows repeated with one id are
responses or revisits as other rows are; an empty table gives no archive; extra
columns are ignored; a damaged archive raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved

DICT_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 4 << 20
MIN_REVISIT = 100
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
#: Rows of the table of repeated payloads that is broadcast.
MAX_BROADCAST = 200_000
_READ = 16 << 10


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page with its payload's digest and length, the page that it revisits, and what its record is named by.

    Groups of equal payloads are pre-aggregated to their smallest id before the
    shuffle; only digests that occur more than once are joined back, by
    broadcast where they are few, so payloads stay where they were read.
    """
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    p = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    by = p.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("k"))
    by = by.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("k").alias("n"), F.min_by("k", "page_id").alias("k"))
    group = saved(by.filter("n > 1").select("digest", "first", (F.col("k") == 1).alias("sole")), "repeated")
    out = p.join(F.broadcast(group) if group.count() <= MAX_BROADCAST else group, "digest", "left")
    again = F.col("page_id") != F.col("first")
    salt = F.when(F.col("sole") & ~again, F.lit("")).otherwise(F.monotonically_increasing_id().cast("string"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return out.withColumn("refers_to", F.when(again, F.col("first"))).select(text("page_id"), "url", "payload", "digest", text("refers_to"), "sole", F.coalesce(salt, F.lit("")).alias("salt"))


def _field(text: str) -> str:
    """A header's value: as it stands, or in JSON's form where it would not come back."""
    return text if text.isprintable() and text == text.strip() and text[:1] != '"' else json.dumps(text)


def _unfield(value: str | None) -> str | None:
    return json.loads(value) if value and value[0] == '"' else value


def record_id(page_id: str | None, digest: str, salt: str = "") -> str:
    h = hashlib.sha256(f"{page_id}|{digest}|{salt}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _put(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    block = b"software: tidewright\r\nformat: WARC File Format 1.1\r\n"
    return _put(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], block)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, sole: bool | None = None, salt: str = "", date: str = DATE) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, salt)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {_field(str(page_id))}")
    if url is not None:
        plain = _field(url)
        head.append("WARC-Target-URI: " + (url if plain == url else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)))
        if plain != url:
            head.append(f"X-Target-URI: {plain}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {_field(str(refers_to))}"]
        if sole:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        payload = b""
    head.append("Content-Type: application/http; msgtype=response")
    return _put(head, http + payload)


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from evenly spaced whole records, of together about SAMPLE_BYTES.

    Trained where the samples allow it, else their raw content, at least 8 bytes.
    """
    import zstandard

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(max(256, min(DICT_BYTES, sum(map(len, samples)) // 8)), samples, k=64, d=8, f=18, accel=4, steps=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # too few samples, or too alike
        return b"".join(samples)[:DICT_BYTES].ljust(8, b" ")


def archive(records: list[bytes], level: int = 3) -> bytes:
    """One file: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    d = dictionary(records)
    held = zstandard.ZstdCompressionDict(d)
    c = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(d)), d, *map(c.compress, records)])


def records(data: bytes):
    """The records of a file, in order."""
    import zstandard

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    n = struct.unpack_from("<I", data, 4)[0]
    if 8 + n > len(data):
        raise ValueError("the dictionary frame is cut short")
    d = data[8 : 8 + n]
    try:
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
    except zstandard.ZstdError as e:
        raise ValueError(f"the dictionary is damaged: {e}") from e
    view, at = memoryview(data), 8 + n
    while at < len(view):
        frame, out = z.decompressobj(), []
        while not frame.eof:  # fed by pieces: what a frame leaves of one is all that is read twice
            piece = view[at : at + _READ]
            if not len(piece):
                raise ValueError("a record's frame is cut short")
            try:
                out.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"a record's frame is damaged: {e}") from e
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(rec: bytes) -> tuple[dict, bytes]:
    """The header fields and the block of a record."""
    head, sep, body = rec.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
    except (KeyError, ValueError) as e:
        raise ValueError(f"a record's header is damaged: {e}") from e
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    if body[n:] != b"\r\n\r\n":
        raise ValueError("a record has a wrong length")
    return fields, body[:n]


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The archives of a table of pages; a task holds one archive's records at a time."""

    def run(batches):
        part, size = [], 0

        def flush():
            name = hashlib.sha256(b"".join(hashlib.sha256(r).digest() for r in part)).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(part)], pa.int32()), pa.array([archive([info(name), *part])], pa.binary())], ["archive_id", "n_records", "data"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = record(*row)
                part.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    part, size = [], 0
        if part:
            yield flush()

    return plan(pages, key, url, html).mapInArrow(run, "archive_id string, n_records int, data binary")


def read(archives: DataFrame, kind: str = "long") -> DataFrame:
    """One row for each page's record; a response's payload is read back and its digest verified. ``kind`` is the type of the ids."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for rec in records(data):
                    h, block = parse(rec)
                    if h.get("WARC-Type") == "warcinfo":
                        continue
                    try:
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        of = h["WARC-Type"]
                    except (KeyError, ValueError) as e:
                        raise ValueError(f"a record's header is damaged: {e}") from e
                    body = block.partition(b"\r\n\r\n")[2]
                    if of == "response" and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError("a payload does not match its digest")
                    rows.append((_unfield(h.get("X-Page-ID")), _unfield(h["X-Target-URI"]) if "X-Target-URI" in h else h.get("WARC-Target-URI"), n, digest, of, _unfield(h.get("X-Refers-To-Page-ID"))))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = archives.select("data").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives to the shared folder, then read every record back from them."""
    return read(saved(write(pages, key, url, html), "warc"), pages.schema[key].dataType.simpleString())
