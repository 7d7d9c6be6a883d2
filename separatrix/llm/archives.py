"""Legacy ARC archives, WARC archives, and the way from one to the other.

Writers are Spark's text writer with the record separator of the format, so files go to
any store Spark can reach and a lost task is simply written again. Readers take
compressed files whole from Spark, but unpack and cut them record by record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.storage import materialize

ARC_SCHEMA = (
    "version int, url string, ip string, date string, mime string, status int, checksum string, location string, "
    "filename string, length long, block binary, problem string"
)
WARC_SCHEMA = "headers map<string,string>, block binary, problem string"
# Field names of the two header lines, in order.
VERSION_1 = ("url", "ip", "date", "mime", "length")
VERSION_2 = ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")
# Equal payloads shorter than this are all stored.
LEAST_PAYLOAD = 100
# Files stay below this size before compression, as a reader takes them whole; records above the other size are written apart.
FILE_BYTES, LARGE = 1 << 30, 1 << 20


class _Bytes:
    """Unpacks a gzip file of one or many members, or takes plain bytes, as it is read.

    Zeros behind a member are padding. What cannot be unpacked ends the file with a ``problem``.
    """

    def __init__(self, data: bytes):
        self.data, self.at, self.ready = data, 0, bytearray()
        self.packed = data[:2] == b"\x1f\x8b"
        self.unpacker, self.between, self.problem = zlib.decompressobj(31), True, None

    def _more(self) -> bool:
        if self.problem or self.at >= len(self.data):
            if self.packed and not self.between and not self.problem:
                self.problem = "gzip: the file ends within a member"
            return False
        piece = self.data[self.at : self.at + (1 << 16)]
        self.at += len(piece)
        if not self.packed:
            self.ready += piece
            return True
        try:
            while piece:
                if self.between and not (piece := piece.lstrip(b"\0")):
                    break
                self.between = False
                self.ready += self.unpacker.decompress(piece)
                if not self.unpacker.eof:
                    break
                piece, self.unpacker, self.between = self.unpacker.unused_data, zlib.decompressobj(31), True
        except zlib.error as error:
            self.problem = f"gzip: {error}"
            return False
        return True

    def line(self, end: bytes = b"\n") -> bytes | None:
        """Up to and without ``end``; None at the end of the file."""
        start = 0
        while (found := self.ready.find(end, start)) < 0:
            start = max(0, len(self.ready) - len(end) + 1)
            if not self._more():
                if not self.ready:
                    return None
                found = len(self.ready)
                break
        out = bytes(self.ready[:found])
        del self.ready[: found + len(end)]
        return out

    def take(self, length: int) -> bytes:
        while len(self.ready) < length and self._more():
            pass
        out = bytes(self.ready[:length])
        del self.ready[:length]
        return out


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _fields(head: str, version: int) -> tuple[tuple[str, ...], list[str]]:
    """Field names and fields of a header line, counted from the right, as urls may hold spaces."""
    for names in {1: (VERSION_1,), 2: (VERSION_2,)}.get(version, (VERSION_2, VERSION_1)):
        fields = head.rsplit(" ", len(names) - 1)
        if len(fields) == len(names) and fields[-1].isdigit() and (fields[2].isdigit() or fields[2] == "-"):
            return names, fields
    return (), []


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, cut by declared lengths.

    The version is that of a ``filedesc`` block at the start of the file, else it is told by
    the fields; later on such a url is that of a page. A header line that fits neither form
    ends the file with a ``problem`` record, as nothing after it can be placed; so do bytes
    that cannot be unpacked, and a block shorter than declared, which is kept.
    """
    source, version, opening = _Bytes(data), 0, True
    while (head := source.line()) is not None:
        head = head.rstrip(b"\r")
        if not head:
            continue
        describes, opening = opening and head.startswith(b"filedesc://"), False
        names, fields = _fields(_text(head), version)
        if not names:
            yield {"version": version, "problem": source.problem or "header line: " + _text(head[:200])}
            return
        record = dict(zip(names, fields, strict=True))
        length = int(record["length"])
        block = source.take(length)
        if describes:
            first = block.split(b"\n", 1)[0].split(b" ")[0]
            version = int(first) if first in (b"1", b"2") else 0
            continue
        record |= {"version": 1 if names is VERSION_1 else 2, "length": length, "block": block}
        record["status"] = int(s) if (s := record.get("status", "")).isdigit() else None
        record.pop("offset", None)
        record["problem"] = None if len(block) == length else f"block of {len(block)} bytes, {length} declared"
        yield record
    if source.problem:
        yield {"version": version, "problem": source.problem}


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of one WARC file: headers and block, cut by Content-Length."""
    source = _Bytes(data)
    while (first := source.line()) is not None:
        first = first.rstrip(b"\r")
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            yield {"headers": {}, "problem": "version line: " + _text(first[:200])}
            return
        headers = {}
        while (line := source.line()) is not None and (line := line.rstrip(b"\r")):
            name, _, value = _text(line).partition(":")
            headers[name.strip()] = value.strip()
        declared = headers.get("Content-Length", "")
        if not declared.isdigit():
            yield {"headers": headers, "problem": "no Content-Length"}
            return
        block = source.take(int(declared))
        yield {"headers": headers, "block": block, "problem": None if len(block) == int(declared) else "short block"}
    if source.problem:
        yield {"headers": {}, "problem": source.problem}


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """``path`` and record columns. Files are cut to bounded sizes by the writers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["path", *[f.split(" ")[0] for f in re.split(r",\s+", schema)]]
    # The element order of the Arrow schema is that of the Spark schema.
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [pa.field("path", pa.string())]
    for f in re.split(r",\s+", schema):
        name, kind = f.split(" ")
        types.append(pa.field(name, kinds.get(kind) or pa.map_(pa.string(), pa.string())))
    arrow = pa.schema(types)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for record in parse(content.as_py()):
                    if "headers" in record:
                        record["headers"] = list(record["headers"].items())
                    rows.append({n: record.get(n) for n in names} | {"path": where.as_py()})
                    size += len(record.get("block") or b"")
                    if size >= 1 << 22 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(cut, f"path string, {schema}")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_arc, ARC_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_warc, WARC_SCHEMA)


def sound(records: DataFrame) -> DataFrame:
    """``records`` as they are; one with a ``problem`` ends the job, as rows may be missing after it."""
    fail = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("problem"))).cast("boolean")
    return records.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(fail))


def _safe(field: Column) -> Column:
    """A header field without white space or control characters; '-' if there is nothing."""
    text = F.regexp_replace(F.coalesce(field, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.when(text == "", "-").otherwise(text)


def http_block(payload: Column, extra: Column) -> Column:
    """An HTTP response (as a string of bytes) with ``extra`` header lines before the body."""
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        extra,
        F.lit("Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload)


def write_arc(rows: DataFrame, path: str, version: int = 1, records: int = 1000) -> None:
    """Write ``url, ip, date, mime, block`` (strings) as gzip ARC files of at most ``records`` records.

    Each file begins with a version block.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    fields = [_safe(F.col(c)) for c in ("url", "ip", "date", "mime")]
    names = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
    rest: list[Column] = []
    if version == 2:
        # Result code, checksum, location, offset and file name are not known before writing.
        rest = [F.lit("200"), *[F.lit("-")] * 2, F.lit("0"), F.lit("-")]
        names[4:4] = ["Result-code", "Checksum", "Location", "Offset", "Filename"]
    line = F.concat_ws(" ", *fields, *rest, F.octet_length(block).cast("string"))
    about = f"{version} 0 separatrix\n{' '.join(names)}\n"
    opening = F.concat_ws(" ", F.lit("filedesc://separatrix.arc 0.0.0.0"), fields[2], F.lit("text/plain"), *rest, F.lit(f"{len(about)}\n{about}\n"))

    def lines(some: DataFrame, records: int) -> DataFrame:
        # The low 33 bits count a partition's rows as the writer does, which begins a file after so many.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % records == 0
        head = F.concat(F.when(first, opening).otherwise(F.lit("")), line)
        return some.select(F.concat(head, F.lit("\n"), block).alias("value"))

    _write(rows, F.octet_length(block), lines, path, "\n", records)


def _write(rows: DataFrame, size: Column, lines: Callable[[DataFrame, int], DataFrame], path: str, separator: str, records: int) -> None:
    """Write ``lines`` of the rows to files of bounded size: large records go to files of fewer records."""

    def write(some: DataFrame, name: str, records: int) -> None:
        # The fastest level takes a third of the time and gives files an eighth larger.
        writer = lines(some, records).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        writer.option("maxRecordsPerFile", records).mode("errorifexists").text(path + name)

    write(rows.filter(size <= LARGE), "", min(records, FILE_BYTES // LARGE))
    most = rows.filter(size > LARGE).agg(F.max(size)).first()[0]
    if most is not None:
        write(rows.filter(size > LARGE), "/large-records", max(1, min(records, FILE_BYTES // most)))


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def _moment(date: str | None) -> str:
    """The 14 digits of an ARC date as a WARC date; missing digits are the earliest moment."""
    digits = re.sub(r"\D", "", date or "")[:14]
    full = digits + "19700101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


CONVERTED = (
    "place long, record_id string, uri string, ip string, moment string, mime string, http binary, payload binary, "
    "payload_bytes long, payload_digest string, warc_type string"
)


def convert(arc: DataFrame, place: str = "X-Place") -> DataFrame:
    """WARC fields of ARC records: identifiers, dates, types and digests.

    ``http`` holds the bytes of the HTTP header lines, ``payload`` what follows them. A block that is no
    HTTP message becomes a ``resource`` record with the whole block as payload. ``place`` is
    a header whose whole number orders records; it is null where the header is missing.
    Records with a ``problem`` and no block are left out.
    """
    names = [f.split(" ")[0] for f in CONVERTED.split(", ")]
    kinds = {"place": pa.int64(), "http": pa.binary(), "payload": pa.binary(), "payload_bytes": pa.int64()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    number = re.compile(rb"(?im)^" + re.escape(place.encode()) + rb":[ \t]*(-?\d{1,18})[ \t]*\r?$")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block, http, payload = r["block"], None, r["block"]
                if block[:5] == b"HTTP/" and (end := re.search(rb"\r?\n\r?\n", block)):
                    http, payload = block[: end.end()], block[end.end() :]
                digest = hashlib.sha256(payload).hexdigest()
                found = number.search(http or b"")
                at = found[1].decode() if found else ""
                moment = _moment(r["date"])
                rows.append({
                    "place": int(at) if at else None, "uri": r["url"], "ip": r["ip"], "moment": moment, "mime": r["mime"],
                    "record_id": _record_id(r["url"] or "", moment, digest, at),
                    "http": http, "payload": payload, "payload_bytes": len(payload),
                    "payload_digest": digest, "warc_type": "response" if http is not None else "resource",
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return arc.filter("block is not null").select("url", "ip", "date", "mime", "block").mapInArrow(work, CONVERTED)


def mark_revisits(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Adds ``refers_to`` (place), ``refers_id`` and ``refers_uri``: null for the first record of a payload.

    The record with the smallest place comes first; payloads below ``least`` bytes and
    records without a place never refer to another. Only digests and identifiers are
    grouped, after map-side combining, so a payload that a third of all records share
    is one row by then. The groups of copies are stored, so that Spark knows their size: where
    they are few, they go to the payloads and not the payloads to them. ``records`` is read
    twice and should be stored.
    """
    narrow = records.filter((F.col("payload_bytes") >= least) & F.col("place").isNotNull())
    first = narrow.groupBy("payload_digest").agg(
        F.min("place").alias("first"), F.min_by("record_id", "place").alias("first_id"),
        F.min_by("uri", "place").alias("first_uri"), F.count(F.lit(1)).alias("copies"),
    ).filter("copies > 1").drop("copies")
    out = records.join(materialize(first, "payload-copies"), "payload_digest", "left")
    later = (F.col("first") < F.col("place")) & (F.col("payload_bytes") >= least)
    return out.select(
        *records.columns,
        *(F.when(later, F.col(c)).alias(n) for c, n in (("first", "refers_to"), ("first_id", "refers_id"), ("first_uri", "refers_uri"))),
    )


def write_warc(records: DataFrame, path: str, records_per_file: int = 1000) -> None:
    """Write converted records as gzip WARC files; a revisit keeps its HTTP header only."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload").cast("string")).otherwise(F.lit(""))
    block = F.concat(F.coalesce(F.col("http").cast("string"), F.lit("")), body)
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise(F.col("warc_type"))

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    only = lambda c: F.when(revisit, c)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.col("moment")),
        header("WARC-Target-URI", F.col("uri")),
        header("WARC-IP-Address", F.when(F.col("ip") != "-", F.col("ip"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        header("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", only(F.col("refers_id"))),
        header("WARC-Refers-To-Target-URI", only(F.col("refers_uri"))),
        header("WARC-Refers-To-Place", only(F.col("refers_to").cast("string"))),
        header("Content-Type", F.when(F.col("warc_type") == "response", "application/http;msgtype=response").otherwise(F.col("mime"))),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    _write(records, F.octet_length(block), lambda some, _: some.select(F.concat(head, block).alias("value")), path, "\r\n\r\n", records_per_file)
