"""Legacy archives: ARC files of either version are parsed and rewritten as WARC, with revisit records for equal payloads.

An ARC file begins with a version block that names the fields of its header lines; version 1 has five fields, version 2
ten. A record is a header line, whose last field declares the content's length, the content, and a line feed. URLs may
hold blanks, so the fields are counted from the right. The converter gives each record an identifier (a UUID of archive
and offset, the same on a rerun), a date from the 14 digits, a type, and digests of block and payload; what equals the
payload of an earlier record becomes a revisit that names it and has no payload.

Archives are read whole, one per row, so their writer keeps them to about ARCHIVE bytes. What decides between response
and revisit (header, digest, length, key, archive, place; no payloads) is shuffled by digest. A revisit has no payload, so
it is written from that alone. Only one bit per record goes back to the archives, which record is left out; a share of the
archives at a time is read again beside its bits, which are few enough to be broadcast, and gives the other records. So
no payload is shuffled. Files are written by the text sink, whose line separator ends each record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.llm.common import stored
from netsentry.session import work_dir

# The fields of header lines by version of the format, as its version block names them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
KEY = "X-Record-Key"  # header that carries the key of a record through the formats
ARCHIVE = 32 << 20  # bytes of content of an archive that is written, about
RECORDS = 2_000  # records of a WARC file that is written
BITMAP = 32_768  # bits of a bitmap of the aggregate function
BITS = 32 << 20  # bytes of bitmaps that are broadcast at a time, about
LAST_KEY = (1 << 63) - 1  # records without key come after all others
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record of an ARC file; `payload` is the content behind the HTTP header, if it has one."""

    offset: int
    version: int
    fields: dict[str, str]
    header: bytes
    payload: bytes

    @property
    def key(self) -> int | None:
        found = http_fields(self.header).get(KEY.lower(), "")
        return int(found) if found.lstrip("-").isdigit() else None


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def unpacked(raw: bytes) -> bytes:
    """The content of a file, decompressed if it is gzip (of one or more members)."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw) + member.flush())
        raw = member.unused_data
    return b"".join(out) if out else raw


def http_fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if value}


def parse_arc(raw: bytes) -> Iterator[Record]:
    """The records of an ARC file but for the version block; a line or length that does not fit raises ValueError."""
    raw, at, version = unpacked(raw), 0, 0
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r")
        names = FIELDS[version or 1]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit() or end < 0:
            raise ValueError(f"no header line of version {version or 1} at byte {at}: {line[:80]!r}")
        content = raw[end + 1 : end + 1 + int(values[-1])]
        if len(content) < int(values[-1]):
            raise ValueError(f"the record at byte {at} is shorter than it says")
        if not version:
            first = content.split(b"\n", 1)[0].split(b" ")
            if not line.startswith("filedesc:") or first[0] not in (b"1", b"2"):
                raise ValueError("the file does not begin with a version block")
            version = int(first[0])
        else:
            header, payload = b"", content
            if content[:5] == b"HTTP/" and (blank := content.find(b"\r\n\r\n")) >= 0:
                header, payload = content[: blank + 4], content[blank + 4 :]
            yield Record(at, version, dict(zip(names, values)), header, payload)
        at = end + 1 + len(content)


def iso_date(digits: str) -> str:
    """WARC's date from ARC's 14 digits (12 in some old files)."""
    d = digits.ljust(14, "0")
    if not d.isdigit() or len(d) != 14:
        raise ValueError(f"no date: {digits!r}")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line feed, which the sink adds."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r"


def to_warc(record: Record, archive: str, refers: dict | None, payload: tuple[str, int] | None = None) -> bytes:
    """The WARC form of an ARC record; `refers` has archive, offset and key of the response that a revisit names. `payload`
    is the digest and length of the payload, where the record does not carry it."""
    fields = record.fields
    is_http = bool(record.header)
    digest, size = payload or (sha1(record.payload), len(record.payload))
    kind = "revisit" if refers else "response" if is_http else "resource"
    out = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(archive, record.offset)),
        ("WARC-Date", iso_date(fields["Archive-date"])),
        ("WARC-Target-URI", fields["URL"]),
        ("Content-Type", "application/http; msgtype=response" if is_http else fields["Content-type"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if fields["IP-address"] not in ("-", "0.0.0.0"):
        out.append(("WARC-IP-Address", fields["IP-address"]))
    if record.key is not None:
        out.append((KEY, str(record.key)))
    if refers:
        out += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers["archive"], refers["offset"]))]
        if refers["key"] is not None:
            out.append(("X-Refers-To-Key", str(refers["key"])))
    block = record.header if refers else record.header + record.payload
    return warc_record([*out, ("WARC-Block-Digest", f"sha1:{sha1(block)}")], block)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; lengths are taken as declared."""
    raw, at = unpacked(raw), 0
    while at < len(raw):
        blank = raw.find(b"\r\n\r\n", at)
        if raw[at : at + 5] != b"WARC/" or blank < 0:
            raise ValueError(f"no record at byte {at}")
        fields = http_fields(raw[at : blank + 2])
        size = int(fields["content-length"])
        block = raw[blank + 4 : blank + 4 + size]
        at = blank + 4 + size + 4
        if len(block) < size or raw[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} is not as long as it says")
        yield fields, block


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Pages (`page_id`, `url`, `html`) as gzipped ARC files, alternately of version 1 and 2.

    Null html is an empty payload, a null or empty URL is `-`; blanks in URLs stay, line ends become %0A and %0D.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version = 1 + number % 2
        about = f"{version} 0 netsentry\n{' '.join(FIELDS[version])}\n"
        begun = False
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for page in batch.slice(at, 200).to_pylist():
                    body = (page["html"] or "").encode()
                    header = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    header += f"{KEY}: {page['page_id']}\r\n" if page["page_id"] is not None else ""
                    content = header.encode() + b"\r\n" + body
                    url = (page["url"] or "-").replace("\n", "%0A").replace("\r", "%0D")
                    middle = [] if version == 1 else ["200", sha1(body), "-", "0", f"part-{number:05d}.arc"]
                    line = " ".join([url, "0.0.0.0", date, "text/html", *middle, str(len(content))])
                    out.append(line.encode() + b"\n" + content)
                if out and not begun:
                    middle = [] if version == 1 else ["200", "-", "-", "0", f"part-{number:05d}.arc"]
                    head = " ".join([f"filedesc://part-{number:05d}.arc", "0.0.0.0", date, "text/plain", *middle, str(len(about))])
                    out.insert(0, f"{head}\n{about}".encode())
                    begun = True
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])

    archives = rows.repartition(max(1, -(-size // ARCHIVE))).mapInArrow(lines, "line binary")
    archives.select(F.col("line").cast("string").alias("value")).write.option("compression", "gzip").text(path)


def archives_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(`archive`, `content`) of the files at the path or paths."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def records_of(archives: DataFrame) -> DataFrame:
    """What is known of each record without its payload, from (`archive`, `content`); `number` is its place in the archive."""
    kinds = {
        "archive": pa.string(), "number": pa.int64(), "offset": pa.int64(), "key": pa.int64(), "digest": pa.string(),
        "bytes": pa.int64(), "version": pa.int32(), "url": pa.string(), "ip": pa.string(), "date": pa.string(),
        "type": pa.string(), "header": pa.binary(),
    }

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [
                    (row["archive"], number, r.offset, r.key, sha1(r.payload), len(r.payload), r.version,
                     *(r.fields[name] for name in FIELDS[1][:4]), r.header)
                    for number, r in enumerate(parse_arc(row["content"]))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return archives.mapInArrow(found, ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items()))


def _in_pieces(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records as batches of some 4 MB."""
    out, held = [], 0
    for record in records:
        out.append(record)
        held += len(record)
        if held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])


def _revisit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _in_pieces(
            to_warc(
                Record(r["offset"], r["version"], dict(zip(FIELDS[1], (r["url"], r["ip"], r["date"], r["type"]))), r["header"], b""),
                r["archive"], r["first"], (r["digest"], r["bytes"]),
            )
            for r in batch.to_pylist()
        )


def _other_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records whose bit is not set, with their payloads."""
    for batch in batches:
        for row in batch.to_pylist():
            bits = {b["bucket"]: b["bits"] for b in row["bitmaps"] or ()}

            def is_revisit(number: int) -> bool:
                at = number % BITMAP
                return number // BITMAP in bits and bool(bits[number // BITMAP][at // 8] >> at % 8 & 1)

            records = enumerate(parse_arc(row["content"]))
            yield from _in_pieces(to_warc(r, row["archive"], None) for number, r in records if not is_revisit(number))


def _append_lines(lines: DataFrame, path: str) -> None:
    value = lines.select(F.col("line").cast("string").alias("value"))
    value.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, bits: int = BITS) -> None:
    """Rewrites the ARC files at one path as WARC files at another, which must not exist.

    Of records with equal payloads of at least `least_bytes` bytes that with the smallest key (then archive, then offset)
    is a response and the others revisit it; records without key come last. Smaller ones are all responses. An archive
    without records, and a path without archives, give none. A record without URL or with clashing HTTP headers is taken
    as it is; a file that is no ARC file raises ValueError. Archives are read in as many shares as keep the bitmaps of a
    share to about `bits` bytes; the result is the same for any number.
    """
    records = stored(records_of(archives_of(spark, arc_path)), "arc-records")
    place = F.struct(F.coalesce("key", F.lit(LAST_KEY)).alias("place"), "archive", "offset", "key")
    first = records.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    revisits = records.join(first.filter("n > 1").drop("n"), ["digest", "bytes"]).filter(
        (F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset"))
    )
    revisits = stored(revisits, "arc-revisits")
    _append_lines(revisits.mapInArrow(_revisit_lines, "line binary"), warc_path)

    bucket, bit = F.floor(F.col("number") / BITMAP).alias("bucket"), F.col("number") % BITMAP
    share = lambda shares: F.pmod(F.xxhash64("archive"), F.lit(shares))
    archives = stored(records.groupBy("archive").agg((F.floor(F.max("number") / BITMAP) + 1).alias("bitmaps")), "arc-names")
    size = (archives.agg(F.sum("bitmaps")).first()[0] or 0) * (BITMAP // 8)
    shares = max(1, -(-size // bits))
    bitmaps = (
        revisits.groupBy("archive", bucket).agg(F.bitmap_construct_agg(bit).alias("bits"))
        .groupBy("archive").agg(F.collect_list(F.struct("bucket", "bits")).alias("bitmaps"))  # of one archive, which is bounded
    )
    bitmaps = stored(bitmaps, "arc-bitmaps")
    for number in range(shares):
        names = [row[0] for row in archives.filter(share(shares) == number).select("archive").collect()]
        if names:
            # Names of files, not patterns.
            content = archives_of(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", name) for name in names])
            both = content.join(F.broadcast(bitmaps.filter(share(shares) == number)), "archive", "left")
            _append_lines(both.select("content", "archive", "bitmaps").mapInArrow(_other_lines, "line binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(`record_id`, `record_type`, `url`, `date`, `key`, `payload_bytes`, `payload_digest`, `refers_to_id`, `refers_to`)
    of each record; the digest and length of a response are computed from its payload and must be those it names."""
    names = ["record_id", "record_type", "url", "date", "key", "payload_bytes", "payload_digest", "refers_to_id", "refers_to"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda value: None if value is None else int(value)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                found = []
                for f, block in parse_warc(raw):
                    named, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                    if f["warc-type"] != "revisit":
                        payload = block.split(b"\r\n\r\n", 1)[1] if block[:5] == b"HTTP/" else block
                        if (sha1(payload), len(payload)) != (named, size):
                            raise ValueError(f"the payload of {f['warc-record-id']} is not the one it names")
                    found.append((
                        f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], number(f.get(KEY.lower())),
                        size, named, f.get("warc-refers-to"), number(f.get("x-refers-to-key")),
                    ))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    schema = ", ".join(f"{n} {'bigint' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds))
    return archives_of(spark, path).mapInArrow(rows, schema)


def pages_through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per page: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, by way of ARC and WARC files in
    the shared folder.

    Null html is an empty payload. Pages without id come last among equal payloads; of rows that share id and payload one
    is the response. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = work_dir(spark, "arc"), work_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes)
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
