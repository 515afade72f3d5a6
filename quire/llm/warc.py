"""WARC archives: a writer and a PySpark Python data source.

Files are record-at-a-time gzip, or plain. Every member carries the 'sl' extra field with its compressed and
uncompressed lengths, so that a reader which has parsed a record's headers and found it unwanted
goes on to the next member without inflating the payload. Members of other writers lack the
field; those are inflated to find their end, but their payload is not kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from quire.llm.files import listed, make_dir, opened
from quire.session import cut, ship, work_path

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
_NAMES = ["record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "headers", "payload"]
#: A file is closed and another begun beyond this many compressed bytes.
FILE_BYTES = 256 << 20
_READ = 1 << 16


def digest32(sha1: bytes) -> str:
    """Bare upper-case base32 of a SHA-1 digest."""
    return base64.b32encode(sha1).decode()


def member(block: bytes, level: int = 6) -> bytes:
    """One gzip member with the skip-lengths extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32:  # beyond the field; readers then inflate to find the end
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, total, len(block) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record that names the page whose response has the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {f'<urn:page:{page_id}>' if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"WARC-Payload-Digest: sha1:{digest32(hashlib.sha1(payload).digest())}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the names of the files that count.

    Of payloads that are equal and have at least `least_bytes` bytes the largest page_id is the
    response and the others are revisits. Null html is the empty payload; a null url is left out; rows that repeat the
    largest page_id with the same payload are all responses, and rows without page_id are responses
    that no other refers to. Only digests are grouped; each html moves once, and the join that deals
    it out may split a payload that very many pages share. Names hold a random part, so a task that
    runs again leaves no mixed file.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or work_path(spark, "warc")
    make_dir(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    first = keyed.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = keyed.join(first, ["sha", "size"], "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    marked = marked.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches):
        stream, at, done = None, 0, []
        for batch in batches:
            for d, url, payload, other in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None or at >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    done.append(f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz")
                    system, path = opened(done[-1])
                    stream, at = system.open_output_stream(path, compression=None), 0
                data = member(record(d, url, payload, other, date))
                stream.write(data)
                at += len(data)
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return cut(marked.mapInArrow(run, "path string"))


class _Source:
    """Bytes of a file from a position on, read in steps."""

    def __init__(self, file, at: int, end: int):
        self.file, self.at, self.end, self.held, self.begin = file, at, end, b"", at

    def need(self, n: int) -> bytes:
        """At least n bytes from the position, fewer at the end."""
        skip = self.at - self.begin
        if len(self.held) - skip < n:
            have = self.held[skip:] if skip < len(self.held) else b""
            self.held = have + self.file.read_at(min(max(n - len(have), _READ), max(0, self.end - self.at - len(have))), self.at + len(have))
            self.begin, skip = self.at, 0
        return self.held[skip:]


def _inflated(source: _Source):
    """(compressed length or 0, uncompressed length, inflating function) of the member at the position."""
    head = source.need(64)
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at byte {source.at}")
    flags, at, total, size = head[3], 10, 0, 0
    if flags & 4:
        n = struct.unpack_from("<H", head, 10)[0]
        extra = source.need(12 + n)[12 : 12 + n]
        while len(extra) >= 4:
            m = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and m == 8:
                total, size = struct.unpack_from("<II", extra, 4)
            extra = extra[4 + m :]
    return total, size


def read_records(uri: str, wanted=None, with_payload: bool = True):
    """Records of an archive as tuples of SCHEMA; wanted(headers) says which, from the headers alone."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        end = file.size()
        source = _Source(file, 0, end)
        if source.need(2)[:2] != b"\x1f\x8b":
            yield from _plain_records(source, uri, wanted, with_payload)
            return
        while source.at < end:
            total, _ = _inflated(source)
            z = zlib.decompressobj(31)
            begin, fed, out = source.at, 0, b""
            if total:
                data = source.need(min(total, 4096))[: min(total, 4096)]
                out = z.decompress(data, 2048)
                fed = len(data)
                while b"\r\n\r\n" not in out and not z.eof:
                    data = z.unconsumed_tail or source.need(min(total, fed + 4096))[fed : min(total, fed + 4096)]
                    fed += 0 if z.unconsumed_tail else len(data)
                    if not data:
                        raise ValueError(f"cut-off record at byte {begin} of {uri}")
                    out += z.decompress(data, 2048)
            else:
                out, fed = _whole(source, z, begin)
            head, _, rest = out.partition(b"\r\n\r\n")
            headers = _headers(head)
            size = _whole_number(headers.get("content-length"))
            keep = wanted is None or wanted(headers)
            kind = headers.get("warc-type")
            if keep and total and not z.eof and (with_payload or b"\r\n\r\n" not in rest):
                need = source.need(total)[fed:total]
                rest += z.decompress(z.unconsumed_tail + need)
            source.at = begin + (total or fed)
            if keep:  # a length that is no number is that of the member, less the two line ends
                block = rest[:size] if size is not None else rest.removesuffix(b"\r\n\r\n")
                yield _row(kind, headers, block, size, with_payload)


def _whole(source: _Source, z, begin: int):
    """Inflate a member whose length is unknown: (bytes, compressed length)."""
    out, fed = [], 0
    while not z.eof:
        source.at = begin + fed
        data = source.need(1)
        if not data:
            raise ValueError(f"cut-off gzip member at byte {begin}")
        out.append(z.decompress(data))
        fed += len(data) - len(z.unused_data)
    source.at = begin
    return b"".join(out), fed


def _whole_number(text: str | None) -> int | None:
    """A length as a header states it; null if it is none."""
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text.strip()) else None


def _row(kind, headers, block: bytes | None, size: int | None, with_payload: bool):
    """A record as SCHEMA has it. block: all of it, what follows the headers of a skipped payload's HTTP head, or null if it was skipped.

    The payload of an HTTP message is what follows its head; of other records it is the whole block. A revisit has none.
    """
    http = (headers.get("content-type") or "").lower().startswith("application/http")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, stated = block, size
    if http or (kind == "revisit" and block):
        head, _, payload = (block or b"").partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
        stated = int(found[1]) if found else None
    if kind == "revisit":
        payload = None
    elif with_payload and payload is not None:
        stated, digest = len(payload), digest32(hashlib.sha1(payload).digest())
    page = re.fullmatch(r"<urn:page:(-?\d{1,18})>", headers.get("warc-record-id", ""))
    return (
        kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), int(page[1]) if page else None, headers.get("warc-refers-to"),
        digest, stated, headers, payload if with_payload else None,
    )


def _headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; values of a name that repeats are joined by a comma, and lines that go on are one."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        k, colon, v = line.partition(":")
        if colon:
            last = k.strip().lower()
            out[last] = f"{out[last]}, {v.strip()}" if last in out else v.strip()
    return out


def _plain_records(source: "_Source", uri: str, wanted, with_payload: bool):
    """Records of a file that isn't compressed; unwanted ones are skipped by their length."""
    while source.at < source.end:
        n = 1 << 12
        while True:
            data = source.need(n)
            at = data.find(b"\r\n\r\n")
            if at >= 0 or len(data) < n:
                break
            n *= 2
        if at < 0:
            if data.strip():
                raise ValueError(f"cut-off record at byte {source.at} of {uri}")
            return
        if not data.startswith(b"WARC/"):
            if data[:1] in (b"\r", b"\n"):  # more blank lines than there should be
                source.at += 1
                continue
            raise ValueError(f"no record at byte {source.at} of {uri}")
        headers = _headers(data[:at])
        size = _whole_number(headers.get("content-length"))
        if size is None:
            raise ValueError(f"a record without length at byte {source.at} of {uri}")
        source.at += at + 4
        if wanted is None or wanted(headers):
            block = source.need(size if with_payload else min(size, 1 << 13))[:size]
            yield _row(headers.get("warc-type"), headers, block, size, with_payload)
        source.at += size + 4


class _Files(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


#: Columns that are plain record headers, and so can be tested before the payload is inflated.
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.tests = options, []

    def pushFilters(self, filters):
        for f in filters:
            name = _HEADER_OF.get(f.attribute[0]) if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            else:
                self.tests.append((name, "prefix" if isinstance(f, StringStartsWith) else "in", (f.value,)))

    def partitions(self):
        """Files in groups of about the target size, large ones first.

        With `listing`, a file of names one a line in the folder, the files that it names are those that count.
        """
        found = sorted((x for x in listed(self.options["path"], "") if x[0].endswith((".warc.gz", ".warc"))), key=lambda x: -x[1])
        if "listing" in self.options:
            system, path = opened(f"{self.options['path']}/{self.options['listing']}")
            with system.open_input_stream(path, compression=None) as f:
                names = set(f.read().decode().split("\n"))
            found = [x for x in found if x[0].rpartition("/")[2] in names]
        target = int(self.options.get("partitionbytes", 64 << 20))
        groups: list[list] = []
        room = 0
        for path, size in found:
            if not groups or room < size:
                groups.append([])
                room = target
            groups[-1].append(path)
            room -= size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        tests = self.tests

        def wanted(headers):
            for name, how, values in tests:
                v = headers.get(name)
                if v is None or not (v in values if how == "in" else v.startswith(values[0])):
                    return False
            return True

        payload = self.options.get("payload", "true").lower() == "true"
        for path in partition.paths:
            yield from read_records(path, wanted if tests else None, payload)


class WarcDataSource(DataSource):
    """spark.read.format("warc"). Options: path; payload=false skips payloads; partitionBytes; listing (a file of the names that count)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Records of the archives in a folder."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(folder)


def page_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """From archives of write_warc(): page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload as read back; a revisit holds no payload and
    states both in its headers. files: paths that count.
    """
    listing = f"files-{uuid.uuid4().hex[:12]}.txt"
    system, path = opened(f"{folder}/{listing}")
    with system.open_output_stream(path, compression=None) as f:
        for r in files.toLocalIterator():  # one row a file, which may be 256 MB
            f.write(f"{r.path.rpartition('/')[2]}\n".encode())
    records = read_warc(spark, folder, listing=listing, partitionBytes=str(16 << 20))
    refers = F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(refers != "", refers.cast("long")).alias("refers_to"))
