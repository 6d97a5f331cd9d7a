"""WARC archives as a PySpark data source, and a writer.

Reading: one partition per run of files up to ``split_bytes``; filters on record type and on header
columns are pushed into the reader, which parses a record's headers first and passes over the
payloads of records (or columns) nobody asked for. The writer gives each gzip member the skip-length
extra field ``sl`` (compressed and uncompressed size), so that an unwanted payload is not even
inflated; archives without that field are inflated to the end of the member, and plain ``.warc``
files are passed over by Content-Length.

Writing: each record is its own gzip member; a revisit has the HTTP head of its page but no payload.

Files are reached through pyarrow file systems, so the folder may be any URI that pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from .shared import new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, content_type string, page_id long, headers map<string,string>, payload binary"
)
HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
LEVEL = 1


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id) -> str:
    return f"<urn:lamina:page:{'null' if page_id is None else page_id}>"


ESCAPED = "X-Escaped"  # names the header that _clean had to change


def _clean(value: str) -> str:
    """A header value is one line; where it has line breaks, they and percent signs are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def encode_record(page_id, url: str | None, payload: bytes, digest: str, revisit_of=None, revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        broken = any(c in url for c in "\r\n")
        head += [f"WARC-Target-URI: {_clean(url)}", f"{ESCAPED}: WARC-Target-URI"] if broken else [f"WARC-Target-URI: {url}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(revisit_of)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member whose extra field ``sl`` has its compressed and uncompressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _skip_length(head: bytes) -> int | None:
    if len(head) < 12 or not head[3] & 4:
        return None
    n = struct.unpack_from("<H", head, 10)[0]
    extra, at = head[12 : 12 + n], 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + size
    return None


def _parse_head(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


class _Source:
    """Buffered forward reads of a binary file."""

    def __init__(self, f):
        self.f, self.buf = f, b""

    def need(self, n: int) -> bytes:
        if len(self.buf) < n:
            self.buf += self.f.read(max(n - len(self.buf), 1 << 20))
        return self.buf[:n]

    def drop(self, n: int) -> None:
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.f.seek(n - len(self.buf), 1)
            self.buf = b""


def _inflate_member(src: _Source) -> bytes:
    """The next member of unknown length, to its end."""
    z, out = zlib.decompressobj(31), bytearray()
    while not z.eof:
        chunk = src.need(1 << 20)
        if not chunk:
            raise ValueError("archive ends inside a record")
        out += z.decompress(chunk)
        src.drop(len(chunk) - len(z.unused_data))
    return bytes(out)


def _gz_records(f, wanted) -> Iterator[tuple[dict, bytes | None]]:
    src = _Source(f)
    while head := src.need(64):
        size = _skip_length(head)
        if size is None:
            data = _inflate_member(src)
            end = data.find(b"\r\n\r\n")
            fields = _parse_head(data[:end])
            how = wanted(fields)
        else:
            z, data, more = zlib.decompressobj(31), b"", src.need(min(size, 4096))
            while (end := data.find(b"\r\n\r\n")) < 0 and not z.eof:  # no more than the head is inflated
                data += z.decompress(more, 1024)
                more = z.unconsumed_tail or src.need(size)[min(size, 4096) :]
            fields = _parse_head(data[:end])
            how = wanted(fields)
            if how == "payload":
                data = zlib.decompress(src.need(size), 31)
            src.drop(size)
        if how is not None:
            yield fields, data[end + 4 :] if how == "payload" else None


def _plain_records(f, wanted) -> Iterator[tuple[dict, bytes | None]]:
    src = _Source(f)
    while src.need(1):
        n = 4096
        while (end := src.need(n).find(b"\r\n\r\n")) < 0 and len(src.buf) >= n:
            n *= 2
        head = _parse_head(src.buf[:end])
        size = int(head.get("content-length", 0))
        src.drop(end + 4)
        how = wanted(head)
        body = src.need(size)[:size] if how == "payload" else None
        src.drop(size + 4)
        if how is not None:
            yield head, body


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 64 << 20))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.sizes = str(options.get("sizes", "false")).lower() == "true"
        self.columns = columns
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality, membership, prefix and not-null tests on header columns; leaves the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in HEADER_OF or name == "refers_to":
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "known", ()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, base = _open_fs(self.path)
        found = [x for x in where.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        out, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if held and size + x.size > self.split:
                out.append(_Files(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*out, _Files(held)]

    def _value(self, head: dict, column: str):
        v = head.get(HEADER_OF[column])
        if v is None:
            return None
        if column == "payload_digest":
            return v.partition(":")[2] or v
        return _unclean(v) if column == "target_uri" and ESCAPED.lower() in head else v

    def _passes(self, head: dict) -> bool:
        for column, kind, values in self.tests:
            v = self._value(head, column)
            if v is None or kind == "in" and v not in values or kind == "starts" and not v.startswith(values[0]):
                return False
        return True

    def read(self, partition):
        where, _ = _open_fs(self.path)
        wanted = lambda head: ("payload" if self.payload or self.verify or self.sizes else "head") if self._passes(head) else None
        for path in partition.paths:
            with where.open_input_file(path) as f:
                for head, body in (_gz_records if path.endswith(".gz") else _plain_records)(f, wanted):
                    yield self._row(head, body)

    def _row(self, head: dict, body: bytes | None):
        size, payload = None, None
        if body is not None:
            block = body[: int(head.get("content-length", len(body)))]
            payload = block
            if head.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = _parse_head(http).get("content-length")
            size = int(size) if size is not None else len(payload)
            if head.get("warc-type") == "revisit":
                payload = None
            elif self.verify and "warc-payload-digest" in head and base32_sha1(payload) != self._value(head, "payload_digest"):
                raise ValueError(f"digest of {head.get('warc-record-id')} does not match its payload")
        name = head.get("warc-record-id", "")
        number = name[len("<urn:lamina:page:") : -1] if name.startswith("<urn:lamina:page:") else ""
        page = int(number) if number.lstrip("-").isdigit() else None
        return (
            *(self._value(head, c) for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")),
            size, self._value(head, "content_type"), page, head, payload if self.payload else None,
        )


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: payload (false: heads only), sizes (payload_bytes without payloads), verify, split_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and first: the smallest id among records of equal payload of at least ``least`` bytes.

    Only digests and ids are aggregated; a payload moves once, to the partition of its digest, and a
    popular digest is one of many rows on that side of the join, which Spark may split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    digests = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))).alias("sha1"))
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("first"))
    out = rows.join(first, "sha1")
    return out.withColumn("first", F.when(F.length("payload") >= least, F.col("first")))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, records_per_file: int = 20_000) -> DataFrame:
    """Write archives under ``folder`` and return (file, records); one record for each row of pages.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest page_id are
    responses and the others revisits of it; rows that repeat the smallest id are responses too.
    A null html is an empty payload, a null url has no target, a null id counts as the largest
    (alone in its group it is a response). Each task writes its own files, under a name of its attempt,
    and renames them when complete, so a repeated or lost task leaves no part of an archive behind.
    """
    import uuid

    def run(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        where, base = _open_fs(folder)
        where.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        part, number, done = None, 0, 0
        names, counts = [], []

        def close():
            nonlocal part, done
            if part is not None:
                part[0].close()
                final = f"{base}/part-{ctx.partitionId():05d}-{number:04d}.warc.gz"
                where.move(part[1], final)
                names.append(final)
                counts.append(done)
            part, done = None, 0

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part is None:
                    number += 1
                    temp = f"{base}/.{uuid.uuid4().hex}.tmp"
                    part = (where.open_output_stream(temp), temp)
                revisit = first is not None and first != page_id
                d = base64.b32encode(bytes.fromhex(digest)).decode()
                part[0].write(gzip_member(encode_record(page_id, url, payload, d, first, revisit)))
                done += 1
                if done >= records_per_file:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return roles(pages, id_col, url_col, html_col, least).select("page_id", "url", "payload", "sha1", "first").mapInArrow(run, "file string, records long")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back with digests checked, one row per page.

    Revisits have no payload; the read that takes them passes over the responses' by their heads, and the other way round.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_warc(pages, folder, least=least).agg(F.sum("records")).collect()
    register(spark)
    read = lambda **options: spark.read.format("warc").options(split_bytes=str(8 << 20), payload="false", **options).load(folder)
    named = F.regexp_extract("refers_to", r"^<urn:lamina:page:(-?\d+)>$", 1)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.length(named) > 0, named.cast("long")).alias("refers_to"), F.col("target_uri").alias("url")]
    # each read takes one type by its headers: payloads are decoded, and checked, of responses only
    responses = read(verify="true").where("record_type = 'response'").select(columns)
    return responses.unionByName(read(sizes="true").where("record_type = 'revisit'").select(columns))
