"""WARC records in ZIP packages, written and read by range.

A package is a ZIP file with stored (uncompressed) members: archive/*.warc.gz, a gzip member for each WARC
record, and indexes/*.cdxj, a line for each record with its offset and length. The writer always emits ZIP64
structures. The reader parses the end record, the ZIP64 end record and the central directory, finds the
stored archives and their indexes, and reads records by range from where they lie; nothing is extracted. An
archive without an index is walked record by record.

Files are reached through pyarrow's file systems, by URI, so packages lie in the shared folder and not on an
executor's disk. A task that runs again writes packages of new names; only those named in the manifest count.

A null payload counts as empty. Among pages of equal payloads at least ``MIN_REVISIT`` bytes long, those with
the largest page id are responses and the rest revisit it; ids that are null are the least, and payloads
whose ids are all null are responses. Repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, ready

#: Shared payloads that are broadcast, by their digests; more are joined by shuffle, the pages of each in so many parts.
BROADCAST_SHARED, SALTS = 200_000, 32
#: A package is closed beyond so many bytes, a range read at about so many.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 1 << 20
MIN_REVISIT = 0
# Fixed values of the ZIP and WARC formats.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "digest_ok boolean, package string, offset long, length long"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; with refers_to a revisit, which keeps the HTTP header alone."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and block of a WARC record, gzipped or not."""
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    return fields, rest[:size]


class Package:
    """A ZIP64 file of stored members, built in memory up to PACKAGE_BYTES."""

    def __init__(self):
        self.warc, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> None:
        at = self.warc.tell()
        self.warc.write(write_record(page_id, url, payload, refers_to))
        place = {"offset": at, "length": self.warc.tell() - at, "filename": "data.warc.gz", "url": url}
        self.index.append(f"{page_id} {DATE} {json.dumps(place)}\n")

    def bytes(self) -> bytes:
        out, central = io.BytesIO(), io.BytesIO()
        members = {"archive/data.warc.gz": self.warc.getvalue(), "indexes/index.cdxj": "".join(self.index).encode()}
        for name, data in members.items():
            at, crc, raw = out.tell(), zlib.crc32(data), name.encode()
            sizes = struct.pack("<HHQQ", 1, 16, len(data), len(data))
            out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(sizes)) + raw + sizes)
            out.write(data)
            more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
            central.write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(more), 0, 0, 0, 0, FULL32) + raw + more)
        start, body, n = out.tell(), central.getvalue(), len(members)
        out.write(body)
        end = out.tell()
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(body), start))
        out.write(LOCATOR + struct.pack("<IQI", 0, end, 1))
        out.write(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        return out.getvalue()


def _open(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _at(file: pa.NativeFile, start: int, size: int) -> bytes:
    return file.read_at(size, start)


def members(file: pa.NativeFile) -> list[tuple[str, int, int]]:
    """(name, where its data starts, size) of the stored members, from the central directory."""
    size = file.size()
    tail = _at(file, max(0, size - 22 - FULL16), min(size, 22 + FULL16))
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    place = max(0, size - 22 - FULL16) + end
    if place >= 20 and (locator := _at(file, place - 20, 20))[:4] == LOCATOR:
        whole = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if whole[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack_from("<QQQ", whole, 32)
    directory, at, found = _at(file, start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method, packed, plain, n, extra, note, local = *struct.unpack_from("<HH", directory, at + 8), *struct.unpack_from("<IIHHH", directory, at + 20), struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        field, stop = at + 46 + n, at + 46 + n + extra
        while field + 4 <= stop:
            tag, many = struct.unpack_from("<HH", directory, field)
            if tag == 1:  # 64-bit values, in this order, for those that are full above
                wide = iter(struct.unpack_from(f"<{many // 8}Q", directory, field + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            field += 4 + many
        at = stop + note
        if method == 0 and not flags & 1 and plain == packed:
            head = _at(file, local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"{name} has no local header where the directory says")
            found.append((name, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed))
    return found


def _walk(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the gzip members of an archive that has no index, read a range at a time."""
    at, begun, gz = 0, 0, zlib.decompressobj(31)
    while at < size:
        data = _at(file, start + at, min(RANGE_BYTES, size - at))
        at += len(data)
        while data:
            while data and not gz.eof:
                gz.decompress(data, RANGE_BYTES)
                data = gz.unconsumed_tail
            if gz.eof:
                data = gz.unused_data
                stop = at - len(data)
                yield begun, stop - begun
                begun, gz = stop, zlib.decompressobj(31)


def places(uri: str) -> Iterator[tuple[int, int]]:
    """Absolute offset and length of every record in a package's stored archives, in order."""
    with _open(uri) as file:
        found = members(file)
        archives = {n.rsplit("/", 1)[-1]: (start, size) for n, start, size in found if n.endswith(".warc.gz")}
        indexed = set()
        for name, start, size in found:
            if name.endswith((".cdxj", ".cdx")):
                for line in _at(file, start, size).decode().splitlines():
                    place = json.loads(line[line.index("{") :])
                    base, _ = archives[place["filename"]]
                    indexed.add(place["filename"])
                    yield base + int(place["offset"]), int(place["length"])
        for name, (start, size) in archives.items():
            if name not in indexed:
                for offset, length in _walk(file, start, size):
                    yield start + offset, length


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Writes packages of all pages to the shared folder; returns their manifest (package, records, bytes), itself stored there."""
    spark = ready(pages.sparkSession)
    folder = fresh(spark, "packages")
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    # Payloads that pages share: broadcast if they are few, else dealt over SALTS tasks each, so that no task gets all pages of one.
    last = keep(rows.groupBy("sha").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("sha", "last"), "shared")
    if last.count() <= BROADCAST_SHARED:
        rows = rows.join(F.broadcast(last), "sha", "left")
    else:
        salted = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["sha", "salt"], "left")
    same = (F.octet_length("body") >= least) & F.col("last").isNotNull() & ((F.col("id") < F.col("last")) | F.col("id").isNull())
    rows = rows.select("id", "url", "body", F.when(same, F.col("last")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)

        def close(package: Package) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.wacz", package.bytes()
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(package.index)], pa.int64()), pa.array([len(data)], pa.int64())], names=["package", "records", "bytes"])

        package = Package()
        for batch in batches:
            for page, url, body, last in zip(*(batch.column(i) for i in range(4)), strict=True):
                package.add(page.as_py(), url.as_py(), body.as_py(), last.as_py())
                if package.warc.tell() >= PACKAGE_BYTES:
                    yield close(package)
                    package = Package()
        if package.index:
            yield close(package)

    return keep(rows.mapInArrow(run, "package string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the packages in manifest; with_payload adds the payload of responses.

    Directories and indexes are read first; ranges of records are then dealt out to all tasks, whatever package they lie in.
    """
    ready(manifest.sparkSession)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, run, total = [], [], 0
                for place in places(uri):
                    run.append(place)
                    total += place[1]
                    if total >= RANGE_BYTES:
                        rows.append(run)
                        run, total = [], 0
                rows += [run] if run else []
                offsets = pa.array([[p[0] for p in r] for r in rows], pa.list_(pa.int64()))
                lengths = pa.array([[p[1] for p in r] for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), offsets, lengths], names=["package", "offsets", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with _open(uri) as file:
                    joined = offsets[-1] + lengths[-1] - offsets[0] == sum(lengths)
                    whole = _at(file, offsets[0], sum(lengths)) if joined else b""
                    rows = []
                    for at, size in zip(offsets, lengths, strict=True):
                        raw = whole[at - offsets[0] : at - offsets[0] + size] if joined else _at(file, at, size)
                        rows.append((*_row(*read_record(raw)), uri, at, size))
                names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "payload", "package", "offset", "length"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
                if not with_payload:
                    del cols[7], names[7]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = RECORD.replace(" package", " payload binary, package") if with_payload else RECORD
    spread = manifest.select("package").repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    found = spread.mapInArrow(locate, "package string, offsets array<long>, lengths array<long>")
    return found.repartition(4 * manifest.sparkSession.sparkContext.defaultParallelism).mapInArrow(fetch, schema)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """What a record says of its page. A revisit names the digest and, in its HTTP header, the size of the payload it doesn't repeat."""
    number = lambda x: int(x.strip("<>").rpartition(":")[2]) if x and x.strip("<>").rpartition(":")[2] else None
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    size = next((int(x[15:]) for x in head.decode(errors="replace").split("\r\n") if x.lower().startswith("content-length:")), len(payload))
    ok = None if revisit else size == len(payload) and sha1_base32(payload) == digest
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], number(fields.get("warc-refers-to")), size, digest, ok, None if revisit else payload


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages and reads every record back."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")
