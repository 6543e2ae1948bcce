"""WARC archives: deduplicated writing and splittable reading.

Writing gives every record a gzip member of its own. Of equal payloads from ``REVISIT_BYTES`` on, the row with the
largest id is stored, the others refer to it. Each task writes one archive under a new name and reports it;
only reported archives count, so a repeated task leaves no record twice.

Reading cuts archives into byte ranges. A task looks for the gzip magic in its range, takes a candidate for
a record only if its first bytes decompress to a WARC header that can be decoded, and owns the records that
start inside its range, reading past its end to finish the last. A member that ends where the next begins
is followed without a search; after damage the search goes on behind the magic that failed.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS by address), below the folder that
``spark.checkpoint.dir`` names.

Defined cases: a null payload is empty; an empty or short payload is always stored; rows with a null id are
written without an id and never referred to; repeated ids are written each, and all with the largest id of a
payload are stored; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import stored
from gaugeworks.session import scratch_path

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
_CHUNK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.\d\r\n")
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, path string, offset long"


def _system(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/octet-stream"),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    body = payload if refers_to is None else b""
    lines.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def _written(folder: str):
    def run(batches):
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        system, path = _system(name)
        out, records, size = None, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                records += 1
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per row and returns the list of archives (``path``, ``records``, ``bytes``)."""
    body = F.col(payload) if dict(pages.dtypes)[payload] == "binary" else F.encode(F.col(payload), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(body, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only payloads that occur more than once are looked up again.
    stored_under = (
        rows.select("page_id", "digest", F.length("payload").alias("size")).filter(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select("digest", "largest")
    )
    rows = rows.join(stored(stored_under, "digests"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("largest") != F.col("page_id")), F.col("largest"))).drop("largest")
    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_written(folder), "path string, records long, bytes long"), "archives")


class _Window:
    """Bytes of a file from a position on, read in chunks and forgotten as the reader moves on."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, stop: int) -> bool:
        """Holds bytes up to ``stop``, if the file has them."""
        while self.start + len(self.data) < min(stop, self.size):
            at = self.start + len(self.data)
            self.file.seek(at)
            self.data += self.file.read(min(_CHUNK, self.size - at))
        return self.start + len(self.data) >= stop

    def forget(self, before: int) -> None:
        cut = min(max(0, before - self.start), len(self.data))
        if cut > _CHUNK:
            self.data, self.start = self.data[cut:], self.start + cut


def _headers(block: bytes) -> dict[str, str] | None:
    """The header lines, if they are a WARC header."""
    if not _VERSION.match(block):
        return None
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if out.get("warc-type") and out.get("content-length", "").isdigit() else None


def member_at(window: _Window, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, content and end of the record whose gzip member begins at ``start``, if one does."""
    opener = zlib.decompressobj(31)
    held, at, headers, need = bytearray(), start, None, None
    while not opener.eof:
        # The first look is short: most candidates are none.
        step = 1 << 18 if held else 4096
        window.upto(at + step)
        piece = window.data[at - window.start:at - window.start + step]
        if not piece:
            return None
        try:
            out = opener.decompress(piece)
        except zlib.error:
            return None
        at += len(piece)
        seen = max(0, len(held) - 3)
        held += out
        if headers is None:
            # A header block has no limit, since a url has none.
            end = held.find(b"\r\n\r\n", seen)
            if end < 0:
                if not b"WARC/1.".startswith(held[:7]):
                    return None
                continue
            headers = _headers(bytes(held[:end]))
            if headers is None:
                return None
            need = end + 4 + int(headers["content-length"])
    if headers is None or len(held) != need + 4:
        return None
    return headers, bytes(memoryview(held)[need - int(headers["content-length"]):need]), at - len(opener.unused_data)


def records_in(window: _Window, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose member starts from ``start`` up to before ``stop``."""
    at = start
    while at < stop:
        window.upto(min(at + _CHUNK, stop + len(_MAGIC)))
        found = window.data.find(_MAGIC, at - window.start)
        if found < 0:
            at = max(at, window.start + len(window.data) - len(_MAGIC) + 1)
            if window.start + len(window.data) >= min(window.size, stop + len(_MAGIC)):
                return
            window.forget(at)
            continue
        at = window.start + found
        if at >= stop:
            return
        member = member_at(window, at)
        if member is None:
            at += 1
            continue
        headers, body, end = member
        yield at, headers, body
        at = end
        window.forget(at)


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d+", text) else None


def _read(batches):
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "path", "offset"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
            system, place = _system(path)
            rows, held = [], 0
            with system.open_input_file(place) as file:
                window = _Window(file, start, file.size())
                for offset, headers, body in records_in(window, start, stop):
                    refers_to = _whole(headers.get("x-refers-to-page-id"))
                    # A revisit has no payload of its own; digest and length are those of the payload it stands for.
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(body).hexdigest()
                    size = _whole(headers.get("x-payload-length")) if revisit else len(body)
                    rows.append((_whole(headers.get("x-page-id")), headers.get("warc-target-uri"), headers["warc-type"], digest, size, refers_to, None if revisit else body, path, offset))
                    held += len(body)
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)


def read(archives: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (``path``, ``bytes``), each range of ``size`` bytes read by itself."""
    ranges = archives.filter("bytes > 0").select("path", F.col("bytes").alias("stop"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, F.col("stop")).alias("stop"))
    count = max(1, int(ranges.count()))
    spread = ranges.repartitionByRange(min(count, 10_000), "path", "start")
    return spread.mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """All rows written to new archives below the shared folder and read back; an error if a record is missing."""
    archives = write(pages, scratch_path(pages.sparkSession, "warc"))
    found = stored(read(archives), "records")
    wrote, got = archives.agg(F.sum("records")).first()[0] or 0, found.count()
    if wrote != got:
        raise ValueError(f"{wrote} records were written, {got} read")
    return found
