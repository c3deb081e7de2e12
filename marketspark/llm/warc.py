"""WARC archives: a writer on Spark's own file commit, and a splittable reader.

Records are gzip members. The writer is the text source: its line separator is a NUL, and a
gzip member of less than 16 MiB ends in a NUL (the highest byte of its size), so each row
is a member without that byte and the files are plain runs of members. A longer record is
followed by an empty member. Spark commits the files, so lost executors leave none behind.

The reader deals out byte ranges. A task scans its range for the gzip magic, takes a candidate
if it decodes to a WARC header and is followed by another member or the end of the file, and
owns the records that start inside its range, of which the last may end beyond.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, stage

MAGIC = b"\x1f\x8b\x08"
EMPTY = gzip.compress(b"", mtime=0)
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member without its last byte, which is NUL."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if is_revisit else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packed = gzip.compress(record, 6, mtime=0)
    return (packed if packed[-1] == 0 else packed + EMPTY)[:-1]


def write_warc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of df.

    Of rows with equal payloads of at least min_bytes, those of the smallest page_id are
    responses (several, if the id repeats), and the others revisit it. Null html is an empty
    payload; null ids come after all others, and among themselves are all responses. A null
    url has no target line. Further columns are ignored. An empty df makes a folder without records.
    """
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only digests that repeat are joined; they are found without the payloads.
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = stage(first.where("n > 1 and first_id is not null").select(F.col("digest").alias("_d"), "first_id"), "warc-first")
    known = rows.join(first, (F.col("digest") == F.col("_d")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    chosen = known.select("page_id", "url", "payload", "first_id", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, u, h, f, r = (c[k].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([member(p, u, h, f, r, date)], pa.binary())], ["member"])

    chosen.mapInArrow(_grouped(run), "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\x00").text(path)


def _grouped(run, rows: int = 256):
    """The one-row batches of run, put together again."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if len(held) == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def headers(data: bytes) -> dict[str, str]:
    """Names, lower-cased, and values of the lines up to an empty one; the first line is left out."""
    lines = data.split(b"\r\n\r\n", 1)[0].split(b"\r\n")[1:]
    pairs = (x.partition(b":") for x in lines)
    return {n.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for n, _, v in pairs}


def parse(record: bytes) -> dict:
    """The fields of RECORD that a record's bytes give."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = headers(head + b"\r\n\r\n")
    block = rest[: int(h["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    full = int(headers(http_head + b"\r\n\r\n").get("content-length", len(payload)))
    number = lambda v: v.strip("<>").rpartition(":")[2] if v else None
    digest = h.get("warc-payload-digest", "").rpartition(":")[2]
    if not revisit and digest != base32_sha1(payload):
        raise ValueError(f"the payload of {h.get('warc-record-id')} isn't what its digest says")
    return {
        "page_id": None if number(h["warc-record-id"]) == "None" else number(h["warc-record-id"]),
        "record_type": h["warc-type"],
        "url": h.get("warc-target-uri"),
        "refers_to": number(h.get("warc-refers-to")),
        "payload_bytes": full,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


class _Range:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.step = file, step
        self.size = file.size()

    def read(self, at: int, n: int | None = None) -> bytes:
        return self.file.read_at(max(0, min(n or self.step, self.size - at)), at)

    def member(self, at: int, most: int | None = None) -> tuple[bytes, int] | None:
        """What the member at this place decodes to and where it ends; None if there is none. With most, stops after so many bytes."""
        decoder, out, place = zlib.decompressobj(31), [], at
        try:
            while not decoder.eof:
                chunk = self.read(place)
                if not chunk:
                    return None
                place += len(chunk)
                out.append(decoder.decompress(chunk, most or 0))
                if most:
                    return out[0], place
        except zlib.error:
            return None
        return b"".join(out), place - len(decoder.unused_data)

    def starts_record(self, at: int) -> bool:
        """Whether a member here holds a WARC record, and a member or the end follows it."""
        if self.read(at, 3) != MAGIC:
            return False
        head = self.member(at, 64)
        if head is None or not head[0].startswith(b"WARC/1."):
            return False
        whole = self.member(at)
        return whole is not None and (whole[1] >= self.size or self.read(whole[1], 3) == MAGIC)

    def first_record(self, low: int, high: int) -> int:
        """The first record that starts from low to high - 1; high if there is none."""
        at = low
        while at < high:
            chunk = self.read(at, min(self.step, high - at) + 2)
            k = chunk.find(MAGIC)
            while k >= 0 and at + k < high:
                if self.starts_record(at + k):
                    return at + k
                k = chunk.find(MAGIC, k + 1)
            at += min(self.step, high - at)
        return high


def records_in(path: str, low: int, high: int) -> Iterator[dict]:
    """The records of a file that start from byte low to high - 1."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as file:
        source = _Range(file)
        at = 0 if low == 0 else source.first_record(low, high)
        while at < min(high, source.size):
            found = source.member(at)
            if found is None:
                raise ValueError(f"{path} is damaged at byte {at}")
            data, end = found
            if data:
                yield parse(data) | {"file": path, "offset": at}
            at = end


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """A row for each record of the files in a folder: RECORD. payloads=False leaves payload null.

    page_id and refers_to are strings, as archives have them. Files may be read anywhere that
    pyarrow.fs reaches and every executor sees. A folder without records gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select(F.col("path"), low.alias("low")).select("path", "low", (F.col("low") + split_bytes).alias("high"))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])
        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for r in records_in(_uri(p), a, b):
                    held.append(r if payloads else r | {"payload": None})
                    if len(held) == 200:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    spread = ranges.repartition(shuffle_partitions(spark), F.xxhash64("path", "low"))
    return spread.mapInArrow(run, RECORD).select(*names)


def _uri(path: str) -> str:
    """A path as Spark names it, as a URI that pyarrow.fs takes."""
    return "file://" + path.removeprefix("file:").replace("//", "/") if urlsplit(path).scheme in ("", "file") else path


def archive_round_trip(df: DataFrame, page_id: str = "page_id", **options) -> DataFrame:
    """Writes df to archives in the shared folder and returns what reading them back gives.

    page_id and refers_to have df's type again; payloads are checked against their digests
    while they are read, and left out.
    """
    path = new_path(df.sparkSession, "warc")
    write_warc(df, path, page_id, **options)
    kind = df.schema[page_id].dataType
    back = read_warc(df.sparkSession, path, payloads=False)
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
