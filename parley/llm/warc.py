"""WARC archives of individually compressed records that share a Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, tidy

# fixed values: the skippable frame that leads a .warc.zst file and holds its dictionary
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit carries the HTTP head only, with the payload's length in it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    assert first == VERSION, first
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    assert rest[len(block) :] == b"\r\n\r\n"
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "length": length}


def filesystem(uri: str):
    """A pyarrow filesystem and path for the shared folder's URI."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def train_dictionary(pages: DataFrame, size: int = 64 << 10, samples: int = 400, most_bytes: int = 16 << 20) -> bytes:
    """A Zstandard dictionary from the records of `samples` pages, those of the smallest seeded
    hashes among pages of at most most_bytes / samples characters, so at most a bounded number
    of bytes reaches the driver's trainer, and no long page hides the others. Where that gives
    fewer than eight records, shorter beginnings of any pages (as many characters) stand in;
    b"" only where the trainer cannot make a dictionary of so little."""
    room = most_bytes // samples // 4  # characters, of up to four bytes

    def sample(rows: DataFrame) -> list[bytes]:
        drawn = rows.select("page_id", "url", F.substring("html", 1, room).alias("html"), F.xxhash64(F.lit(11), "page_id", F.length("html")).alias("h"))
        found = drawn.orderBy("h", "page_id", "url", "html").limit(samples).toLocalIterator()
        return [record(r["page_id"], r["url"], (r["html"] or "").encode(), None, "2024-01-01T00:00:00Z") for r in found]

    parts = sample(pages.where(F.coalesce(F.length("html"), F.lit(0)) <= room))
    if len(parts) < 8:
        parts = sample(pages)
    for shrunk in (size, size // 16):
        try:
            return zstandard.train_dictionary(shrunk, parts).as_bytes() if parts else b""
        except zstandard.ZstdError:
            continue
    return b""


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha and refers_to for rows whose payload another page stands for.

    Of equal payloads of at least `least_bytes` bytes the one with the largest page_id is the
    response. Groups are aggregated before the shuffle and stored before they are joined, so
    one payload of very many pages can be split; texts do not move."""
    payload = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    groups = (
        keys.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    )
    groups = materialize(groups, "payloads")
    found = keys.join(groups, ["sha", "n"]).where("page_id <> refers_to or (page_id is null and refers_to is not null)")
    return materialize(found.select("page_id", "sha", "refers_to").distinct(), "references")


def marked_pages(pages: DataFrame, refs: DataFrame, bits: int = 22) -> DataFrame:
    """pages with refers_to. The referring pages' ids reach the scan as a bitmap of at most
    2**bits / 64 broadcast rows, so payloads of other pages do not move."""
    slot = F.pmod(F.xxhash64("page_id"), F.lit(1 << bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(page_id), {1 << bits}) & 63 as int))")
    bitmap = materialize(refs.select(F.shiftright(slot, 6).alias("_word"), bit.alias("m")).groupBy("_word").agg(F.bit_or("m").alias("_mask")), "bitmap")
    marked = pages.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "_word", "left")
    hit = F.coalesce(F.col("_mask"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    refs = refs.withColumnsRenamed({"page_id": "_p", "sha": "_s"})
    columns = ["page_id", "url", "html"]
    joined = marked.where(hit).select(columns).join(refs, F.expr("page_id <=> _p and sha1(coalesce(html, '')) = _s"), "left")
    return marked.where(~hit).select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(joined.select(*columns, "refers_to"))


@tidy
def write_warc(
    pages: DataFrame, out: str | None = None, least_bytes: int = 0, level: int = 3, records_per_file: int = 20_000, date: str = "2024-01-01T00:00:00Z", dictionary: bytes | None = None
) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a WARC record; returns a table of the
    archives: path, records, bytes.

    Each file leads with a skippable frame that holds the dictionary (itself compressed), then
    one Zstandard frame per record. Null html is an empty payload; a null page_id gives a
    record without a number and is never referred to. Equal payloads: see with_references.
    Rows that repeat both page_id and payload of a response are responses too. Files are
    written under a temporary name and renamed, so a repeated task leaves one whole file.
    """
    spark = pages.sparkSession
    out = out or new_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    trained = train_dictionary(pages) if dictionary is None else dictionary
    rows = marked_pages(pages, with_references(pages, least_bytes))
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(out)
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        lead = b""
        if trained:
            body = zstandard.ZstdCompressor(level=19).compress(trained)
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
        done, file, held, size, temp, final = [], None, 0, 0, "", ""

        def close():
            nonlocal file
            if file is not None:
                file.close()
                fs.move(temp, final)
                done.append((final, held, size))
                file = None

        for b in batches:
            for page, url, html, ref in zip(*(c.to_pylist() for c in b.columns)):
                if file is not None and held >= records_per_file:
                    close()
                if file is None:
                    final = f"{root}/part-{context.partitionId():05d}-{len(done):04d}.warc.zst"
                    temp = f"{final}.{context.taskAttemptId()}.tmp"
                    file, held, size = fs.open_output_stream(temp, compression=None), 0, len(lead)
                    file.write(lead)
                frame = packer.compress(record(page, url, (html or "").encode(), ref, date))
                file.write(frame)
                held, size = held + 1, size + len(frame)
        close()
        yield pa.RecordBatch.from_pydict(
            {"path": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    files = rows.mapInArrow(run, "path string, records long, bytes long")
    root_uri = out.rstrip("/")
    return files.withColumn("path", F.concat(F.lit(root_uri + "/"), F.element_at(F.split("path", "/"), -1)))


def iter_archive(stream) -> Iterator[bytes]:
    """The records of one archive, read frame by frame."""
    head = stream.read(8)
    shared, data = None, head
    if len(head) == 8:
        magic, n = struct.unpack("<II", head)
        if magic == DICTIONARY_MAGIC:
            body = stream.read(n)
            shared, data = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body)), b""
    unpack = zstandard.ZstdDecompressor(dict_data=shared)
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                return
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(1 << 20)
            if not data:
                raise ValueError("the archive ends within a frame")
        yield b"".join(parts)


def read_warc(archives: DataFrame) -> DataFrame:
    """Read archives back: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload (null for revisits). The digest of a response is computed from its payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for data in iter_archive(stream):
                        r = parse_record(data)
                        f, kind = r["fields"], r["fields"]["WARC-Type"]
                        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            assert digest(r["payload"]) == said and len(r["payload"]) == r["length"]
                        rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], r["length"], said, kind, number(f.get("WARC-Refers-To")), r["payload"] if kind == "response" else None))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def remove_archives(spark: SparkSession, out: str) -> None:
    fs, root = filesystem(out)
    if os.path.basename(root).startswith("warc-"):
        fs.delete_dir(root)
