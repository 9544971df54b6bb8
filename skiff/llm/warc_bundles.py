"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some WARC records, and a footer in a
skippable frame: the seek table with the compressed and plain size of every frame. The index maps
a record's id to its bundle, frame and offset inside the plain frame, so one record costs
one frame. Bundles go to the shared folder; each task attempt writes files of its own names, and
only those of attempts that ended well get into the index, so a lost executor leaves no half record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import map_batches, materialize, new_path

#: Plain bytes of a frame and compressed bytes of a bundle, from which the next one starts.
FRAME, BUNDLE = 1 << 20, 64 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, at int, length int"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of the record ``refers_to``."""
    revisit = refers_to is not None
    block = b"" if revisit else HEAD + payload
    uri = "".join(c for c in url or "about:blank" if c.isprintable())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(begin, compressed, plain) of the frames, from the end of a bundle; ``tail`` holds the whole footer."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, out = 0, []
    for compressed, plain in struct.iter_unpack("<II", tail[-9 - 8 * count : -9]):
        out.append((at, compressed, plain))
        at += compressed
    return out


def file_tail(file) -> bytes:
    """The footer of an open bundle: its last 9 bytes tell how many frames the table has."""
    end = file.size()
    file.seek(end - 9)
    size = 9 + 8 * struct.unpack("<IBI", file.read(9))[0]
    file.seek(end - size)
    return file.read(size)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, html, digest, refers_to) as bundles in ``folder``; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        packer = zstandard.ZstdCompressor(level=3)
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, path, name, frames, at = None, "", "", [], 0
        plain, held, rows = bytearray(), [], []

        def flush() -> None:
            nonlocal out, path, name, frames, at, plain, held
            if not held:
                return
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                path = f"{base}/{name}"
                out, frames, at = system.open_output_stream(path, compression=None), [], 0
            packed = packer.compress(bytes(plain))
            out.write(packed)
            rows.extend((page, name, len(frames), x, n) for page, x, n in held)
            frames.append((len(packed), len(plain)))
            at += len(packed)
            plain, held = bytearray(), []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(seek_table(frames))
                out.close()
                out = None

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw = record(page, url, (html or "").encode(), digest, refers)
                held.append((page, len(plain), len(raw)))
                plain += raw
                if len(plain) >= FRAME:
                    flush()
                    if at >= BUNDLE:
                        close()
            if len(rows) > 10_000:
                yield batch_of()
        flush()
        close()
        yield batch_of()

    return materialize(map_batches(records.select("page_id", "url", "html", "digest", "refers_to"), run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records of an index back, frame by frame: every field comes from the archive.

    Frames are sought by the seek table in the footer of their bundle, which is read once on opening it.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and payload.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one frame stand together; frames are bounded, so no task gets more than its share.
    dealt = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        unpacker, (system, base) = zstandard.ZstdDecompressor(), _open(folder)
        last, plain, file, opened, frames = None, b"", None, None, []
        rows, weight = [], 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for _, bundle, frame, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if (bundle, frame) != last:
                    if bundle != opened:
                        if file is not None:
                            file.close()
                        file, opened = system.open_input_file(f"{base}/{bundle}"), bundle
                        frames = read_seek_table(file_tail(file))
                    begin, size, _ = frames[frame]
                    file.seek(begin)
                    plain, last = unpacker.decompress(file.read(size)), (bundle, frame)
                fields, block = parse(plain[at : at + length])
                page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                payload = block.partition(b"\r\n\r\n")[2]
                if fields["WARC-Type"] == "revisit":
                    row = (int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:], "revisit", int(fields["WARC-Refers-To"][len("<urn:page:") : -1]), None)
                else:
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload)
                rows.append((int(page) if page else None, *row))
                weight += len(block)
                if len(rows) >= 5000 or weight > 16 << 20:
                    yield batch_of()
                    weight = 0
        if file is not None:
            file.close()
        yield batch_of()

    return map_batches(dealt, run, schema)


def archive_pages(pages: DataFrame, least: int = 100) -> tuple[DataFrame, str]:
    """Write ``pages`` (page_id, url, html) as bundles; returns (index, folder).

    The payload is the html in UTF-8, a null being empty. Of records with equal payloads of at least
    ``least`` bytes the one with the smallest page_id is a response and the others revisit it;
    all shorter ones are responses. Rows that repeat the smallest page_id with its payload are responses
    too; a null page_id is never the smallest, and revisits one that is not null. A null url is
    about:blank. Other columns are ignored; an empty table gives no bundle.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(keys, "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    folder = new_path(pages.sparkSession, "warc")
    return write_bundles(joined.withColumn("refers_to", refers), folder), folder


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index, folder = archive_pages(pages)
    return read_records(index, folder).drop("payload")
