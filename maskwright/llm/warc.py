"""Dictionary-compressed web archives.

An archive is a file of Zstandard frames: a leading skippable frame that holds
the dictionary, then one frame per WARC record, so that any record can be read
alone. The dictionary is trained on the first records of the archive. Archives
go to the shared folder; the manifest lists only those of tasks that ended
well, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, shared_folder, stored

#: Fixed values of the format: first skippable frame that holds a dictionary, Zstandard's own frame mark.
DICTIONARY_MARK = (0x184D2A5D).to_bytes(4, "little")
FRAME_MARK = (0xFD2FB528).to_bytes(4, "little")
MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, sound boolean")


@dataclass(frozen=True)
class Archive:
    """Limits of one archive."""

    payload_bytes: int = 64 << 20
    sample_bytes: int = 2 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _uri(url: str | None, page: int | None) -> str:
    """The url as a header may hold it: controls and blanks percent-encoded."""
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit of page ``refers_to`` without its payload."""
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page)}", f"WARC-Payload-Digest: sha1:{base32}",
            f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or none where they are too few to train on."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 * 256:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes records to archives of a folder; ``done`` has the manifest rows of closed ones."""

    def __init__(self, folder: str, limits: Archive):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.limits = folder, limits
        self.done: list[tuple[str, int, int]] = []
        self.waiting: list[bytes] = []
        self.out = None
        self.size = self.records = self.written = 0

    def add(self, made: bytes) -> None:
        self.size += len(made)
        self.records += 1
        if self.out is None:
            self.waiting.append(made)
            if self.size >= self.limits.sample_bytes:
                self._begin()
        else:
            self._put(self.press.compress(made))
        if self.size >= self.limits.payload_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        found = train(self.waiting, self.limits.dictionary_bytes)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{self.folder}/{name}"
        self.out = self.fs.open_output_stream(f"{self.root}/{name}", compression=None)
        if found is not None:
            data = found.as_bytes()
            self._put(DICTIONARY_MARK + len(data).to_bytes(4, "little") + data)
        self.press = zstandard.ZstdCompressor(level=self.limits.level, dict_data=found, write_checksum=True)
        for made in self.waiting:
            self._put(self.press.compress(made))
        self.waiting = []

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._begin()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.written))
        self.out, self.size, self.records, self.written = None, 0, 0, 0


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as source:
        held = source.read(8)
        found = None
        if held[:4] == DICTIONARY_MARK:
            found = zstandard.ZstdCompressionDict(source.read(int.from_bytes(held[4:8], "little")))
            held = b""
        engine = zstandard.ZstdDecompressor(dict_data=found)
        frame, parts = engine.decompressobj(), []
        while True:
            if not held:
                held = source.read(chunk)
                if not held:
                    break
            parts.append(frame.decompress(held))
            held = b""
            if frame.eof:
                yield b"".join(parts)
                held = frame.unused_data
                frame, parts = engine.decompressobj(), []
        if any(parts):
            raise ValueError(f"{path} ends within a record")


def parse_record(data: bytes) -> tuple:
    """A row of RECORDS; ``sound`` tells whether a response's payload has the digest of its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    page, to = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    if kind == "response":
        sound, length = hashlib.sha1(payload).hexdigest() == digest, len(payload)
    else:
        sound, payload = not payload, None
    return (page and int(page), fields["WARC-Target-URI"], payload, length, digest, kind, to and int(to), sound)


def _with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page, url, html, digest, refers_to) of every row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    light = rows.where(F.octet_length("html") >= min_bytes).select("page", F.sha1("html").alias("digest"))
    last = light.groupBy("digest").agg(F.max("page").alias("last"), F.count("*").alias("n")).where(
        (F.col("n") > 1) & F.col("last").isNotNull())
    again = light.join(last, "digest").where(~F.col("page").eqNullSafe(F.col("last")))
    again = again.select(F.col("page").alias("again"), F.col("digest").alias("same"), "last").distinct()
    return rows.withColumn("digest", F.sha1("html")).join(
        again, F.col("page").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left").select(
        "page", "url", "html", "digest", F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 1000, limits: Archive = Archive()) -> DataFrame:
    """Write a record per row, return the manifest (path, records, bytes).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is a response and the others revisit it; smaller ones are
    all responses. A null html is an empty payload. Rows that repeat the
    largest id are responses each; a null id revisits where its group has an id,
    and is a response otherwise. An empty table writes no archive.
    ``folder`` must be reachable by every executor; by default it is a new one
    below ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if made is None:
                made = Writer(folder, limits)
                made.fs.create_dir(made.root, recursive=True)
            page, url, html, digest, to = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                made.add(record(page[i].as_py(), url[i].as_py(), html[i].as_buffer().to_pybytes(), digest[i].as_py(),
                                to[i].as_py(), limits.date))
        if made is not None:
            made.close()
            paths, records, sizes = zip(*made.done) if made.done else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()),
                                              pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    rows = _with_revisits(pages, id_col, url_col, html_col, min_bytes)
    return stored(arrow_map(rows, write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True, rows_at_once: int = 256) -> DataFrame:
    """The records of the archives of a manifest, an archive a task; without ``payloads`` these are null."""
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for data in read_archive(path):
                    row = parse_record(data)
                    rows.append(row if payloads else (*row[:2], None, *row[3:]))
                    if len(rows) >= rows_at_once:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return arrow_map(manifest.select("path").repartition(max(1, manifest.count())), read, RECORDS)
