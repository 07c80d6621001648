"""Dictionary-compressed WARC archives.

Records are dealt over archives by a hash of their id.  Each archive trains a Zstandard dictionary on its own first
records, embeds it in a leading skippable frame and compresses every record as a frame of its own, so that one record
can be read with the dictionary alone.  A payload that several records share is stored once; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialize, spread
from .common import map_batches

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 20  # of an archive's first records, for its dictionary
ARCHIVE_BYTES = 16 << 20  # of payload, on average
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, stored: bool,
                date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record which has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if stored else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if stored else 'revisit'}",
            f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if not stored:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of one record; a stored payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda name: int(v) if (v := fields.get(name, "")[1 + len(RECORD_ID):-1]) else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("WARC-Record-ID"), "record_type": kind, "payload_digest": digest, "payload": payload,
            "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number("WARC-Refers-To"),
            "url": url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)}


def train_dictionary(records: Iterable[bytes]) -> bytes | None:
    """A dictionary from the first ``SAMPLE_BYTES`` of ``records``, or None where they are too few to train on."""
    sample, size = [], 0
    for r in records:
        sample.append(r[:128 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes one archive: its dictionary frame, then one frame per record."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.compressor = out, [], 0, None

    def add(self, record: bytes) -> None:
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        trained = train_dictionary(self.waiting)
        if trained:
            self.out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._start()


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, one at a time."""
    dictionary, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(data[8:8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        one = reader.decompressobj()
        record = one.decompress(memoryview(data)[at:])
        at = len(data) - len(one.unused_data)
        yield parse_record(record)


def _open_folder(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row into ``folder`` (a URI all executors reach); gives (archive, records).

    Of rows with equal payloads of at least ``least_bytes``, those with the largest id are responses (all of them if a
    row is repeated), the others revisits; rows with a null id are revisits unless every such row has one.  A null
    payload is empty.  An archive has the same bytes whenever it is written again, so a task may be repeated; it is
    written under another name and then moved.
    """
    if not isinstance(pages.schema[id_col].dataType, LongType):
        raise TypeError(f"{id_col} must be a bigint")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    narrow = materialize(spread(rows).select("sha1", "n", "id"), "warc-digests")
    shared = materialize(narrow.filter(F.col("n") >= least_bytes).groupBy("sha1", "n")
                         .agg(F.max("id").alias("first"), F.count("*").alias("c")).filter("c > 1")
                         .select("sha1", "n", "first"), "warc-shared")
    size = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    archives = max(1, -(-size // archive_bytes))
    rows = (rows.join(shared, ["sha1", "n"], "left")
            .withColumn("archive", F.pmod(F.xxhash64("id", "sha1"), F.lit(archives)).cast("long"))
            .select("archive", "id", "url", "html", "first")
            .repartition(archives, "archive").sortWithinPartitions("archive", F.col("id"), F.col("url")))

    def make():
        system, base = _open_folder(folder)
        system.create_dir(base, recursive=True)
        state: dict = {"archive": None}

        def finish():
            if state["archive"] is None:
                return []
            state["writer"].close()
            state["out"].close()
            system.move(state["temporary"], f"{base}/part-{state['archive']:09d}.warc.zst")
            return [(state["archive"], state["records"])]

        def step(batch: pa.RecordBatch | None):
            done = []
            if batch is None:
                done = finish()
            else:
                for archive, page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if archive != state["archive"]:
                        done += finish()
                        temporary = f"{base}/_{uuid.uuid4().hex}"
                        out = system.open_output_stream(temporary)
                        state.update(archive=archive, temporary=temporary, out=out, writer=ArchiveWriter(out), records=0)
                    stored = first is None or page == first
                    state["writer"].add(make_record(page, url, html.encode(), first, stored))
                    state["records"] += 1
            return {"archive": [d[0] for d in done], "records": [d[1] for d in done]}

        return step

    return map_batches(rows, make, "archive bigint, records bigint", last=True)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}

    def make():
        def step(batch: pa.RecordBatch):
            found = [r for data in batch.column(0) for r in read_archive(data.as_py())]
            return {n: [r[n] for r in found] for n in names}
        return step

    return map_batches(files, make, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
