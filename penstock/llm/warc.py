"""Web archives: write pages as gzip-member WARC files, and a splittable reader.

Writer: each task writes one file, a gzip member per record, to a name of its own and then moves it into
place, so a task that runs again replaces its file. Pages whose payload of at least ``revisit_bytes`` equals that of a
page with a larger page_id become revisit records without a body; others are responses.

Reader: byte ranges of all files are dealt out; a task looks for gzip's magic in its range, tries each place by
decoding a gzip header and the start of a WARC record, and owns the records that start inside its range. After a
record it goes on at the member's end, so later places are not guesses. Text payloads in UTF-8 cannot hold the magic
(0x8B never follows 0x1F there), so a place inside a record does not pass.

Files are reached through pyarrow's file systems by URI (local, object stores, HDFS), in tasks and on the driver alike.

Nulls and edge cases: null html is an empty payload; a null page_id is kept as null, and never referred to; a null url is
left out; repeated rows are records each; an empty table gives no records; other columns are ignored; of pages with equal payload
and equal largest page_id all are responses; a very long payload is one member, decoded in one task; a damaged member is passed
over up to the next place that decodes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, hot_keys, scratch_path

#: Payloads with so many copies, or a thousandth of all, are spread over so many keys.
HOT_COPIES, SALTS = 1000, 256
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, start long, payload binary"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int) -> bytes:
    """One WARC/1.1 record as a gzip member; refers_to makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def with_revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: response)."""
    html = F.coalesce("html", F.lit(""))
    large = F.octet_length(html) >= revisit_bytes
    narrow = pages.where(large).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    # Few groups are broadcast, so that bodies stay where they are. Else bodies meet the groups on their digest: a payload
    # that refers to nothing has a key of its own, and those of very frequent digests are spread.
    side = broadcast_if_small(groups, 200_000)
    number = F.monotonically_increasing_id()
    spread = F.lit(0)
    every = F.array(F.lit(0))
    if side is groups and (hot := hot_keys(narrow, "digest", HOT_COPIES)):
        spread = F.when(F.col("digest").isin(hot), F.pmod(number, F.lit(SALTS)).cast("int")).otherwise(0)
        every = F.when(F.col("digest").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(every)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    own = own.withColumn("_key", F.when(F.octet_length("html") >= revisit_bytes, F.col("digest")).otherwise(number.cast("string"))).withColumn("_salt", spread)
    side = side.select(F.col("digest").alias("_key"), F.explode(every).alias("_salt"), "_last")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("_last"))
    return own.join(side, ["_key", "_salt"], "left").select("page_id", "url", "html", "digest", F.when(other, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, level: int = 6) -> DataFrame:
    """Write pages below folder; runs as a job and gives (file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = open_folder(folder)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        draft = f"{root}/_{context.partitionId():06d}-{context.taskAttemptId()}"
        out, records, size = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                out = out or place.open_output_stream(draft, compression=None)
                data = record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], level)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            place.move(draft, name)
            yield pa.record_batch([pa.array([name]), pa.array([records]), pa.array([size])], ["file", "records", "bytes"])

    place, root = open_folder(folder)
    place.create_dir(root, recursive=True)
    return with_revisits(pages, revisit_bytes).mapInArrow(run, "file string, records long, bytes long")


class Source:
    """A file read forwards in blocks, with what has been read from `start` on kept until dropped."""

    def __init__(self, handle, start: int):
        self.handle, self.start, self.data, self.ended = handle, start, b"", False
        handle.seek(start)

    def more(self) -> bool:
        if not self.ended:
            block = self.handle.read(READ)
            self.ended = not block
            self.data += block
        return not self.ended

    def drop(self, upto: int) -> None:
        self.data = self.data[upto - self.start :]
        self.start = upto


def member_at(source: Source, at: int) -> tuple[bytes, int] | None:
    """The gzip member at a place and its end, or None if no WARC record starts there."""
    engine, out, k = zlib.decompressobj(31), [], at - source.start
    total = 0
    while not engine.eof:
        if k >= len(source.data) and not source.more():
            return None
        block = source.data[k : k + (1024 if not total else READ)]
        k += len(block)
        try:
            got = engine.decompress(block)
        except zlib.error:
            return None
        out.append(got)
        total += len(got)
        if total >= 5 and not b"".join(out[:4]).startswith(b"WARC/"):
            return None
    data = b"".join(out)
    return (data, source.start + k - len(engine.unused_data)) if data.startswith(b"WARC/") else None


def parse_record(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    field = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = block[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: None if x is None or (n := x.strip("<>").rpartition(":")[2]) == "none" else int(n)
    kind = field["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        inner = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
        size, digest = int(inner["content-length"]), base64.b32decode(field["warc-payload-digest"].removeprefix("sha1:")).hex()
    return {"page_id": page(field["warc-record-id"]), "url": field.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": page(field.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def records_in(handle, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """(start, record) of the records that start in [begin, end)."""
    source, at = Source(handle, begin), begin
    while at < end:
        found = source.data.find(MAGIC, at - source.start)
        if found < 0:
            keep = max(at, source.start + len(source.data) - 2)
            source.drop(keep)
            at = keep
            if not source.more():
                return
            continue
        place = source.start + found
        if place >= end:
            return
        source.drop(place)
        if (got := member_at(source, place)) is None:
            at = place + 1
            continue
        yield place, parse_record(got[0])
        at = got[1]
        source.drop(at)


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of all .warc.gz files below folder, with the file and offset of each.

    The driver lists the files and makes a row per range; a row per 8 MB is small at any size.
    """
    place, root = open_folder(folder)
    files = [f for f in place.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.path.endswith(".warc.gz")]
    splits = [(f.path, a, min(a + split_bytes, f.size)) for f in files for a in range(0, f.size, split_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(split["file"]) as handle:
                    for start, r in records_in(handle, split["begin"], split["end"]):
                        rows.append(r | {"file": split["file"], "start": start} | ({} if payloads else {"payload": None}))
                        held += len(r["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    if not splits:
        return spark.createDataFrame([], RECORD)
    dealt = spark.createDataFrame(splits, "file string, begin long, end long").repartition(len(splits))
    return dealt.mapInArrow(run, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("payload", pa.binary())])


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
