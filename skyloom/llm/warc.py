"""Seekable Zstandard bundles of WARC records.

A bundle is a sequence of independent Zstandard frames, each with whole
records, and ends with a skippable frame that lists the frames (the public
seekable format). Any Zstandard tool can read a bundle from start to end, and
``fetch`` reads one record by decompressing one frame only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import map_texts, stored

# fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
INDEX = ("record_id string, page_id long, record_type string, bundle string, frame int, record_offset long, record_length long")
RECORD = ("record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary")


def classify(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, first_id)``; ``first_id`` is set for revisits, whose payload is null.

    Among records with equal payloads of ``least`` bytes or more, that with the
    smallest identifier keeps its payload and the others revisit it. Rows that
    repeat the smallest identifier keep theirs too; a null identifier is never
    smallest, and a group of nulls only has no revisits. A null payload is empty.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = (rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    known = rows.join(shared, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
                        F.when(again, F.col("first_id")).alias("first_id"))


def record_id(page_id: int | None, digest: str) -> str:
    """A name that a revisit can work out for the record that it refers to."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first_id: int | None,
                  date: str) -> tuple[str, str, bytes]:
    """``(record id, record type, bytes)`` of one record."""
    kind, own = ("revisit" if first_id is not None else "response"), record_id(page_id, digest)
    body = b"" if payload is None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first_id is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}", f"X-Refers-To-Page-ID: {first_id}",
                 f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    return own, kind, "\r\n".join(head).encode() + http + body + b"\r\n\r\n"


def decode_record(data: memoryview | bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` of a frame, and where the next one begins."""
    raw = bytes(data[at:at + 65536])
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raw = bytes(data[at:])
        end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at offset {at} of the frame")
    head = dict(x.split(": ", 1) for x in lines)
    begin, size = at + end + 4, int(head["Content-Length"])
    block = bytes(data[begin:begin + size])
    if len(block) != size:
        raise ValueError(f"record {head['WARC-Record-ID']} is cut short")
    payload = block[block.index(b"\r\n\r\n") + 4:]
    number = lambda k: int(head[k]) if k in head else None
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        length, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"record {head['WARC-Record-ID']} doesn't have the digest that it names")
    else:
        length, payload = number("X-Payload-Length"), None
    return {"record_id": head["WARC-Record-ID"], "page_id": number("X-Page-ID"), "url": head.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": length, "payload_digest": digest, "payload": payload}, begin + size + 4


class Bundle:
    """Writes one bundle, frame by frame."""

    def __init__(self, path: str, level: int):
        self.path, self.level, self.frames, self.bytes = path, level, [], 0
        files, inner = pafs.FileSystem.from_uri(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(inner, compression=None)

    def add(self, data: bytes) -> int:
        packed = zstandard.ZstdCompressor(level=self.level).compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.bytes += len(packed)
        return len(self.frames) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def write_bundles(records: DataFrame, folder: str, date: str, frame_bytes: int = 1 << 20,
                  bundle_bytes: int = 1 << 30, level: int = 3) -> DataFrame:
    """Write the rows of ``classify`` and return the stored index, one row per record.

    Every task writes its own bundles and begins a new one at ``bundle_bytes``.
    A frame is closed at ``frame_bytes``, so a longer record has a frame of its
    own. File names hold the attempt, and the index is committed by Spark: what
    a lost or repeated attempt wrote is in no index. ``folder`` may be any place
    that executors can write to.
    """
    def write(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        task = TaskContext.get()
        bundle, made, buffer, waiting, held = None, 0, [], [], 0

        def flush() -> dict:
            nonlocal bundle, made, buffer, waiting, held
            if bundle is None:
                bundle, made = Bundle(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.zst", level), made + 1
            frame, path = bundle.add(b"".join(buffer)), bundle.path
            out = {k: [w[i] for w in waiting] for i, k in enumerate(("record_id", "page_id", "record_type", "record_offset", "record_length"))}
            out |= {"bundle": [path] * len(waiting), "frame": [frame] * len(waiting)}
            if bundle.bytes >= bundle_bytes:
                bundle.close()
                bundle = None
            buffer, waiting, held = [], [], 0
            return out

        for part in parts:
            columns = [part[c].to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "first_id")]
            for row in zip(*columns):
                name, kind, data = encode_record(*row, date)
                waiting.append((name, row[0], kind, held, len(data)))
                buffer.append(data)
                held += len(data)
                if held >= frame_bytes:
                    yield flush()
        if buffer:
            yield flush()
        if bundle is not None:
            bundle.close()

    return stored(map_texts(records, write, INDEX), "warc-index")


def frames_of(path: str) -> tuple[object, list[tuple[int, int, int, int]]]:
    """An open bundle and ``(offset, packed size, size, checksum)`` of its frames, from the seek table at its end."""
    files, inner = pafs.FileSystem.from_uri(path)
    handle = files.open_input_file(inner)
    end = handle.size()
    handle.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError(f"{path} has no seek table")
    width = 12 if flags & CHECKSUM_FLAG else 8
    handle.seek(end - 9 - count * width)
    table, at, found = handle.read(count * width), 0, []
    for i in range(count):
        packed, size, check = struct.unpack_from("<III" if width == 12 else "<II", table, i * width) + ((None,) if width == 8 else ())
        found.append((at, packed, size, check))
        at += packed
    return handle, found


def read_frame(handle, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = frame
    handle.seek(at)
    data = zstandard.ZstdDecompressor().decompress(handle.read(packed), max_output_size=size)
    if len(data) != size or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"damaged frame at {at}")
    return data


def _columns(rows: list[dict]) -> dict:
    return {k: [r[k] for r in rows] for k in ("record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
                                              "payload")}


def read_bundles(index: DataFrame, with_payload: bool = True, megabytes: int = 64) -> DataFrame:
    """Every record of the bundles that an index names, read from the files, with digests checked.

    A task takes runs of frames of about ``megabytes`` of records and holds one frame at a time.
    """
    runs = (index.groupBy("bundle", "frame").agg(F.sum("record_length").alias("size")))
    total = runs.agg(F.sum("size")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // (megabytes << 20)))

    def read(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            opened: dict[str, tuple] = {}
            for path, frame in sorted(zip(part["bundle"].to_pylist(), part["frame"].to_pylist())):
                if path not in opened:
                    for handle, _ in opened.values():
                        handle.close()
                    opened = {path: frames_of(path)}
                handle, frames = opened[path]
                data, at, rows = read_frame(handle, frames[frame]), 0, []
                while at < len(data):
                    row, at = decode_record(data, at)
                    rows.append(row if with_payload else row | {"payload": None})
                yield _columns(rows)
            for handle, _ in opened.values():
                handle.close()

    return map_texts(runs.select("bundle", "frame").repartition(int(tasks), "bundle", "frame"), read, RECORD)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records with the identifiers ``wanted.record_id``: for each, one frame is read and one record is cut out."""
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "record_offset").distinct()

    def read(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            for path, frame, at in sorted(zip(*(part[c].to_pylist() for c in ("bundle", "frame", "record_offset")))):
                handle, frames = frames_of(path)
                with handle:
                    yield _columns([decode_record(read_frame(handle, frames[frame]), at)[0]])

    return map_texts(places, read, RECORD)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Classify, write and index the pages, dated now; the folder defaults to one below the shared folder."""
    options.setdefault("date", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    where = folder or scratch_path(pages.sparkSession, "warc")
    return write_bundles(classify(pages), where, **options)
