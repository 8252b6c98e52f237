"""Media columns: a Spark data source over archives of payloads.

Method
    Payloads are stored losslessly as 8-bit grey PNG images, 64 samples a row, in ZIP archives (the
    images are compressed already, so members are stored as they are). An archive is closed at
    ``roll_bytes``; its central directory is therefore bounded. The data source "media_archive"
    plans partitions on the driver: byte ranges of about
    ``range_bytes`` of each archive, from the list of archives, which has each one's directory. A task
    reads its archive's directory, takes the members whose offset lies in its range, reads
    successive ones together in stretches of bounded bytes, and passes them through Arrow. Each
    member is checked against its CRC; one whose read or check fails is read again by itself, by its own
    offset, from a newly opened file.

    Archives of more than 4 GB or 65,535 members use the ZIP64 records, which are read.

Defined results
    * a null or empty text is 64 zero bytes. Payloads are padded with zeros to a positive multiple of 64.
    * null and repeated ids are members like others: the id is in the member's comment, not its name.
    * a member that fails ``retries`` times raises with its archive and offset, or is a row with
      null payload where on_error is "null".
    * an empty table gives a folder without archives, which reads as no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quadrille.llm import files
from quadrille.llm.common import bounded_batches, ids_and_texts, scratch_path

WIDTH = 64
ROLL_BYTES = 64_000_000
RANGE_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, 64 wide, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png wrote; every chunk's CRC is checked."""
    if image[:8] != PNG:
        raise ValueError("no PNG image")
    at, data, height = 8, [], 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of this width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not read")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and mean step between samples, in 1/1000, and the 16 high-nibble counts in 1/1000."""
    x = np.frombuffer(payload, np.uint8)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(len(x) - 1, 1)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};step={step};bins={'-'.join(map(str, bins.tolist()))}"


# -- writing -----------------------------------------------------------------------------------


@dataclass
class Archives(WriterCommitMessage):
    names: list


class ArchiveWriter(DataSourceArrowWriter):
    """Takes rows (id long, n_bytes long, media binary); writes archives of about roll_bytes."""

    def __init__(self, uri: str, roll_bytes: int):
        self.uri, self.roll_bytes = uri, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        part, names = context.partitionId(), []
        system, path = files.place(self.uri)
        sink = raw = out = None
        members = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                sink.close()
                # name, size, and the directory's offset and size
                names[-1] += [raw.tell(), out.start_dir, raw.tell() - out.start_dir]
                out = None

        for batch in iterator:
            for row, n, media in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None:
                    names.append([files.own_name(part, context.taskAttemptId(), ".zip", len(names))])
                    sink = system.open_output_stream(f"{path}/{names[-1][0]}")
                    raw = _Forward(sink)
                    out = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True)
                info = zipfile.ZipInfo(f"m{members:09d}.png", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps([row, n]).encode()
                out.writestr(info, media)
                members += 1
                if out.fp.tell() >= self.roll_bytes:
                    close()
        close()
        return Archives(names)

    def commit(self, messages: list) -> None:
        """The list of archives, written last: files of lost attempts are not in it."""
        names = sorted(n for m in messages if m for n in m.names)
        files.put(self.uri, "archives.json", json.dumps(names).encode())
        files.swept(self.uri, ".zip", {n[0] for n in names})

    def abort(self, messages: list) -> None:
        for m in messages:
            for n in m.names if m else []:
                files.dropped(self.uri, n[0])


class _Forward(io.RawIOBase):
    """A forward-only file over an Arrow stream, for zipfile."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass


# -- planning and reading ------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    name: str
    size: int
    directory: int  # offset of the central directory
    directory_size: int
    start: int
    end: int


@dataclass
class Member:
    offset: int
    size: int
    crc: int
    id: int | None
    n_bytes: int


def directory(uri: str, name: str, at: int, size: int) -> Iterator[Member]:
    data, p = files.ranged(uri, name, at, size), 0
    while p + 46 <= len(data) and data[p : p + 4] == b"PK\x01\x02":
        crc, packed, full = struct.unpack_from("<III", data, p + 16)
        n, extra, note = struct.unpack_from("<HHH", data, p + 28)
        (offset,) = struct.unpack_from("<I", data, p + 42)
        x, end = p + 46 + n, p + 46 + n + extra
        while x + 4 <= end:
            tag, length = struct.unpack_from("<HH", data, x)
            if tag == 1:
                y = x + 4
                if full == 0xFFFFFFFF:
                    (full,) = struct.unpack_from("<Q", data, y)
                    y += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", data, y)
                    y += 8
                if offset == 0xFFFFFFFF:
                    (offset,) = struct.unpack_from("<Q", data, y)
            x += 4 + length
        row, n_bytes = json.loads(data[end : end + note])
        yield Member(offset, packed, crc, row, n_bytes)
        p = end + note


def read_member(uri: str, name: str, m: Member, retries: int, pause: float = 0.05, fetch=files.ranged) -> bytes:
    """One member by its offset; a failed read or check is tried again, by itself."""
    for attempt in range(retries + 1):
        try:
            head = fetch(uri, name, m.offset, 30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member begins there")
            skip = 30 + sum(struct.unpack_from("<HH", head, 26))
            data = fetch(uri, name, m.offset + skip, m.size)
            if len(data) != m.size or zlib.crc32(data) != m.crc:
                raise OSError("the member's bytes do not match its CRC")
            return data
        except OSError as e:
            if attempt == retries:
                raise OSError(f"{name} at {m.offset}: {e}") from e
            time.sleep(pause * 2**attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, options: dict):
        self.uri = uri
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("on_error", "raise")

    def partitions(self) -> list[InputPartition]:
        system, path = files.place(self.uri)
        with system.open_input_file(f"{path}/archives.json") as f:
            archives = json.loads(f.read())
        out = []
        for name, size, at, n in archives:
            pieces = max(1, -(-at // self.range_bytes))
            out += [Range(name, size, at, n, at * i // pieces, at * (i + 1) // pieces) for i in range(pieces)]
        return out or [Range("", 0, 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.name:
            return
        own: list[Member] = []
        for m in directory(self.uri, p.name, p.directory, p.directory_size):
            if not p.start <= m.offset < p.end:
                continue
            if own and m.offset + m.size - own[0].offset > self.batch_bytes:
                yield self.batch(self.rows(p, own, m.offset))
                own = []
            own.append(m)
        if own:
            yield self.batch(self.rows(p, own, min(p.directory, own[-1].offset + 30 + (1 << 17) + own[-1].size)))

    def rows(self, p: Range, members: list[Member], end: int) -> list[tuple]:
        """Members that stand together, from one read; those that it does not give whole are read by themselves."""
        first, out = members[0].offset, []
        try:
            data = files.ranged(self.uri, p.name, first, end - first)
        except OSError:
            data = b""
        for m in members:
            at = m.offset - first
            image = None
            if data[at : at + 4] == b"PK\x03\x04" and len(data) >= at + 30:
                at += 30 + sum(struct.unpack_from("<HH", data, at + 26))
                image = data[at : at + m.size]
            if image is None or len(image) != m.size or zlib.crc32(image) != m.crc:
                try:
                    image = read_member(self.uri, p.name, m, self.retries)
                except OSError:
                    if self.on_error != "null":
                        raise
                    image = None
            out.append((m.id, m.n_bytes, p.name, m.offset, image))
        return out

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "n_bytes", "archive", "offset", "media"])


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, archive string, offset long, media binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        files.made(self.options["path"])
        return ArchiveWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], dict(self.options))


# -- texts as media ------------------------------------------------------------------------------


def _imager(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, images = [], []
            for text in batch.column(1):
                text = text.as_py()
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                images.append(to_png(payload_of(text), level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["id", "n_bytes", "media"])

    return run


def write_media(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6, roll_bytes: int = ROLL_BYTES) -> None:
    """Store every text's payload as an image in archives of the folder uri."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(MediaArchive)
    made = ids_and_texts(docs, id_col, text_col).mapInArrow(_imager(level), "id long, n_bytes long, media binary")
    made.write.format("media_archive").option("roll_bytes", roll_bytes).mode("append").save(uri)


def read_media(spark: SparkSession, uri: str, **options) -> DataFrame:
    """(id, n_bytes, archive, offset, media binary) of every member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(uri)


def _describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(batch.schema.names.index("media"))
        size, sha, tail, stored, stored_sha, feature = [], [], [], [], [], []
        for m in media:
            image = m.as_py()
            if image is None:
                for c in (size, sha, tail, stored, stored_sha, feature):
                    c.append(None)
                continue
            payload = from_png(image)
            size.append(len(payload))
            sha.append(hashlib.sha256(payload).hexdigest())
            tail.append(zlib.crc32(payload[-64:]))
            stored.append(len(image))
            stored_sha.append(hashlib.sha256(image).hexdigest())
            feature.append(feature_of(payload))
        columns = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(stored, pa.int64()), pa.array(stored_sha, pa.string()), pa.array(feature, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe(media: DataFrame) -> DataFrame:
    """Sizes, digests and the feature of each member's samples."""
    return media.select("id", "n_bytes", "media").mapInArrow(
        _describer, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    uri = scratch_path(spark, "media")
    write_media(docs, uri, id_col, text_col)
    return describe(read_media(spark, uri))
