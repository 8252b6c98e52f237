"""WARC derivatives: metadata and plain-text conversion records of response records.

Method
    The data source "warc" reads and writes record files, one gzip member for each record, in files
    closed at ``roll_bytes``; a task writes under names of its attempt, and the list of the files that
    count is written last. From each response two records are derived: a metadata
    record, whose JSON block keeps the source's WARC headers in their order, repeats and all, HTTP status and headers, digests,
    title and links; and a conversion record with the page's text. Both name the response in
    WARC-Refers-To and each other in WARC-Concurrent-To, keep its target URI and date, and have
    identifiers that follow from the response's, so a task that runs again makes the same records.

Defined results
    * records that are no responses are passed over by ``derive``, not dropped from the source.
    * a null page text is a response with an empty payload; a null URL is an empty target.
    * HTML that ends within a comment, script or tag ends there; text is read in linear time.
    * repeated pages (same id, URL and text) are records like others, with equal identifiers.
    * an empty table gives a folder without files, which reads as no rows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quadrille.llm import files
from quadrille.llm.common import bounded_batches, removed, scratch_path

ROLL_BYTES = 32_000_000
LEVEL = 1
#: Identifiers are UUIDs of version 5 in this namespace.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-quadrille:warc")
DATE = "1970-01-01T00:00:00Z"
SUMMARY = "page_id long, record_id string, type string, target_uri string, refers_to string, concurrent_to string, source_digest string, block_digest string, whole boolean, length long, title string"
RECORD = "record_id string, type string, target_uri string, date string, refers_to string, headers string, block binary"


#: Two base-32 digits for every ten bits.
PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    """The SHA-1 of data in base 32, as WARC files label it."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def one_line(value: str) -> str:
    return value if value.isprintable() else re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record begins here")
    headers = [(k, v.strip()) for k, _, v in (line.partition(":") for line in lines)]
    length = next(int(v) for k, v in reversed(headers) if k.lower() == "content-length")
    if len(rest) < length:
        raise ValueError("the record's block is cut off")
    return headers, rest[:length]


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record with an HTTP head and the page as its payload."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    name = json.dumps(["response", page_id, url, hashlib.sha1(payload).hexdigest()])
    return record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", urn(name)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url or ""),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("X-Page-ID", "" if page_id is None else str(page_id)),
        ],
        block,
    )


# -- HTML --------------------------------------------------------------------------------------

UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
#: Tags that begin or end a line of text.
BLOCKS = frozenset("p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 section article nav header footer title pre blockquote hr body head html".split())
TAG = re.compile(r"</?([A-Za-z!?][A-Za-z0-9]*)[^<>]*>?")


def text_of(page: str) -> str:
    """The page's text, a line for each block."""
    seen = TAG.sub(lambda m: "\n" if m[1].lower() in BLOCKS else "", UNSEEN.sub(" ", page))
    lines = (html.unescape(seen) if "&" in seen else seen).split("\n")
    return "\n".join(filter(None, [" ".join(line.split()) for line in lines]))


def described(page: str) -> dict:
    title = TITLE.search(page)
    return {"title": html.unescape(title[1]).strip() if title else None, "links": [html.unescape(next(x for x in m if x)) for m in HREF.findall(page) if any(m)]}


def derived(headers: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of a response."""
    source = {k.lower(): v for k, v in headers}
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *fields = head.decode("latin-1").split("\r\n")
    page = payload.decode("utf-8", "replace")
    own = [("X-Page-ID", source["x-page-id"])] if "x-page-id" in source else []
    rid, text = source["warc-record-id"], text_of(page).encode("utf-8", "surrogatepass")
    found = digest(payload)
    ids = {kind: urn(f"{kind} of {rid}") for kind in ("metadata", "conversion")}
    common = [("WARC-Refers-To", rid), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Date", source.get("warc-date", DATE)), *own]
    body = json.dumps(
        {
            "source": [list(h) for h in headers],
            "http": {"status": status, "headers": [list(map(str.strip, f.split(":", 1))) for f in fields if ":" in f]},
            "payload": {"length": len(payload), "digest": found, "agrees": found == source.get("warc-payload-digest")},
            "html": described(page),
        },
        ensure_ascii=False,
        sort_keys=True,
    ).encode("utf-8", "surrogatepass")
    out = []
    for kind, other, content, block_ in (("metadata", "conversion", "application/json", body), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        out.append(record([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *common, ("WARC-Concurrent-To", ids[other]), ("Content-Type", content), ("WARC-Source-Payload-Digest", source.get("warc-payload-digest", "")), ("WARC-Block-Digest", digest(block_))], block_))
    return out[0], out[1]


# -- the data source ---------------------------------------------------------------------------


@dataclass
class Files(WriterCommitMessage):
    names: list


@dataclass
class File(InputPartition):
    name: str
    size: int


class WarcWriter(DataSourceArrowWriter):
    """Takes rows (record binary)."""

    def __init__(self, uri: str, roll_bytes: int):
        self.uri, self.roll_bytes = uri, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        part, names, out, held = context.partitionId(), [], None, 0
        system, path = files.place(self.uri)

        def close() -> None:
            nonlocal out, held
            if out is not None:
                out.close()
                out, held = None, 0

        for batch in iterator:
            for value in batch.column(0):
                if out is None:
                    names.append(files.own_name(part, context.taskAttemptId(), ".warc.gz", len(names)))
                    out = system.open_output_stream(f"{path}/{names[-1]}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(value.as_py()) + packer.flush()
                out.write(data)
                held += len(data)
                if held >= self.roll_bytes:
                    close()
        close()
        return Files(names)

    def commit(self, messages: list) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        files.put(self.uri, "files.json", json.dumps(names).encode())
        files.swept(self.uri, ".warc.gz", set(names))

    def abort(self, messages: list) -> None:
        for m in messages:
            for n in m.names if m else []:
                files.dropped(self.uri, n)


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    packed, parts, unpacker = b"", [], None
    while True:
        if not packed:
            packed = stream.read(size)
            if not packed:
                if unpacker is not None:
                    raise ValueError("the last record is cut off")
                return
        if unpacker is None:
            unpacker = zlib.decompressobj(31)
        parts.append(unpacker.decompress(packed))
        packed = b""
        if unpacker.eof:
            packed = unpacker.unused_data
            yield b"".join(parts)
            parts, unpacker = [], None


class WarcReader(DataSourceReader):
    """Whole records; or, in the worker that reads them, what is derived from responses or says of them."""

    def __init__(self, uri: str, options: dict):
        self.uri, self.batch_bytes = uri, int(options.get("batch_bytes", 4_000_000))
        self.form = options.get("form", "records")

    def partitions(self) -> list[InputPartition]:
        system, path = files.place(self.uri)
        with system.open_input_file(f"{path}/files.json") as f:
            names = set(json.loads(f.read()))
        return [File(n, s) for n, s in files.listed(self.uri, ".warc.gz") if n in names] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = files.place(self.uri)
        rows, held = [], 0
        with system.open_input_stream(f"{path}/{partition.name}", compression=None) as stream:
            for data in members(stream):
                rows += FORMS[self.form][1](*parsed(data))
                held += len(data)
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [c.split() for c in FORMS[self.form][0].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for (_, kind), c in zip(columns, zip(*rows))], [name for name, _ in columns])


KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}


def as_record(headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    h = {k.lower(): v for k, v in headers}
    return [(h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), json.dumps(headers), block)]


def as_derived(headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    return [(r,) for r in derived(headers, block)] if ("WARC-Type", "response") in headers else []


def as_summary(headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    h = {k.lower(): v for k, v in headers}
    kind, page = h.get("warc-type"), h.get("x-page-id")
    title = json.loads(block)["html"]["title"] if kind == "metadata" else None
    return [(int(page) if page else None, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-concurrent-to"), h.get("warc-source-payload-digest"), h.get("warc-block-digest"), digest(block) == h.get("warc-block-digest"), len(block), title)]


#: What a reader makes of each record, by the option "form": (schema, function of headers and block).
FORMS = {"records": (RECORD, as_record), "derived": ("record binary", as_derived), "summary": (SUMMARY, as_summary)}


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FORMS[self.options.get("form", "records")][0]

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        files.made(self.options["path"])
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], dict(self.options))


def write_records(records: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES) -> None:
    """Write a column of whole records."""
    spark = records.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(Warc)
    records.write.format("warc").option("roll_bytes", roll_bytes).mode("append").save(uri)


def read_records(spark: SparkSession, uri: str, form: str = "records") -> DataFrame:
    """Whole records; with form "derived" the derivatives of responses, with "summary" what records say of themselves."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("form", form).load(uri)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [response(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the responses among records."""
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += derived([tuple(h) for h in json.loads(headers)], block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return records.filter("type = 'response'").select("headers", "block").mapInArrow(run, "record binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write responses, read them, derive and write both kinds, and describe what is read back."""
    spark = pages.sparkSession
    source, made = scratch_path(spark, "warc"), scratch_path(spark, "warc-derived")
    write_records(responses(pages), source)
    write_records(read_records(spark, source, "derived"), made)
    removed(spark, source)
    return read_records(spark, made, "summary")
