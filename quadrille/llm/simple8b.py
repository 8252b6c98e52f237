"""Token ids in a binary format: Simple-8b word-aligned coding.

Format
    A file holds blocks and then a footer. A block holds whole documents and has four parts: the
    64-bit words, the escapes, and for each document its id and its number of ids. The top four
    bits of a word are its selector, which says how many ids of how many bits the other 60 hold
    (Anh and Moffat, 2010). An id of ESCAPE or over stands in the words as ESCAPE, and in the
    escapes as 32 bits, so that one wide id does not widen its neighbours. The footer has for each
    block its offset and the counts of its parts, so a reader can take any block and decode it with
    a few vector operations; its length and a magic number end the file.

    A folder holds one file for each range of the document order and a manifest, written last, with
    each file's numbers of documents, ids and blocks: a reader knows from it where each file's ids start.

Writing and reading are the Spark data source "simple8b". A task writes its file under a name of
its attempt; the manifest names the files of the attempts that count, so a task may run again or twice.

Defined results
    * a null or empty text is a document with no ids but the end id.
    * documents come by id, null ids first, then by their ids; repeated ids are documents like others.
    * an empty table gives a folder with a manifest and no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quadrille.llm import files
from quadrille.llm.common import bounded_batches, ids_and_texts, ranges, scratch_path

#: (ids in a word, bits of each) by selector. The first two hold zeros alone.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = (1 << 15) - 1
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
ENDING = ".s8b"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of non-negative ids under 2**32. A last word may be part filled."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    wide = ids >= ESCAPE
    escapes = ids[wide].astype(np.uint32)
    x = np.where(wide, np.uint64(ESCAPE), ids)
    choice = np.full(n, 12, np.int64)
    # past the end stand zeros, so a last word may be part filled
    padded = np.concatenate([x, np.zeros(240, np.uint64)])
    fits, values = np.arange(n + 240), padded.astype(np.uint16)
    for s in range(11, -1, -1):
        count, bits = SELECTORS[s]
        own = values < (1 << bits)
        fits, values = fits[own], values[own]  # what fits fewer bits is among what fits more
        # count successive places that fit, by their first
        first = fits[: len(fits) - count + 1]
        first = first[fits[count - 1 :] - first == count - 1]
        choice[first[first < n]] = s
    steps = np.array([c for c, _ in SELECTORS])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    used = choice[starts] if n else np.empty(0, np.int64)
    words = used.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(used == s)
        if bits and len(own):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(padded[starts[own, None] + np.arange(count)] << shifts, axis=1)
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids, as unsigned 32-bit numbers."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        if bits and len(own):
            shifts, mask = (np.arange(count) * bits).astype(np.uint64), np.uint64((1 << bits) - 1)
            out[starts[own, None] + np.arange(count)] = (words[own, None] >> shifts) & mask
    out = out[:n].astype(np.uint32)
    out[out == ESCAPE] = escapes
    return out


@dataclass
class Block:
    offset: int
    words: int
    escapes: int
    docs: int
    ids: int

    def size(self) -> int:
        return 8 * self.words + 4 * self.escapes + 17 * self.docs


def encode_block(offset: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> tuple[bytes, Block]:
    flat = np.concatenate(ids)
    words, escapes = pack(flat)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    names = np.array([i or 0 for i in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<i8")
    data = b"".join(x.tobytes() for x in (words.astype("<u8"), escapes.astype("<u4"), names, lengths, known))
    return data, Block(offset, len(words), len(escapes), len(ids), len(flat))


def decode_block(data: bytes, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, numbers of ids, document ids, whether they are not null) of a block."""
    out, at = [], 0
    for kind, n in (("<u8", b.words), ("<u4", b.escapes), ("<i8", b.docs), ("<i8", b.docs), ("<u1", b.docs)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    words, escapes, names, lengths, known = out
    return unpack(words, escapes, b.ids), lengths, names, known.astype(bool)


def footer_bytes(blocks: list[Block]) -> bytes:
    data = json.dumps([[b.offset, b.words, b.escapes, b.docs, b.ids] for b in blocks]).encode()
    return data + len(data).to_bytes(8, "little") + MAGIC


def read_footer(uri: str, name: str, size: int) -> list[Block]:
    tail = files.ranged(uri, name, size - 12, 12)
    if tail[8:] != MAGIC:
        raise ValueError(f"{name} is no whole file of this format")
    n = int.from_bytes(tail[:8], "little")
    return [Block(*b) for b in json.loads(files.ranged(uri, name, size - 12 - n, n))]


# -- the data source ----------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str
    part: int
    docs: int
    ids: int
    blocks: int
    size: int


class Simple8bWriter(DataSourceArrowWriter):
    """Takes rows of one range a task, in order: (doc_id long, ids binary: little-endian 32-bit).

    With a tokenizer's file it takes (doc_id long, text string) and encodes in the same worker.
    """

    def __init__(self, uri: str, tokenizer: str | None = None, end_id: int | None = None):
        self.uri, self.tokenizer = uri, tokenizer
        self.tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def id_bytes(self, column: pa.Array) -> list[bytes]:
        if self.tokenizer is None:
            return [x or b"" for x in column.to_pylist()]
        return [x + self.tail for x in piece_encoder(self.tokenizer).encode(column.to_pylist())]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        part = context.partitionId()
        name = files.own_name(part, context.taskAttemptId(), ENDING)
        system, path = files.place(self.uri)
        blocks, offset = [], 0
        names: list[int | None] = []
        own: list[np.ndarray] = []
        pending = 0
        with system.open_output_stream(f"{path}/{name}") as out:

            def flush() -> None:
                nonlocal offset, pending
                if own:
                    data, block = encode_block(offset, names, own)
                    out.write(data)
                    blocks.append(block)
                    offset += len(data)
                    names.clear()
                    own.clear()
                    pending = 0

            for batch in iterator:
                for i, ids in zip(batch.column(0).to_pylist(), self.id_bytes(batch.column(1))):
                    own.append(np.frombuffer(ids, "<u4"))
                    names.append(i)
                    pending += len(own[-1])
                    if pending >= BLOCK_IDS:
                        flush()
            flush()
            end = footer_bytes(blocks)
            out.write(end)
        return Written(name, part, sum(b.docs for b in blocks), sum(b.ids for b in blocks), len(blocks), offset + len(end))

    def commit(self, messages: list) -> None:
        """The manifest, written last, makes the folder whole."""
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        files.put(self.uri, "manifest.json", json.dumps([[m.name, m.docs, m.ids, m.blocks, m.size] for m in parts]).encode())
        files.swept(self.uri, ENDING, {m.name for m in parts})

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                files.dropped(self.uri, m.name)


@dataclass
class Blocks(InputPartition):
    name: str
    size: int
    start: int


class Simple8bReader(DataSourceReader):
    """One partition for each file; each yields (doc_id, start, ids), or with digests (doc_id, start, n_tokens, ids_crc32)."""

    def __init__(self, uri: str, digests: bool = False):
        self.uri, self.digests = uri, digests

    def partitions(self) -> list[InputPartition]:
        system, path = files.place(self.uri)
        with system.open_input_file(f"{path}/manifest.json") as f:
            manifest = json.loads(f.read())
        out, start = [], 0
        for name, docs, ids, _, size in manifest:
            if docs:
                out.append(Blocks(name, size, start))
            start += ids
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        start = partition.start
        for block in read_footer(self.uri, partition.name, partition.size):
            ids, lengths, names, known = decode_block(files.ranged(self.uri, partition.name, block.offset, block.size()), block)
            ends = np.cumsum(lengths)
            columns = {"doc_id": pa.array(names, pa.int64(), mask=~known), "start": pa.array(start + ends - lengths)}
            if self.digests:
                columns["n_tokens"] = pa.array(lengths, pa.int64())
                columns["ids_crc32"] = pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends - lengths, ends)], pa.int64())
            else:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            start += int(ends[-1])


class Simple8b(DataSource):
    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def schema(self) -> str:
        rest = "n_tokens long, ids_crc32 long" if self.options.get("digests") == "true" else "ids array<long>"
        return f"doc_id long, start long, {rest}"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        files.made(self.options["path"])
        return Simple8bWriter(self.options["path"], self.options.get("tokenizer"), self.options.get("end_id"))

    def reader(self, schema) -> DataSourceReader:
        return Simple8bReader(self.options["path"], self.options.get("digests") == "true")


# -- texts to ids ------------------------------------------------------------------------------


CACHE_PIECES = 500_000
CACHE_PARTS = 100_000
#: Letters with a space before them, or what stands between: white space, digits and marks.
PIECE = re.compile(r" ?[^\W\d_]+|(?:(?! ?[^\W\d_]).)+", re.S)
#: What stands in a text that is not cut: apostrophes (of contractions), white space twice, the mark
#: of special tokens, and characters beyond Latin, or that are numbers but no digits.
WHOLE = re.compile("['\\xb2\\xb3\\xb9\\xbc-\\xbe]|\\s\\s|<\\||[^\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


#: Marks that are words of their own behind a run of letters.
MARKS = frozenset(",.;:!?")


class Recent(dict):
    """Values of now; those of the time before are kept until as many new ones have come."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        got = self.older.get(key, self)
        if got is self:
            got = self.make(key)
        self[key] = got
        return got

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class PieceEncoder:
    """The tokenizers library over a text's pieces, each distinct piece of some time encoded once.

    The byte-level pattern begins a word at a single space between two characters that are not white
    space, and never takes a run of letters together with what stands beside it, but for
    contractions. So a text is cut at spaces, and what stands between them at runs of letters. Such a
    run is one word and goes to the library's model; other pieces, and texts that cannot be cut, go
    through all of the library. So do all texts if the file asks for anything but that pattern.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.cuts = self.byte_level(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        # the printable character that stands for each byte
        self.symbols = {b: b if b in shown else next(spare) for b in range(256)}
        self.space = chr(self.symbols[32])
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.words = Recent(self.word, CACHE_PARTS)
        self.between = Recent(self.after_space, CACHE_PIECES)

    @staticmethod
    def byte_level(spec: dict) -> bool:
        """Whether the file has the byte-level pattern alone, plain merges, and special tokens that begin with "<|"."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        return bool(plain and merges and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or []))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, piece: str) -> bytes:
        if not piece[-1].isalpha():
            return self.whole([piece])[0]
        if piece.isascii():
            raw = piece.replace(" ", self.space)
        else:
            raw = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        table = self.bytes_of
        return b"".join([table[t.id] for t in self.model.tokenize(raw)])

    def cut(self, text: str) -> bytes | None:
        """The ids of a stretch of a text; None if its text cannot be cut."""
        if not text or WHOLE.search(text) or text[0].isspace() and not text[0] == " " or text[-1].isspace():
            return None
        return b"".join(map(self.words.__getitem__, PIECE.findall(text)))

    def after_space(self, text: str) -> bytes | None:
        """cut(" " + text), with fewer steps for a run of letters and for one with a mark behind it."""
        if text.isalpha() and (text.isascii() or not WHOLE.search(text)):
            return self.word(" " + text)
        if text[-1:] in MARKS and text[:-1].isalpha():
            before = self.between[text[:-1]]
            return None if before is None else before + self.words[text[-1]]
        return self.cut(" " + text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return self.whole([t or "" for t in texts])
        self.words.turn()
        self.between.turn()
        out: list[bytes | None] = []
        for text in texts:
            first, *rest = (text or "").split(" ")
            head = self.cut(first) if first else None
            try:
                out.append(b"".join([head, *map(self.between.__getitem__, rest)]))
            except TypeError:  # a part is None
                out.append(None)
        odd = iter(self.whole([t or "" for t, x in zip(texts, out) if x is None]))
        return [next(odd) if x is None else x for x in out]


_PIECES: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _PIECES:
        _PIECES[path] = PieceEncoder(path)
    return _PIECES[path]


def write_ids(docs: DataFrame, uri: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write the ids by ascending id to the folder uri."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(Simple8b)
    parts = ranges(docs)
    # the order is by id; the text's hash deals out rows that share an id and fixes their order
    # equal rows are dealt out by their place in the input
    rows = ids_and_texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(parts, "id", "h", "deal").sortWithinPartitions("id", "h")
    ranged.select(F.col("id").alias("doc_id"), "text").write.format("simple8b").option("tokenizer", path).option("end_id", end_id).mode("append").save(uri)


def read_ids(spark: SparkSession, uri: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, ids array<long>); start counts the ids of all documents before this one.

    With digests the ids stay in the reader: (doc_id, start, n_tokens, ids_crc32).
    """
    spark.dataSource.register(Simple8b)
    return spark.read.format("simple8b").option("digests", str(digests).lower()).load(uri)


def round_trip(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids, read the files back: (doc_id, start, n_tokens, ids_crc32) from what was read."""
    spark = docs.sparkSession
    uri = scratch_path(spark, "simple8b")
    write_ids(docs, uri, path, end_id, id_col, text_col)
    return read_ids(spark, uri, digests=True)
