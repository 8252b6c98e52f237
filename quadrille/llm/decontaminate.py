"""Benchmark decontamination: documents that hold a benchmark item but for a few edits.

Method
    Texts are sequences of words. An item of L words is in a document if some stretch of the
    document's words is within floor(rate * L) word edits of it. Candidates are windows of the
    item's size: the window and the item are embedded by CGK random walks (Chakraborty, Goldenberg
    and Koucky, 2016), which map edit distance to Hamming distance, and repeated bit-sampling LSH
    looks for windows and items that agree in all places a hash function samples. What agrees once
    is verified exactly by Sellers' dynamic programme over the words around the windows.

    A passage with words missing is shorter than its item, so each document stands between as
    many filler words, which no item has, as the longest item that fits it may miss. So there are windows
    aligned with a passage's start and with its end, also at a document's ends and in one shorter than the item.

    A window in which fewer than L - floor(rate * L) words are words of any item of L words cannot
    match one. Nor can one in which a word differs from the one before it in over 2 * floor(rate * L)
    places less than in any such item, for one edit changes two of them at most. Only the other
    windows are embedded; running sums tell them and lose nothing.

    ``walks`` embeddings with ``hashes`` hash functions of ``places`` sampled places each give the
    target recall; the tests measure it against brute force. There is no cap on candidates.

    The benchmark is the stated query set. It is sent to the workers in blocks of at most
    BLOCK_BYTES of text, one pass over the documents for each block; documents are not shuffled.

Defined results
    * null and empty texts match nothing, nor do items without words.
    * an item of fewer than 1 / rate words matches only without edits.
    * rows with null or repeated ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bounded_batches, ids_and_texts

RATE = 0.1
BLOCK_BYTES = 16_000_000
#: Words of windows that are embedded at a time.
WINDOW_WORDS = 2_000_000
#: Odd multipliers of the hash that draws the walks' bits.
MIX = (0x1E3779B97F4A7C15, 0x2545F4914F6CDD1D, 0x3F58476D1CE4E5B9)
#: Words, lower-cased: ASCII characters other than letters and digits separate them.
BREAKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BREAKS).split()


def sellers(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(fewest edits between item and a stretch of text, the first end of such a stretch)."""
    steps = np.arange(len(item) + 1)
    row, best, end = steps.copy(), len(item), 0
    for j, word in enumerate(text):
        step = np.empty_like(row)
        step[0] = 0
        np.minimum(row[1:] + 1, row[:-1] + (item != word), out=step[1:])
        row = np.minimum.accumulate(step - steps) + steps
        if row[-1] < best:
            best, end = int(row[-1]), j + 1
    return best, end


class Matcher:
    """The items of one block, embedded and hashed; made once in each worker."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, walks: int = 8, hashes: int = 12, places: int = 3, seed: int = 11):
        self.rate, self.walks, self.hashes, self.places = rate, walks, hashes, places
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.item_ids = [i for i, _ in split]
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64) for _, words in split]
        self.lengths = sorted({len(x) for x in self.items})
        self.edits = [math.floor(rate * n) for n in self.lengths]
        self.draw = np.random.default_rng(seed)
        self.mixers = self.draw.integers(1, 1 << 62, (walks, hashes, places), dtype=np.int64) | 1
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        self.sampled: dict[int, np.ndarray] = {}
        self.turns: dict[int, int] = {}  # by length: places where a word differs from the one before, at least
        self.used: dict[int, np.ndarray] = {}  # by length: 1 for the words of its items
        for length in self.lengths:
            own = [k for k, x in enumerate(self.items) if len(x) == length]
            self.used[length] = np.zeros(len(self.vocab) + 1, np.int32)
            self.used[length][np.concatenate([self.items[k] for k in own])] = 1
            self.turns[length] = min(int((np.diff(self.items[k]) != 0).sum()) for k in own)
            # places where both walks are still inside their strings, for the most part
            self.sampled[length] = self.draw.integers(0, max(1, 2 * length), (walks, hashes, places))
            keys = self.keys(np.stack([self.items[k] for k in own]), length)
            tables: list[dict[int, list[int]]] = []
            for h in range(keys.shape[1]):
                table: dict[int, list[int]] = {}
                for k, key in zip(own, keys[:, h].tolist()):
                    table.setdefault(key, []).append(k)
                tables.append(table)
            self.tables[length] = tables

    @staticmethod
    def bit(walk: int, step: int, symbol: np.ndarray) -> np.ndarray:
        """The walk's random bit of each symbol at a step: whether it goes on to the next symbol."""
        x = symbol * MIX[0] + ((walk << 40) + step) * MIX[1] % (1 << 62)
        x ^= x >> 31
        x *= MIX[2]
        return x >> 62 & 1

    def keys(self, windows: np.ndarray, length: int) -> np.ndarray:
        """One key for each window (a row of symbols) and hash function."""
        n = len(windows)
        end = len(self.vocab) + 1
        padded = np.concatenate([windows, np.full((n, 1), end, np.int64)], axis=1)
        out = np.empty((n, self.walks * self.hashes), np.int64)
        rows = np.arange(n)
        for walk in range(self.walks):
            sampled = self.sampled[length][walk]
            places = set(sampled.ravel().tolist())
            seen: dict[int, np.ndarray] = {}
            at = np.zeros(n, np.int64)
            for j in range(max(places) + 1):
                symbol = padded[rows, np.minimum(at, length)]
                if j in places:
                    seen[j] = symbol
                at += self.bit(walk, j, symbol)
            for h in range(self.hashes):
                key = np.zeros(n, np.int64)
                for p in range(self.places):
                    key = (key + seen[int(sampled[h, p])] + 1) * self.mixers[walk, h, p]
                    key ^= key >> 29
                out[:, walk * self.hashes + h] = key
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """For each text, its (item id, edits, end in words), in the items' order."""
        found: list[list[tuple[int | None, int, int]]] = [[] for _ in texts]
        if not self.items:
            return found
        get, parts, sizes, counts = self.vocab.get, [], [], []
        fewest = [n - e for n, e in zip(self.lengths, self.edits)]
        for text in texts:
            words = words_of(text)
            fits = bisect_right(fewest, len(words))
            fillers = self.edits[fits - 1] if fits else 0
            parts.append(np.zeros(fillers + len(words) + fillers, np.int64))
            parts[-1][fillers : fillers + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            counts.append(len(words))
            sizes.append(len(parts[-1]))
        all_words = np.concatenate(parts)
        # where the words of each text begin and end between its fillers
        begins = np.cumsum(sizes) - (np.array(sizes) + counts) // 2
        ends = begins + counts
        owner = np.repeat(np.arange(len(texts)), sizes)
        known = np.zeros(len(all_words) + 1, np.int32)
        # words that no item has count as different from one another, which can only keep a window
        turned = np.zeros(len(all_words) + 1, np.int32)
        np.cumsum((all_words[1:] != all_words[:-1]) | (all_words[1:] == 0), out=turned[2:])
        hits: dict[tuple[int, int], list[int]] = {}
        for length, need in zip(self.lengths, fewest):
            if len(all_words) < length:
                break
            np.cumsum(self.used[length][all_words], out=known[1:])
            at = np.flatnonzero(known[length:] - known[:-length] >= need)
            at = at[turned[at + length] - turned[at + 1] >= self.turns[length] - 2 * (length - need)]
            at = at[owner[at] == owner[at + length - 1]]
            some = max(1, min(4096, WINDOW_WORDS // length))
            for part in range(0, len(at), some):
                own = at[part : part + some]
                keys = self.keys(all_words[own[:, None] + np.arange(length)], length)
                for h, table in enumerate(self.tables[length]):
                    column = keys[:, h]
                    for i in np.flatnonzero(np.isin(column, np.fromiter(table, np.int64, len(table)))):
                        for k in table[int(column[i])]:
                            hits.setdefault((int(owner[own[i]]), k), []).append(int(own[i]))
        for doc, k in sorted(hits):
            item = self.items[k]
            edits = math.floor(self.rate * len(item))
            best: tuple[int, int] | None = None
            spans: list[tuple[int, int]] = []
            for at in sorted(set(hits[doc, k])):
                a = max(int(begins[doc]), at - edits)
                b = min(int(ends[doc]), at + len(item) + edits)
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            for lo, hi in spans:
                d, end = sellers(item, all_words[lo:hi])
                if d <= edits and (best is None or d < best[0]):
                    best = d, lo + end - int(begins[doc])
            if best:
                found[doc].append((self.item_ids[k], *best))
        return found


class _Lazy:
    """Builds the matcher in a worker from the items that were sent, once."""

    def __init__(self, items, rate: float):
        self.items, self.rate, self._made = items, rate, None

    def __getstate__(self):
        return self.items, self.rate

    def __setstate__(self, state):
        self.items, self.rate = state
        self._made = None

    def get(self) -> Matcher:
        if self._made is None:
            self._made = Matcher(self.items.value, self.rate)
        return self._made


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items, a block at a time; each block's text is bounded, whatever the benchmark's size."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, edits, end_word): the best match of each item in each document that holds it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, out = ids_and_texts(docs, id_col, text_col), None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        lazy = _Lazy(spark.sparkContext.broadcast(block), rate)

        def run(batches: Iterator[pa.RecordBatch], lazy=lazy) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                flat = [(ids[i], *m) for i, ms in enumerate(lazy.get().find(batch.column(1).to_pylist())) for m in ms]
                columns = list(zip(*flat)) if flat else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["id", "item_id", "edits", "end_word"])

        part = rows.mapInArrow(run, "id long, item_id long, edits int, end_word long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = docs.schema
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        lazy = _Lazy(spark.sparkContext.broadcast(block), rate)

        def run(batches: Iterator[pa.RecordBatch], lazy=lazy) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.names.index(text_col)
                found = lazy.get().find(batch.column(at).to_pylist())
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
