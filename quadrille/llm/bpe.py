"""BPE encoding and decoding by a tokenization automaton.

Method
    The automaton reads tokens and accepts exactly the correct tokenizations of words. It starts as
    one state with a loop for every base symbol and takes one gadget for each merge (u, v) -> t, in
    rank order: the state q that u leads to is copied without its arc for v, all arcs for u now lead
    to the copy, and wherever u then v could be read, an arc for t leads to where v led (Berglund,
    Martens and van der Merwe, "Constructing a BPE tokenization DFA"). As the start has one state,
    all arcs with one label lead to one state.

    The transitions are compiled to arrays: ``follow`` has the state that each label leads to, and
    a state's row has one bit for each label, whether there is an arc. A row is made when its state is
    first met and kept up to ROWS of them, some 6 KB each. What a copy takes away from a
    state is the arc for v and the arcs that later gadgets would have derived from it, which begin with
    v; labels are numbered so that these stand together, so a row is made by clearing one
    stretch for each copy that the state comes from.

    A word is encoded left to right: at each place exactly one token that ends there has an arc from
    the state at the token's start, and the transition gives the next state; the path is read back from the
    end. Decoding emits the labels of the ids. Words are cached, up to a bound.

    Texts are cut at special tokens, normalised and split as the vocabulary file says: NFC, white
    space to one space, lower case, then the words of its pattern. For scripts whose classes are
    settled the pattern runs in the standard library; texts with other characters go through the
    tokenizers library's own normaliser and splitter.

Defined results
    * null and empty texts have no tokens and decode to the empty text.
    * rows with null or repeated ids are rows like others; an empty table gives no rows.
    * words of any length are encoded in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bounded_batches, ids_and_texts

CACHE_WORDS = 150_000
LONGEST_CACHED = 64
#: Compiled rows that a worker holds before it starts anew.
ROWS = 8_192


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Automaton:
    """The tables. Labels are token ids; state 0 is the start."""

    def __init__(self, merges: list[tuple[int, int, int]], labels: int):
        self.parent, self.made, self.lost = [-1], [0], [-1]
        self.target = [0] * labels  # of each label
        self.when = [0] * labels  # rank of the merge that makes the label, from 1; 0 for base symbols
        self.left, self.right = [-1] * labels, [-1] * labels
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (u, v, t) in enumerate(merges, 1):
            self._add(rank, u, v, t)

    def _add(self, rank: int, u: int, v: int, t: int) -> None:
        """The gadget of one merge."""
        if t in (u, v) or self.when[t] or (u, v) in self.rank:
            raise ValueError("a token has one merge, of tokens other than itself")
        q, r = self.target[u], self.target[v]
        self.parent.append(q)
        self.made.append(rank)
        self.lost.append(v)
        self.target[u] = len(self.made) - 1
        self.target[t] = r
        self.when[t], self.left[t], self.right[t] = rank, u, v
        self.rank[u, v] = rank

    def arc(self, state: int, label: int) -> bool:
        """Whether state has an arc for label, by the construction: walk back through the copies."""
        while state:
            if self.when[label] and self.when[label] >= self.made[state]:
                label = self.left[label]  # its gadget gave state an arc if it had one for the left part
            elif self.lost[state] == label:
                return False
            else:
                state = self.parent[state]
        return True

    def compile(self) -> None:
        """Number the labels for rows: a label, then what begins with it by the time it was made.

        ``number`` is a label's place in that order, ``after`` the end of its own stretch, ``follow``
        the state it leads to.
        """
        begins: list[list[int]] = [[] for _ in self.target]
        roots = []
        for t in sorted(range(len(self.target)), key=lambda t: self.when[t]):
            (roots if self.left[t] < 0 else begins[self.left[t]]).append(t)
        self.number, self.after = [0] * len(self.target), [0] * len(self.target)
        at, todo = 0, [(t, False) for t in reversed(roots)]
        while todo:
            t, done = todo.pop()
            if done:
                self.after[t] = at
                continue
            self.number[t], at = at, at + 1
            todo.append((t, True))
            todo += [(c, False) for c in reversed(begins[t])]
        self.begins = begins
        self.begun = [[self.when[c] for c in own] for own in begins]
        self.follow = np.array(self.target, np.int32)

    def row(self, state: int) -> bytes:
        """One bit for each label's number: whether the state has an arc for it."""
        out = np.ones(len(self.target), np.uint8)
        while state:
            v = self.lost[state]
            out[self.number[v]] = 0
            first = bisect_left(self.begun[v], self.made[state])  # labels made from v since then got no arc
            if first < len(self.begins[v]):
                out[self.number[self.begins[v][first]] : self.after[v]] = 0
            state = self.parent[state]
        return np.packbits(out, bitorder="little").tobytes()


class Encoder:
    """Words to tokens by the automaton, texts to words by the vocabulary file's rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        labels = max(self.tokens) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton([(self.vocab[u], self.vocab[v], self.vocab[u + v]) for u, v in pairs], labels)
        self.automaton.compile()
        self.rows: dict[int, bytes] = {}
        self.longest = max(len(t) - (len(self.end) if self.end and t.endswith(self.end) else 0) for t in self.vocab)
        self.symbols = byte_symbols()
        pre = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split")
        self.plain = pattern == self.PATTERN
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.specials) + ")") if self.specials else None
        self.path = path
        self._library = None
        # numbers of tokens within a word, with -1 for mere beginnings of some; of tokens at a word's end, without the mark
        cut, number = len(self.end), self.automaton.number
        self.final = {t[: len(t) - cut]: number[i] for t, i in self.vocab.items() if t.endswith(self.end)}
        within = [(t, number[i]) for t, i in self.vocab.items() if not (cut and t.endswith(self.end))]
        self.inner = {t[:k]: -1 for t, _ in within for k in range(1, len(t))} | dict(within)
        ids = sorted(range(labels), key=number.__getitem__)
        self.label = ids  # by number
        self.next = self.automaton.follow[ids].tolist()  # state by number
        self.digits = [str(i) for i in range(labels)]
        # words of now, and of the time before
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    # scripts whose letters, digits and cases are settled: Latin to Cyrillic and general punctuation, without
    # the numbers that are no digits. In them the file's pattern is PLAIN, for the standard library's engine.
    USUAL = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u012f\u0131-\u02ff\u0388-\u03a1\u03a4-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*+\\Z")
    PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised. White space is in no word."""
        if self.plain and self.USUAL.match(text):
            return self.PLAIN.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._bytes = {c: b for b, c in enumerate(self.symbols)}
        t = self._library
        pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in p).decode("utf-8", "replace") for p, _ in pieces]

    def row(self, state: int) -> bytes:
        got = self.rows.get(state)
        if got is None:
            if len(self.rows) >= ROWS:
                self.rows.clear()
            got = self.rows[state] = self.automaton.row(state)
        return got

    def encode_word(self, word: str) -> list[int]:
        """One pass over the word's bytes; at each place one token has an arc from the state there."""
        symbols = "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        n, inner, final, label = len(symbols), self.inner, self.final, self.label
        last, back = [-1] * (n + 1), [0] * (n + 1)  # the number of the label that ends here, and where it begins
        state = 0
        for j in range(n):
            if j:
                if last[j] < 0:
                    raise ValueError("a byte has no base symbol in the vocabulary")
                state = self.next[last[j]]
            row, i = self.row(state), j
            while True:
                i += 1
                if i < n:
                    x = inner.get(symbols[j:i])
                    if x is None:  # no token begins like this: the last place is left to try
                        i = n
                if i == n:
                    x = final.get(symbols[j:]) if n - j <= self.longest else None
                if x is not None and x >= 0 and last[i] < 0 and row[x >> 3] >> (x & 7) & 1:
                    last[i], back[i] = x, j
                if i == n:
                    break
        out, i = [], n
        while i:
            out.append(label[last[i]])
            i = back[i]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        got = self.cache.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.encode_word(word)
            if len(word) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE_WORDS:
                    self.older, self.cache = self.cache, {}
                self.cache[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or "<|" not in text:
            pieces = [text]
        else:
            pieces = self.cut.split(text)
        out: list[int] = []
        for p in pieces:
            if p in self.specials:
                out.append(self.specials[p])
            elif p:
                for ids in map(self.word, self.split(p)):
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Emit the labels' strings; a file without a decoder joins them by spaces. Unknown ids emit nothing."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                own = enc.encode(text.as_py())
                n.append(len(own))
                ids.append(hashlib.sha256(" ".join([enc.digits[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _lister(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _speller(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row for each row of docs."""
    bounded_batches(docs.sparkSession)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(_lister(path), "id long, ids array<int>")


def decode(ids: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the labels of each row's ids, joined by spaces; null ids are no ids."""
    bounded_batches(ids.sparkSession)
    rows = ids.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_speller(path), "id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs."""
    bounded_batches(docs.sparkSession)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(_coder(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").select("id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
