"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

Method
    The base spans are those of the four patterns below, leftmost and non-overlapping by kind; a
    match that fails its check is dropped. The field then labels tokens (runs of characters that
    are not white space) as email, ip, card, phone or none, from word-shape features of a token and
    its two neighbours. It is trained on TRAINING, a small labelled table, by gradient descent on
    the penalised likelihood, and decoded by Viterbi in numpy over batches of padded windows. Features
    read whole tokens, and of a run of tokens of digits its whole number of digits and their check.
    Decoded tokens that touch no base span are added, runs of one label as one span; base spans stay as
    they are, and what stands on either side of one stays a run of its own.

    Windows: a token without a digit, "@", "+" or a bracket is plain. The field is defined with the
    label none wherever a token and both its neighbours are plain, in training and in decoding, so
    chains fall apart there and only the windows around other tokens are decoded.

Defined results
    * null and empty texts have no spans; offsets count code points, the end is exclusive.
    * rows with null or repeated ids are rows like others; an empty table gives no rows.
    * texts of any length are read in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import bounded_batches, ids_and_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches in linear time: each "@" with the run of local characters before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the four patterns, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- the labelled table -------------------------------------------------------------------------

#: Labelled sentences: [kind text] marks a span. Unmarked numbers are what must stay unmarked.
TRAINING = """
write to [email jane.doe@mail.example.com] before noon
Contact: [email sales.77@shop.example.org], or come by.
my address is <[email max_m@uni.example.edu]> at work
send it to [email li+news@example.net] please
reach me at [email jane (at) example (dot) com] any day
reach us at [email support [at] example [dot] org] any day
mail [email bob [at] mail.example.net] for the key
write to [email desk [at] shop4 [dot] net] some day
he sent [email ed7 [at] shop2 [dot] org] a list
mail [email ann (at) firm.example.com] for the list
the host [email ops@db-4.example.io] is down
the server [ip 10.20.30.40] is down
from [ip 192.168.0.17] to [ip 172.16.254.3] in one hop
ping [ip 8.8.4.4], then wait.
login from ([ip 203.0.113.9]) was refused
bound to [ip 127.0.0.1:8080] since then
bound to [ip 10.1.2.3:443] since then
paid with [card 4539578763621486] last week
card [card 4111 1111 1111 1111] was charged
card [card 5500-0055-5555-5559] was charged
use [card 3782 822463 10005] to pay
number [card 6011000990139424], please.
call [phone +1 (415) 555-0132] after five
call [phone +44 20 7946 0958] after five
phone: [phone +49-30-5550123], office
tel [phone +33 1 55 50 01 23] or later
call [phone (415) 555-0132] after five
call [phone (212) 555-0188] now
call [phone 415-555-0132] after five
tel [phone 646-555-0119], mornings
my number is [phone 303-555-0147] at home
fax [phone 020-7946-0958] or post
the year 1998 was dry and 2004 was wet
order 12345 has 3 items and costs 19.99 today
see page 12, line 7 and note 4 (of 9)
version 1.2.3 came after 1.2.2 and 1.10
the ratio was 3.14159 or 2.71828 at most
it took 12:30:05 on 2021-05-17 to end
from 1914-1918 and 1939-1945 in all
section 4.2.1 (b) says so (see 4.2)
id 1234567890123456 is no card at all
id 4111111111111112 is no card at all
id 4111 1111 1111 1112 is no card at all
number 5500 0055 5555 5551 was found
row 1234 5678 9012 3456 of the table
serial 99887766554433221100998877 was found
token = "58ed55e8cc700f5a0109593b09" was set
key 0x7fffffff and a1b2c3d4e5 were found
he scored 99% (up 5%) on it
300.400.500.600 is no address of a host
part 999.1.2.888 is no address of a host
a + b is more than a (or b) is
C++ and c@ and @home and [sic] were there
(the same) [again] (and again) as before
costs 1,250 or 12 500 in all
room 415-555 and 0132 were free
555-0132 was in the list of rooms
x [1] y [2] z [3] and so on
at 5 (at most) it was [at] once
""".strip()

CHUNK = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@+\[({]")
STRIP_LEFT, STRIP_RIGHT = "<\"'[{,;:.!?", ">\"'])},;:.!?"
KNOWN = frozenset("call phone tel fax mail email card number address paid".split())
_MARK = re.compile(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[(?:at|dot)\])+)\]")
_RUNS = ((re.compile(r"[0-9]+"), "d"), (re.compile(r"[^\W\d_]+"), "a"))


def _octets(core: str) -> bool:
    parts = core.partition(":")[0].split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)


def shape_features(token: str) -> tuple[str, ...]:
    """Features of one token alone; ("plain",) for tokens that no trigger marks. Short ones are kept."""
    return _kept_shape(token) if len(token) <= 80 else _shape(token)


def _shape(token: str) -> tuple[str, ...]:
    if not TRIGGER.search(token):
        word = token.strip(STRIP_LEFT + STRIP_RIGHT + ")=").lower()
        return (f"known:{word}",) if word in KNOWN else ("plain",)
    core = token.strip("<>\"',;:.!?")
    shape = core
    for pattern, to in _RUNS:
        shape = pattern.sub(to, shape)
    n = sum(c.isdigit() for c in core)
    digits = "".join(c for c in core if c in "0123456789")
    out = [f"shape:{shape if len(shape) <= 14 else 'long'}", "marked"]
    if n and "@" not in core and any(c.isalpha() for c in core):
        return (*out, "letters and digits")
    out.append(f"digits:{n if n < 6 else 'many' if n > 19 else '6-9' if n < 10 else '10-13' if n < 14 else '14-19'}")
    runs = re.findall(r"[0-9]+", core)
    out.append("runs:" + ("-".join(str(min(len(r), 9)) for r in runs) if len(runs) <= 4 else "many"))
    if 14 <= n <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if _octets(core):
        out.append("octets")
    if "@" in core[1:-1]:
        out.append("inner@")
    if core.lower() in ("(at)", "[at]", "(dot)", "[dot]"):
        out.append(f"spelt:{core.lower()[1:-1]}")
    if core[:1] == "+" and core[1:2].isdigit():
        out.append("plus")
    return tuple(out)


_kept_shape = lru_cache(maxsize=50_000)(_shape)


def grouped(tokens: list[str]) -> list[str | None]:
    """A feature for the tokens of digits that stand in a run of such: whether the run is a card's number."""
    out: list[str | None] = [None] * len(tokens)
    i = 0
    while i < len(tokens):
        j, digits = i, []
        while j < len(tokens) and (d := tokens[j].strip("<>\"',;:.!?()")).isascii() and d.isdigit():
            digits.append(d)
            j += 1
        if j > i + 1:
            whole = "".join(digits)
            found = f"group:luhn:{luhn(whole)}" if 14 <= len(whole) <= 19 else "group:other"
            out[i:j] = [found] * (j - i)
        i = max(j, i + 1)
    return out


def token_features(tokens: list[str], i: int, groups: list[str | None]) -> list[str]:
    out = list(shape_features(tokens[i]))
    if groups[i]:
        out.append(groups[i])
    out += ["-" + f for f in (shape_features(tokens[i - 1]) if i else ("plain",))]
    out += ["+" + f for f in (shape_features(tokens[i + 1]) if i + 1 < len(tokens) else ("plain",))]
    return out


def marked(tokens: list[str], i: int) -> bool:
    """Whether the token or a neighbour is not plain, so labels other than none are allowed."""
    return any(TRIGGER.search(t) for t in tokens[max(0, i - 1) : i + 2])


def training_rows() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in TRAINING.split("\n"):
        text, spans, last = "", [], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            spans.append((len(text), len(text) + len(m[2]), LABELS.index(m[1])))
            text += m[2]
            last = m.end()
        text += line[last:]
        tokens, labels = [], []
        for m in CHUNK.finditer(text):
            tokens.append(m.group())
            labels.append(next((k for a, b, k in spans if m.start() < b and m.end() > a), 0))
        rows.append((tokens, labels))
    return rows


# -- the field ----------------------------------------------------------------------------------


class Field:
    """Weights of a linear-chain field: one row for each feature, and label-to-label transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def emissions(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        groups = grouped(tokens)
        for i in range(len(tokens)):
            slots = [self.index[f] for f in token_features(tokens, i, groups) if f in self.index]
            out[i] = self.weights[slots].sum(axis=0)
            if not marked(tokens, i):
                out[i, 1:] = -1e9
        return out

    def viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best label paths of sequences of emissions, padded to one length and decoded together."""
        if not batch:
            return []
        lengths = np.array([len(x) for x in batch])
        longest, n = int(lengths.max()), len(batch)
        e = np.zeros((n, longest, len(LABELS)))
        for i, x in enumerate(batch):
            e[i, : len(x)] = x
        best, back = e[:, 0], np.zeros((n, longest, len(LABELS)), np.int8)
        ends = np.where((lengths == 1)[:, None], best, 0)
        for t in range(1, longest):
            step = best[:, :, None] + self.moves[None]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, t]
            ends = np.where((lengths == t + 1)[:, None], best, ends)
        out, label = np.zeros((n, longest), np.int8), ends.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = lengths > t
            out[live, t] = label[live]
            inner = live & (t > 0)
            label = np.where(inner, back[np.arange(n), t, label], label)
        return [out[i, :m] for i, m in enumerate(lengths)]


@lru_cache(maxsize=1)
def trained(steps: int = 250, rate: float = 0.15, penalty: float = 0.02) -> Field:
    """Fit the field to the labelled table: forward-backward in log space, Adam, deterministic."""
    rows = training_rows()
    found = [[token_features(tokens, i, groups) for i in range(len(tokens))] for tokens, _ in rows for groups in [grouped(tokens)]]
    names = sorted({f for row in found for own in row for f in own})
    index, k = {f: i for i, f in enumerate(names)}, len(LABELS)
    longest, n = max(len(t) for t, _ in rows), len(rows)
    x, y, mask = np.zeros((n, longest, len(names)), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for r, (tokens, labels) in enumerate(rows):
        for i in range(len(tokens)):
            x[r, i, [index[f] for f in found[r][i]]] = 1
        y[r, : len(labels)], mask[r, : len(labels)] = labels, True
    free = np.zeros((n, longest, k))
    for r, (tokens, _) in enumerate(rows):
        for i in range(len(tokens)):
            if not marked(tokens, i):
                free[r, i, 1:] = -1e9
    gold = np.eye(k)[y] * mask[..., None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    w, t = np.zeros((len(names), k)), np.zeros((k, k))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    flat = x.reshape(-1, len(names))
    lengths = mask.sum(axis=1)
    for step in range(1, steps + 1):
        e = (flat @ w).reshape(n, longest, k) + free
        f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        f[:, 0] = e[:, 0]
        for i in range(1, longest):
            nxt = lse(f[:, i - 1][:, :, None] + t[None], 1) + e[:, i]
            f[:, i] = np.where(mask[:, i][:, None], nxt, f[:, i - 1])
        for i in range(longest - 2, -1, -1):
            prev = lse(t[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(mask[:, i + 1][:, None], prev, 0)
        z = lse(f[np.arange(n), lengths - 1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        pair = np.exp(f[:, :-1, :, None] + t[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [flat.T @ (p - gold).reshape(-1, k) + penalty * w, pair.sum(axis=(0, 1)) - gold_moves + penalty * t]
        for j, (at, g) in enumerate(zip((w, t), grads)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            at -= rate / (1 + step / 60) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Field(index, w, t)


def windows(text: str) -> list[tuple[list[str], list[int]]]:
    """Runs of tokens, with their starts, that lie within two places of one that is not plain."""
    out: list[tuple[list[str], list[int]]] = []
    reached = -1  # end of the last window
    pos = 0
    while m := TRIGGER.search(text, pos):
        left = m.start()
        while left and not text[left - 1].isspace():
            left -= 1
        first = CHUNK.match(text, left)
        before: list[tuple[str, int]] = []
        end = left
        while len(before) < 2 and end > max(reached, 0):
            while end > max(reached, 0) and text[end - 1].isspace():
                end -= 1
            start = end
            while start > max(reached, 0) and not text[start - 1].isspace():
                start -= 1
            if start == end:
                break
            before.append((text[start:end], start))
            end = start
        new = [*reversed(before), (first.group(), first.start())]
        after, at = [], first.end()
        while len(after) < 2 and (c := CHUNK.search(text, at)):
            if TRIGGER.search(c.group()):
                break
            after.append((c.group(), c.start()))
            at = c.end()
        new += after
        pos = max(first.end(), after[-1][1] + len(after[-1][0]) if after else 0)
        gap = text[reached : new[0][1]] if reached >= 0 else "x"
        if out and not gap.strip() and reached >= 0:
            tokens, starts = out[-1]
        else:
            tokens, starts = [], []
            out.append((tokens, starts))
        tokens += [t for t, _ in new]
        starts += [s for _, s in new]
        reached = pos
    return out


def _trim(token: str, start: int, end_of_kind: bool, start_of_kind: bool, kind: int) -> tuple[int, int]:
    a, b = 0, len(token)
    if start_of_kind:
        a = len(token) - len(token.lstrip(STRIP_LEFT.replace("[", "") if kind == 1 else STRIP_LEFT))
    if end_of_kind:
        b = len(token.rstrip(STRIP_RIGHT))
    return start + a, start + max(b, a)


def alone(token: str, kind: int) -> bool:
    """Whether the token is a whole span of its kind, so beside another of the kind it stays apart."""
    return {1: "inner@", 2: "octets", 3: "luhn:True"}.get(kind, "") in shape_features(token)


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[list[str], list[int], np.ndarray]]) -> list[tuple[int, int, int]]:
    """Runs of tokens of one label that touch no base span, without the marks around them."""
    out = []
    # base spans of different kinds may overlap; merged, their ends are in order
    taken: list[list[int]] = []
    for a, _, b in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]

    def free(a: int, b: int) -> bool:
        at = bisect_right(ends, a)
        return at == len(taken) or taken[at][0] >= b

    for tokens, starts, labels in found:
        i = 0
        while i < len(tokens):
            kind = int(labels[i])
            if not kind or not free(starts[i], starts[i] + len(tokens[i])):
                i += 1
                continue
            j = i
            while j + 1 < len(tokens) and labels[j + 1] == kind and free(starts[j + 1], starts[j + 1] + len(tokens[j + 1])) and not (alone(tokens[j], kind) or alone(tokens[j + 1], kind)):
                j += 1
            a = _trim(tokens[i], starts[i], i == j, True, kind)[0]
            b = _trim(tokens[j], starts[j], True, i == j, kind)[1]
            if a < b:
                out.append((a, kind - 1, b))
            i = j + 1
    return out


def find_all(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the windows of all texts are decoded as one batch."""
    base, wins, owner = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base.append(base_spans(text) if TRIGGER.search(text) else [])
        for w in windows(text):
            wins.append(w)
            owner.append(i)
    emissions = [field.emissions(tokens) for tokens, _ in wins]
    # longest first, so that a batch pads little; 512 windows at a time bound the memory
    order = sorted(range(len(wins)), key=lambda i: -len(emissions[i]))
    paths: list = [None] * len(wins)
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        for i, path in zip(part, field.viterbi([emissions[i] for i in part])):
            paths[i] = path
    per: dict[int, list] = {}
    for i, own in enumerate(owner):
        per.setdefault(own, []).append((*wins[i], paths[i]))
    return [(b, sorted(b + added_spans(text or "", b, per.get(i, [])))) for i, (text, b) in enumerate(zip(texts, base))]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _finder(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all(batch.column(1).to_pylist(), field.value)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            sha = [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([spelled(a) for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    field = spark.sparkContext.broadcast(trained())
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(_finder(field), f"id long, {kinds}, base_sha256 string, spans string")


def masked_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span's characters replaced by its kind; of overlapping spans, their union by the first's kind."""
    if text is None or not spans:
        return text
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    out.append(text[last:])
    return "".join(out)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col masked; other columns and rows as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    field = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = batch.column(at).to_pylist()
            new = [masked_text(t, spans) for t, (_, spans) in zip(texts, find_all(texts, field.value))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
