import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import bpe, simple8b

from .conftest import ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 40), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700))
def test_words_hold_any_ids(ids):
    words, escapes = simple8b.pack(np.array(ids, np.uint64))
    assert simple8b.unpack(words, escapes, len(ids)).tolist() == ids


def test_zeros_take_few_words_and_wide_ids_do_not_widen_neighbours():
    assert len(simple8b.pack(np.zeros(480, np.uint64))[0]) == 2
    narrow, wide = np.arange(100) % 100, np.arange(100) % 100
    wide[50] = 50_000
    assert len(simple8b.pack(wide)[0]) <= len(simple8b.pack(narrow)[0]) + 2


def expected_ids(rows):
    t, start, out = Tokenizer.from_file(BYTES), 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_are_written_in_order_and_read_back(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, simple8b.round_trip(docs, BYTES, 2).collect())) == expected_ids(rows)
    uri = f"file://{tmp_path}/ids"
    simple8b.write_ids(docs, uri, BYTES, 2)
    t = Tokenizer.from_file(BYTES)
    assert {r.doc_id: r.ids for r in simple8b.read_ids(spark, uri).collect()} == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}


def test_odd_rows_are_documents_like_others(odd, none):
    got = simple8b.round_trip(odd, BYTES, 2).collect()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(i), n, c) for i, _, n, c in expected_ids(ODD))
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert simple8b.round_trip(none, BYTES, 2).collect() == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "  ", "\n", "'s", "<|endoftext|>", " the", " ", "1 2"])), max_size=12))
def test_pieces_are_encoded_as_whole_texts_are(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    enc = simple8b.PieceEncoder(BYTES)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(WORDS)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.one_of(st.text(max_size=8), st.text("abcdeilnorst", max_size=24), st.sampled_from(["<|endoftext|>", "'LL", "Σς", "İ", "á", "\u0085", "½²"])), max_size=8))
def test_the_automaton_encodes_and_decodes_as_the_library_does(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    enc = bpe.encoder(WORDS)
    ids = enc.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert enc.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_compiled_rows_are_the_arcs_of_the_construction():
    a, draw = bpe.encoder(WORDS).automaton, np.random.default_rng(0)
    for x in [*draw.integers(0, 49_406, 300).tolist(), *range(256)]:
        row = a.row(a.target[x])
        near = [t for t in range(49_406) if a.left[t] == x or a.right[t] == x][:20]
        for y in [*draw.integers(0, 49_406, 60).tolist(), *near, *(a.right[t] for t in near)]:
            if y >= 0:
                n = a.number[y]
                assert a.arc(a.target[x], y) == bool(row[n >> 3] >> (n & 7) & 1)
    assert sorted(a.number) == list(range(len(a.target)))


def test_small_automata_accept_one_path_for_each_word():
    base, merges = list("ab"), [("a", "a"), ("a", "b"), ("aa", "b"), ("ab", "ab"), ("aa", "aa")]
    names = [*base, *(u + v for u, v in merges)]
    index = {n: i for i, n in enumerate(names)}
    a = bpe.Automaton([(index[u], index[v], index[u + v]) for u, v in merges], len(names))
    a.compile()

    def by_merging(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i : i + 2] == [u, v]:
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    def paths(word, state):
        if not word:
            yield []
        for n in names:
            place = a.number[index[n]]
            if word.startswith(n) and a.row(state)[place >> 3] >> (place & 7) & 1:
                for rest in paths(word[len(n) :], a.target[index[n]]):
                    yield [n, *rest]

    for length in range(1, 9):
        for bits in range(1 << length):
            word = "".join("ab"[bits >> k & 1] for k in range(length))
            assert list(paths(word, 0)) == [by_merging(word)]


def test_bpe_over_odd_rows(odd, none):
    got = sorted((str(r.id), tuple(r.ids)) for r in bpe.encode(odd, WORDS).collect())
    assert got == sorted((str(i), tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    texts = {r.id: r.text for r in bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()}
    assert texts[4] == "" and texts[6] == "word</w>"
    assert bpe.digests(none, WORDS).collect() == []


def test_a_file_that_is_cut_off_is_refused(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    uri = f"file://{tmp_path}/ids"
    simple8b.write_ids(docs, uri, BYTES, 2)
    part = next((tmp_path / "ids").glob("*.s8b"))
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(Exception):
        simple8b.read_ids(spark, uri).collect()
